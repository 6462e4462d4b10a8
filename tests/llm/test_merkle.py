import hashlib
import random
import zlib

import pytest

from codetally.llm import merkle as m
from codetally.llm.queries import QUERIES
from tests.llm.conftest import DOCS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs(nodes):
    return [nodes[i : i + 16] for i in range(0, len(nodes), 16)]


def climb(nodes):
    """The root, and for every node its siblings left and right on each level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for run, members in zip(runs(nodes), runs(under), strict=True):
            for k, leaves in enumerate(members):
                for i in leaves:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, under = [sha("".join(run)) for run in runs(nodes)], [sum(members, []) for members in runs(under)]
    return nodes[0], paths


def brute(rows):
    def leaf(row, lower=False):
        values = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])]
        if lower and values[4] is not None:
            values[4] = values[4].translate({c: c + 32 for c in range(65, 91)})
        return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), leaf(row, True)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = []
    for name in order:
        groups[name].sort()
        tops.append(climb([g[2] for g in groups[name]]))
    root, above = climb([top for top, _ in tops]) if tops else (None, [])
    result = []
    for name, (subroot, paths), rest in zip(order, tops, above, strict=True):
        for (known, doc_id, digest, lowered), path in zip(groups[name], paths, strict=True):
            node = lowered if known and zlib.crc32(str(doc_id).encode()) % 5 == 0 else digest
            for left, right in path + rest:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path + rest))
            result.append((doc_id if known else None, digest, subroot, root, proof, node, node == root))
    return sorted(result, key=str)


def asked(spark, folder):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in QUERIES["op13_merkle_manifest"](spark, folder).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 272, 273, 4095, 4096, 4097, 4113, 5000])
def test_positions_number_the_log(n):
    log = []
    for block in range(-(-n // 4096)):
        builder = m.Builder(n, 0)
        log += [node for i in range(4096 * block, min(n, 4096 * block + 4096)) for node in builder.append(i, f"{i}")]
    top = [(idx, digest) for level, idx, _, digest in log if level == 3]
    if n > 4096:
        builder = m.Builder(n, 3)
        log += [node for idx, digest in top for node in builder.append(idx, digest) if node[0] > 3]
    assert sorted(at for _, _, at, _ in log) == list(range(len(log)))
    assert len(log) == sum(m.width(n, level) for level in range(m.height(n) + 1))
    # Children stand before their parent, the parent of the last one right after it.
    at = {(level, idx): place for level, idx, place, _ in log}
    assert all(at[level + 1, idx // 16] > place for (level, idx), place in at.items() if level < m.height(n))


def test_query_like_brute_force(spark, tables, documents):
    rows = [r.asDict() for r in documents.collect()]
    rng = random.Random(4)
    rows += [{"doc_id": 1000 + i, "text": "Repeated" * (i % 3), "lang": None, "source": rng.choice(["s", "t", "é", "z", "", None]), "n_chars": None} for i in range(700)]
    rows += [{"doc_id": None, "text": "", "lang": None, "source": "hot", "n_chars": 0}] * 300
    rows += [{"doc_id": i, "text": "Alone", "lang": "en", "source": f"own {i}", "n_chars": 5} for i in range(300)]
    folder = tables(documents=spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS).repartition(5))
    assert asked(spark, folder) == brute(rows)


@pytest.mark.parametrize("block_levels", [1, 3])
def test_rounds(spark, tables, monkeypatch, block_levels):
    monkeypatch.setattr(m, "BLOCK_LEVELS", block_levels)
    sizes = {"a": 4500, "b": 257, "c": 16, "d": 1, "e": 256} if block_levels == 3 else {"a": 4100, "b": 257, "c": 16, "d": 1, "e": 256, **{f"s{i}": 1 for i in range(20)}}
    rows = [{"doc_id": i, "text": f"Text {i}", "lang": "en", "source": name, "n_chars": 1} for name, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    folder = tables(documents=spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS))
    assert asked(spark, folder) == brute(rows)


def test_log_and_callers_columns(spark):
    rows = spark.range(300).selectExpr("id", "id % 2 as group", "id as tree", "'x' as digest", "id as kept", "id as at", "id as range")
    made = m.manifest(rows, "group", "id", ["id", "tree", "digest"], m.F.struct("kept", "at", "range", "tree"))
    log = made.log().collect()
    for tree, n in ((0, 150), (1, 150), (m.UPPER_TREE, 2)):
        mine = [r for r in log if r.tree == tree]
        assert sorted(r.position for r in mine) == list(range(len(mine)))
        assert sorted((r.level, r.idx) for r in mine) == [(level, i) for level in range(m.height(n) + 1) for i in range(m.width(n, level))]
    assert sorted(r.kept.tree for r in made.proofs().collect()) == list(range(300))


def test_no_documents(spark, tables, no_documents):
    assert QUERIES["op13_merkle_manifest"](spark, tables(documents=no_documents)).count() == 0
