import random

import numpy as np
import pytest
import xxhash

from codetally.llm import simhash
from codetally.llm.components import components
from codetally.llm.queries import QUERIES
from tests.llm.conftest import prose


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(numbers, radius=2):
    label = {n: n for n in numbers}
    changed = True
    while changed:
        changed = False
        for a in numbers:
            for b in numbers:
                if (a ^ b).bit_count() <= radius and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def near_numbers(seed, groups=12, members=12):
    rng = random.Random(seed)
    numbers = {0, 1, 3, 1 << 63, (1 << 64) - 1}
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(members):
            n = base
            for _ in range(rng.randint(0, 4)):
                n ^= 1 << rng.randrange(64)
            numbers.add(n)
    return sorted(numbers)


def test_fingerprints(awkward):
    for text in awkward:
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_spark_s_own_hash_is_the_same(spark):
    [row] = spark.sql("select xxhash64('a b c') h").collect()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("seed", range(4))
def test_forest_like_brute_force(seed):
    numbers = near_numbers(seed)
    root = simhash.forest(np.array(numbers, np.uint64), 2)
    want = brute_roots(numbers)
    assert [numbers[r] for r in root] == [want[n] for n in numbers]


@pytest.mark.parametrize("shard_size", [8, 64, 4096])
def test_links_over_shards_and_split_blocks(spark, shard_size):
    numbers = near_numbers(5, 6, 30)
    signed = [n - (1 << 64) if n >> 63 else n for n in numbers]
    links = simhash.near_links(spark.createDataFrame([(n,) for n in signed], "fp long"), 2, shard_size)
    groups = {}
    for row in components(links).collect():
        groups.setdefault(row.root, set()).add(row.node % (1 << 64))
    want = {}
    for n, root in brute_roots(numbers).items():
        want.setdefault(root, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 300), (200, 201), (201, 200)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(texts):
    """Least id reachable, for (id, text) pairs."""
    marks = [brute_fingerprint(t) for _, t in texts]
    roots = brute_roots(sorted(set(marks)))
    least = {}
    for (i, _), m in zip(texts, marks, strict=True):
        if i is not None:
            least[roots[m]] = min(i, least.get(roots[m], i))
    return [(i, f"{m:016x}", least.get(roots[m])) for (i, _), m in zip(texts, marks, strict=True)]


def test_query(tables, documents):
    rows = QUERIES["op10_simhash_near_dedup"](documents.sparkSession, tables(documents=documents)).collect()
    want = brute_components([(r.doc_id, r.text) for r in documents.collect()])
    key = lambda t: str(t)
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)


def test_one_row_of_each_component_stays(spark, documents):
    long = prose(900, 9)
    rows = [(20, long, "z"), (21, long + " tail", "z"), (22, long, "z"), (None, long, "z"), (None, "alone without id", "z"), (None, "alone without id", "z"), (30, "", "z"), (31, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5], r.component_id) for r in kept) == [
        (False, 20, long[:5], "z"), (False, 30, "", "z"), (True, 0, "alone", "z"),
    ]


def test_no_documents(tables, no_documents):
    assert QUERIES["op10_simhash_near_dedup"](no_documents.sparkSession, tables(documents=no_documents)).count() == 0
    assert simhash.drop_near_duplicates(no_documents).count() == 0


def test_clashing_columns(spark):
    names = ["_kept_id", "_kept_null", "_kept_hash", "_copy", "copy", "row", "kept_id", "root", "fp"]
    docs = spark.createDataFrame([(i, "same text here and more", *names) for i in (5, 4, 4)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    [kept] = simhash.drop_near_duplicates(docs).collect()
    assert kept.doc_id == 4 and [kept[n] for n in names] == names
