"""Merkle manifests of a dataset, kept as a postorder append log.

Every row is a leaf; the leaves of a group form a tree in which every ``ARITY`` consecutive nodes have a parent, and the
trees' roots, in the order of their groups, form one more tree above. Leaves are dealt into aligned blocks of
``ARITY ** BLOCK_LEVELS``. A builder reads a block's leaves in order and appends every node to the log when its last
child is complete. Where a node stands in the log of its tree follows from its level, its place in the level and the
number of leaves alone (``position``), so builders need not know of each other. The nodes that top a block are the
leaves of the next round's blocks, until one node is left.

Proofs are read from the log from the top round down: a block's nodes are its own part of the log and the proof of its
top node; siblings are addressed by their positions. No task holds more than a block, whatever the size of a group.

Leaves are placed by one sort by group, id and leaf, cut by ranges and written once. The last sort key is the row's
number in a written table, so a group, an id or a row that comes very often is cut like any other.

Defined cases: a null is hashed as ``-``, like nothing else; the empty text is not null. Leaves of one id are ordered by
their digest; a null id comes first, as does the null group. A group of one row has its leaf as root. Texts are hashed
whole. An empty table has no nodes, no proofs and no root. Columns not named take no part; the caller's rows travel as
one struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.lineage import in_order
from codetally.llm.shared import LOWER, UPPER, documents, stored

ARITY = 16
BLOCK_LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_EVERY = 5
#: The tree of all groups' roots; groups are numbered from 0.
UPPER_TREE = -1
_HEX = 64
_PROOF = "array<struct<before:string, after:string>>"


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree of ``n`` leaves."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def position(level: int, idx: int, n: int) -> int:
    """Where a node stands in the log of a tree of ``n`` leaves: after its subtree and all that was complete before."""
    end = min((idx + 1) * ARITY**level, n)
    complete = sum(width(end, at) for at in range(level + 1))
    return complete + sum((end - 1) // ARITY**at for at in range(level + 1, height(n) + 1)) - 1


def joined(digests: list[str]) -> str:
    """The digest of nodes taken together."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Builder:
    """Appends the nodes of one block of a tree, whose leaves for this round are on level ``base``."""

    def __init__(self, n: int, base: int):
        self.n, self.base = n, base
        self.open: list[list[str]] = [[] for _ in range(BLOCK_LEVELS)]

    def append(self, idx: int, digest: str) -> Iterator[tuple[int, int, int, str]]:
        """The nodes complete with this one: level, place, position, digest."""
        yield self.base, idx, position(self.base, idx, self.n), digest
        for level, run in enumerate(self.open, self.base):
            last = width(self.n, level) - 1
            if not last:
                return  # the root
            run.append(digest)
            if idx < last and idx % ARITY < ARITY - 1:
                return
            digest, idx = joined(run), idx // ARITY
            run.clear()
            yield level + 1, idx, position(level + 1, idx, self.n), digest


def block_proofs(n: int, base: int, block: int, above: list[dict], nodes: dict[int, str]) -> dict[int, list[dict]]:
    """The proof of each node on level ``base`` of a block: its siblings' digests, left and right, up to the tree's end.

    ``nodes`` is the block's part of the log by position, ``above`` the proof of the block's last node.
    """
    proofs = {block: above}
    for level in reversed(range(base, min(base + BLOCK_LEVELS, height(n)))):
        below = {}
        for parent, proof in proofs.items():
            run = range(ARITY * parent, min(ARITY * parent + ARITY, width(n, level)))
            digests = "".join([nodes[position(level, idx, n)] for idx in run])
            for at, idx in enumerate(run):
                below[idx] = [{"before": digests[: _HEX * at], "after": digests[_HEX * (at + 1) :]}, *proof]
        proofs = below
    return proofs


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """A block's rows together and in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _round(nodes: DataFrame, base: int) -> DataFrame:
    """The log of one round; ``nodes`` are the nodes ``tree, n, idx, digest`` on level ``base``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, building = None, None
        for batch in batches:
            log = []
            for tree, n, idx, digest, block in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if building != (tree, block):
                    builder, building = Builder(n, base), (tree, block)
                log += [(tree, n, *node) for node in builder.append(idx, digest)]
            yield _batch(log, ["tree", "n", "level", "idx", "position", "digest"])

    block = F.shiftright("idx", 4 * BLOCK_LEVELS).alias("block")
    dealt = _dealt(nodes.select("tree", "n", "idx", "digest", block), "idx")
    return stored(dealt.mapInArrow(build, "tree bigint, n bigint, level bigint, idx bigint, position bigint, digest string"))


def _batch(rows: list[tuple], names: list[str], types: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    kinds = {"digest": pa.string(), "top": pa.string()} | (types or {})
    columns = [*zip(*rows, strict=True)] or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(name, pa.int64())) for c, name in zip(columns, names, strict=True)], names)


def append_log(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The log of all trees, round by round; ``most`` is the number of leaves of the largest tree."""
    rounds = [_round(leaves, 0)]
    while width(most, BLOCK_LEVELS * len(rounds)) > 1:
        base = BLOCK_LEVELS * len(rounds)
        rounds.append(_round(rounds[-1].filter((F.col("n") > ARITY**base) & (F.col("level") == base)), base))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, n, digest`` of every tree's last node."""
    found = []
    for k, log in enumerate(rounds):
        ends_here = F.col("n") <= ARITY ** (BLOCK_LEVELS * (k + 1))
        found.append(log.filter(ends_here & (F.col("idx") == 0)).groupBy("tree", "n").agg(F.max_by("digest", "level").alias("digest")))
    return reduce(DataFrame.unionByName, found)


def _proofs_of_round(log: DataFrame, base: int, above: DataFrame, leaves: DataFrame) -> DataFrame:
    """``tree, n, idx, digest, top, proof, kept`` of ``leaves``; ``above`` has ``top``, the digest of the whole tree, and the
    proof of each block's last node."""
    zero = F.lit(0).cast("bigint")
    of_node = F.expr(f"shiftright(idx, cast(4 * ({base + BLOCK_LEVELS} - level) as int))")
    kinds = [
        above.select(F.lit(0).alias("kind"), "tree", "n", F.col("idx").alias("block"), zero.alias("at"), "proof", F.col("top").alias("digest")),
        log.select(F.lit(1).alias("kind"), "tree", "n", of_node.alias("block"), F.col("position").alias("at"), "digest"),
        leaves.select(F.lit(2).alias("kind"), "tree", "n", F.shiftright("idx", 4 * BLOCK_LEVELS).alias("block"), F.col("idx").alias("at"), "digest", "kept"),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, proofs, proof_above, top = {}, None, [], None
        for batch in batches:
            types = {name: batch.schema.field(name).type for name in ("proof", "kept")}
            for some in (batch.slice(start, 1024) for start in range(0, batch.num_rows, 1024)):
                out = []
                for kind, tree, n, block, at, proof, digest, kept in zip(*(column.to_pylist() for column in some.columns), strict=True):
                    if kind == 0:
                        nodes, proofs, proof_above, top = {}, None, proof, digest
                    elif kind == 1:
                        nodes[at] = digest
                    else:
                        proofs = proofs or block_proofs(n, base, block, proof_above, nodes)
                        out.append((tree, n, at, digest, top, proofs[at], kept))
                yield _batch(out, ["tree", "n", "idx", "digest", "top", "proof", "kept"], types)

    dealt = _dealt(rows.select("kind", "tree", "n", "block", "at", "proof", "digest", "kept"), "kind", "at")
    schema = T.StructType().add("tree", "long").add("n", "long").add("idx", "long").add("digest", "string").add("top", "string")
    return dealt.mapInArrow(read, schema.add("proof", above.schema["proof"].dataType).add("kept", leaves.schema["kept"].dataType))


def read_proofs(rounds: list[DataFrame], ends: DataFrame, leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``top`` and ``proof``; ``ends`` are ``tree, n, top, proof``: what each tree's last node adds to them."""
    above = None
    for k in reversed(range(len(rounds))):
        base = BLOCK_LEVELS * k
        ends_here = (F.col("n") <= ARITY ** (base + BLOCK_LEVELS)) & (F.col("n") > (ARITY**base if k else 0))
        whole = ends.filter(ends_here).select("tree", "n", F.lit(0).cast("bigint").alias("idx"), "top", "proof")
        above = whole if above is None else above.select(whole.columns).unionByName(whole)
        mine = rounds[k].filter(F.col("level") == base).withColumn("kept", F.lit(None).cast("int")) if k else leaves
        above = _proofs_of_round(rounds[k], base, above, mine)
    return above


@dataclass
class Manifest:
    """The log of a dataset, round by round, for the groups' trees and for the tree above them, and the leaves of both.

    ``leaves`` are ``tree, n, idx, digest, kept``, of the upper tree one per group, numbered as the trees are, with the
    group's number of rows as ``kept``.
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    upper_leaves: DataFrame
    upper_rounds: list[DataFrame]

    def log(self) -> DataFrame:
        """Every node once: ``tree, n, level, idx, position, digest``."""
        parts = [log.filter(F.col("level") > (BLOCK_LEVELS * k if k else -1)) for rounds in (self.rounds, self.upper_rounds) for k, log in enumerate(rounds)]
        return reduce(DataFrame.unionByName, parts)

    def root(self) -> DataFrame:
        """The digest of the dataset: one row ``n, digest``, none for an empty dataset; ``n`` is the number of groups."""
        return roots(self.upper_rounds).select("n", "digest")

    def proofs(self) -> DataFrame:
        """Every leaf with ``top``, its group's root, and ``proof``, the digests left and right of the way to the dataset's
        root, a level each."""
        whole = self.root().select(F.lit(UPPER_TREE).cast("bigint").alias("tree"), "n", F.col("digest").alias("top"), F.array().cast(_PROOF).alias("proof"))
        upper = read_proofs(self.upper_rounds, whole, self.upper_leaves)
        return read_proofs(self.rounds, upper.select(F.col("idx").alias("tree"), F.col("kept").alias("n"), F.col("digest").alias("top"), "proof"), self.leaves)


def leaf(fields: list[str], **instead: Column) -> Column:
    """The digest of a row: of each field its UTF-8 length, a colon and its value, or a dash."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[told(instead.get(name, F.col(name))) for name in fields]), 256)


def manifest(rows: DataFrame, group_col: str, id_col: str, fields: list[str], kept: Column) -> Manifest:
    """The manifest of ``rows``; ``kept`` is a struct that goes with each leaf."""
    taken = rows.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf(fields).alias("digest"), kept.alias("kept"))
    # Numbered where the number can't change any more.
    hashed = stored(taken.withColumn("row", F.monotonically_increasing_id()))
    ordered = hashed.orderBy("group", "id", "digest", "row").select("group", "digest", "kept")
    placed = stored(ordered.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))

    # A group's rows in a range are neighbours, so a place needs the rows of the ranges before, one number for each.
    cells = placed.groupBy("group", "range").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    of_group = W.partitionBy("group")
    before = F.coalesce(F.sum("size").over(of_group.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = stored(cells.withColumns({"before": before, "n": F.sum("size").over(of_group)}))
    groups = counted.filter("before = 0").select(F.col("group").isNotNull().alias("named"), "group", "n")
    numbered = in_order(groups, ["named", "group"], "tree").select(F.col("group").alias("of_group"), "tree")
    known = counted.join(numbered, F.col("group").eqNullSafe(F.col("of_group")))
    starts = known.select("tree", "n", F.col("group").alias("of_group"), F.col("range").alias("in_range"), (F.col("before") - F.col("first")).alias("shift"))
    here = (F.col("range") == F.col("in_range")) & F.col("group").eqNullSafe(F.col("of_group"))
    leaves = placed.join(starts, here).select("tree", "n", (F.col("at") + F.col("shift")).alias("idx"), "digest", "kept")

    sizes = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    rounds = append_log(leaves, sizes.most or 0)
    upper_leaves = roots(rounds).select(
        F.lit(UPPER_TREE).cast("bigint").alias("tree"), F.lit(sizes.groups).cast("bigint").alias("n"), F.col("tree").alias("idx"), "digest", F.col("n").alias("kept")
    )
    return Manifest(leaves, rounds, upper_leaves, append_log(upper_leaves, sizes.groups))


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and whether it holds for the documents as they were tampered with."""
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPER_EVERY)) == 0
    tampered = F.when(chosen, leaf(FIELDS, text=F.translate("text", UPPER.decode(), LOWER.decode())))
    made = manifest(documents(spark, sf_dir).select(FIELDS), "source", "doc_id", FIELDS, F.struct("doc_id", tampered.alias("tampered")))
    root = made.root().select("digest").scalar()
    found = made.proofs().select(F.col("kept.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("kept.tampered", "digest"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT *, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)
  ), 4294967295::BIGINT) AS BIGINT) AS crc32 FROM documents
), told AS (
  SELECT doc_id, source, crc32 % 5 = 0 AND crc32 IS NOT NULL AS chosen,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS original,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
  FROM crc
), hashed AS (
  SELECT doc_id, source, sha256(head || original) AS leaf, CASE WHEN chosen THEN sha256(head || lowered) ELSE sha256(head || original) END AS given FROM told
), leaves AS (
  SELECT *, row_number() OVER () AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed
), nodes AS (
  SELECT source, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, level, n, idx // 16
), subroots AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n_groups FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, place AS idx, n_groups AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, n, idx // 16
), siblings AS (
  SELECT a.source, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS left_of, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS right_of
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.source, a.level, a.idx
), upper_siblings AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS left_of, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS right_of
  FROM upper a JOIN upper b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.n > 1 GROUP BY a.level, a.idx
), steps AS (
  SELECT l.doc, s.level, s.left_of, s.right_of FROM leaves l JOIN siblings s ON l.source IS NOT DISTINCT FROM s.source AND l.idx // CAST(pow(16, s.level) AS BIGINT) = s.idx
  UNION ALL
  SELECT l.doc, r.height + s.level, s.left_of, s.right_of FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source
    JOIN upper_siblings s ON r.place // CAST(pow(16, s.level) AS BIGINT) = s.idx
), proofs AS (
  SELECT doc, count(*) AS levels, sha256(string_agg(left_of || right_of, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc
), climbs AS (
  SELECT doc, 0 AS level, given AS digest FROM leaves
  UNION ALL
  SELECT c.doc, c.level + 1, sha256(s.left_of || c.digest || s.right_of) FROM climbs c JOIN steps s ON c.doc = s.doc AND c.level = s.level
)
SELECT l.doc_id, l.leaf, r.subroot, u.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, c.digest AS folded_root, c.digest = u.digest AS verified
FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source LEFT JOIN proofs p ON l.doc = p.doc
  JOIN climbs c ON l.doc = c.doc AND c.level = coalesce(p.levels, 0) CROSS JOIN (SELECT digest FROM upper WHERE n = 1) u
"""
