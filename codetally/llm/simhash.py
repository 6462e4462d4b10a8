"""SimHash near-duplicates, linked through BK-trees.

A fingerprint has 64 bits; a bit is set if more than half of the hashes of a text's word shingles have it set. Two
fingerprints link at ``radius`` or fewer differing bits, and linked documents form components.

Fingerprints are first made distinct, so exact copies cost nothing more. Cut into ``radius + 1`` blocks of bits, two
linked fingerprints agree in at least one block: each fingerprint goes, once per block, to the shard its block's value
is dealt to. A shard holds about ``shard_size`` fingerprints. Its task builds a BK-tree of them - children keyed by
their Hamming distance to the parent - and looks every fingerprint up, following only edges within the radius. So each
lookup visits the few trees that can hold a partner instead of all trees, and no tree is sent to more than one task. A
block value shared by more than ``shard_size`` fingerprints is split into parts, and every two parts form a shard.
Shards return the links of a spanning forest, never all pairs.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other. Texts with
fewer words than a shingle are hashed whole. Null ids are never the least id of a component that has another. Repeated
rows are kept as often as they come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from codetally.llm.components import components
from codetally.llm.shared import LOWER_ASCII, as_row, cut, documents

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
SHARD_SIZE = 4096
_HASHES_AT_ONCE = 200_000
_LOOKUPS_AT_ONCE = 1024


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(first), _HASHES_AT_ONCE):
        hashes = b"".join([xxh64_digest(joined[i:j], seed) for i, j in zip(first[at : at + _HASHES_AT_ONCE], last[at : at + _HASHES_AT_ONCE])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        set_bits += bits.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_bits > len(first)).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([fingerprint(t, shingle_words, seed) for t in column.to_pylist()], pa.int64())

    return F.arrow_udf(of, "bigint").asNondeterministic()(text)


class BKTree:
    """A BK-tree over distinct 64-bit numbers; ``child[i, d]`` is the child of node ``i`` at distance ``d``, or -1."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        n = len(numbers)
        self.child = np.full((n, 65), -1, np.int32)
        # All nodes sink at once: each compares itself to the node it has reached, and the first to arrive at a free
        # place takes it, while the others go on from there.
        sinking = np.arange(1, n, dtype=np.int32)
        at = np.zeros(len(sinking), np.int32)
        while len(sinking):
            distance = np.bitwise_count(numbers[sinking] ^ numbers[at])
            place = at.astype(np.int64) * 65 + distance
            _, first = np.unique(place, return_index=True)
            taken = self.child.reshape(-1)
            free = first[taken[place[first]] < 0]
            taken[place[free]] = sinking[free]
            at = taken[place]
            stays = at == sinking
            sinking, at = sinking[~stays], at[~stays]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at most ``radius`` apart, both as positions."""
        who, where = [], []
        query = np.arange(len(queries), dtype=np.int32)
        node = np.zeros(len(queries), np.int32)
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.numbers[node]).astype(np.int32)
            near = distance <= radius
            who.append(query[near])
            where.append(node[near])
            followed = [self.child[node, np.clip(distance + step, 0, 64)] for step in range(-radius, radius + 1)]
            # Clipping may name an edge twice; it is followed once.
            inside = [(distance + step >= 0) & (distance + step <= 64) for step in range(-radius, radius + 1)]
            going = [(child >= 0) & real for child, real in zip(followed, inside, strict=True)]
            query = np.concatenate([query[go] for go in going])
            node = np.concatenate([child[go] for child, go in zip(followed, going, strict=True)])
        return np.concatenate(who), np.concatenate(where)


def forest(numbers: np.ndarray, radius: int) -> np.ndarray:
    """For each number, the position of its representative among those it reaches in steps of at most ``radius`` bits."""
    tree = BKTree(numbers)
    root = np.arange(len(numbers))
    for start in range(0, len(numbers), _LOOKUPS_AT_ONCE):
        query, node = tree.within(numbers[start : start + _LOOKUPS_AT_ONCE], radius)
        query = query + start
        later = query < node
        query, node = query[later], node[later]
        while len(query):
            a, b = root[query], root[node]
            different = a != b
            query, node, a, b = query[different], node[different], a[different], b[different]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root[root], root):
                root = root[root]
    return root


def _block_values(fingerprint_col: str, blocks: int) -> Column:
    """The value of each block of bits, as an array of ``struct(block, value)``."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    values = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        mask = (1 << (high - low)) - 1
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        values.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint_col, low).bitwiseAND(F.lit(mask)).alias("value")))
    return F.array(*values)


def near_links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links ``a, b`` that join the distinct fingerprints in column ``fp`` exactly as all near pairs would."""
    blocks = radius + 1
    shards = max(1, math.ceil(distinct.count() * blocks / shard_size))
    dealt = distinct.select("fp", F.explode(_block_values("fp", blocks)).alias("at")).select("fp", "at.block", "at.value")
    crowded = (
        dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_size)
        .select("block", "value", F.ceil(F.col("n") / (shard_size // 2)).alias("parts"))
    )
    marked = dealt.join(crowded, ["block", "value"], "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    plain = marked.filter("parts IS NULL").select("fp", F.pmod(F.xxhash64("block", "value"), F.lit(shards)).alias("shard"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    split = (
        marked.filter("parts IS NOT NULL").select("fp", "block", "value", part.alias("part"), other)
        .select("fp", F.xxhash64(F.lit("split"), "block", "value", F.least("part", "other"), F.greatest("part", "other")).alias("shard"))
    )

    def link(table: pa.Table) -> pa.Table:
        numbers = np.unique(table["fp"].to_numpy()).view(np.uint64)
        root = forest(numbers, radius)
        tied = np.flatnonzero(root != np.arange(len(numbers)))
        return pa.table({"a": numbers[tied].view(np.int64), "b": numbers[root[tied]].view(np.int64)})

    return plain.unionByName(split).groupBy("shard").applyInArrow(link, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    seed: int = SEED,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """One row per document: ``id_col``, ``text_hash``, ``fp`` (signed), ``root`` (a fingerprint that names the component)
    and ``component_id``, the least id it reaches."""
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_hash"), fingerprints(F.col(text_col), shingle_words, seed).alias("fp"))
    rows = cut(rows)
    distinct = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = components(near_links(distinct.select("fp"), radius, shard_size)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(id_col, "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without all but one of each component: its least id stays, one row of it, all columns kept.

    Of several rows with the least id, or of a component without ids, the one with the least text hash stays.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    best = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    chosen = found.groupBy("root").agg(F.min(best).alias("best"))
    # The same three columns join the texts and find the copies of a row, so that texts are moved once.
    key = ["kept_id", "kept_null", "kept_hash"]

    def keyed(id_of: Column, hash_of: Column) -> list[Column]:
        return [F.coalesce(id_of.cast("string"), F.lit("")).alias(key[0]), id_of.isNull().alias(key[1]), hash_of.alias(key[2])]

    keys = chosen.select(*keyed(F.col("best.id"), F.col("best.hash"))).distinct()
    kept = docs.select(as_row(docs).alias("row"), *keyed(F.col(id_col), F.xxhash64(text_col))).join(keys, key)
    once = W.partitionBy(key).orderBy(F.lit(0))
    return kept.withColumn("copy", F.row_number().over(once)).filter("copy = 1").select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
