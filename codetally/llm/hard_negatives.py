"""Hard negatives by a secondary-sort shuffle.

Anchors are scored against all rows tile by tile: a bounded part of the anchors against a bounded block of the rows. A
pair's key is packed into bytes that sort as wanted: anchor, descending score, id. The pairs of an anchor are brought to
one partition and sorted there by their keys, and an iterator reads them once, from the best score down: one of the
anchor's first positives opens the window of scores its negatives may have, and a row of another label is given to each
open window that still takes one. The iterator keeps the open windows of one anchor and nothing else.

Pairs are thinned where they are scored, by what can't be part of the result: of a block, only an anchor's ``positives``
best rows of its own label can be among its first positives. That pass tells every anchor's windows; in a second one,
only the first ``negatives`` rows of a block in each window can be among those returned. So what is shuffled are a few
pairs for each anchor and block, not all.

Scores are exact. Whole numbers that a double holds are multiplied as doubles; where sums could pass 2^53, Python's own
integers take over.

Defined cases: a row without id, label or vector, or with a null or non-finite component takes no part, be it as anchor.
Vectors are compared with vectors of their own length only. Rows of one id are never each other's positives or
negatives; an anchor that comes twice with the same label and vector is asked once, other repeated rows count each.
A score beyond a long ranks as it is and is returned as the nearest long. A score of zero opens a window for zero alone,
rows before it included; a negative one opens none. Columns other than id, vector and label take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.shared import descending, from_descending, nearest_long, stored, whole_numbers

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these parts of the positive's, in hundredths.
LEAST, MOST = 50, 95
RELABEL_EVERY, LABELS = 7, 10
#: Rows of a tile, and anchors of a tile.
BLOCK_ROWS = 16_384
PART_ANCHORS = 2_048
_LONG = 1 << 63

def pair_key(anchor: bytes, score: int, other_label: bool, row_id: int) -> bytes:
    """Anchor, descending score, id; of equal scores those of the anchor's label come first, so that a window is open
    before the first row it may take."""
    return anchor + descending(score) + bytes([other_label]) + (row_id + _LONG).to_bytes(8, "big")


def unpacked(key: bytes) -> tuple[bytes, int, bool, int]:
    return key[:16], from_descending(key[16:-9]), key[-9] == 1, int.from_bytes(key[-8:], "big") - _LONG


def window(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The lowest and the highest score a negative may have beside a positive of this score."""
    return -(-least * score // 100), most * score // 100


class Scorer:
    """Exact inner products of the whole numbers ``floor(scale * x)`` of many rows with those of one vector."""

    def __init__(self, vectors: np.ndarray, scale: int):
        self.scale, self.dims = scale, vectors.shape[1]
        with np.errstate(over="ignore"):
            self.values = np.floor(vectors * scale)
        self.most = np.abs(self.values).max(1, initial=0)
        self.vectors = vectors

    def scores(self, vector: np.ndarray) -> np.ndarray:
        """Doubles where all sums are exact, else Python's integers."""
        with np.errstate(over="ignore"):
            value = np.floor(vector * self.scale)
            bound = self.dims * self.most * np.abs(value).max(initial=0)
        exact = bound < 1 << 53
        if exact.all():
            return self.values @ value
        scores = np.empty(len(self.values), object)
        scores[exact] = [int(s) for s in self.values[exact] @ value] if exact.any() else []
        whole = whole_numbers(vector, self.scale)
        for row in np.flatnonzero(~exact):
            scores[row] = sum(a * b for a, b in zip(whole_numbers(self.vectors[row], self.scale), whole, strict=True))
        return scores


def first_rows(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of ``rows`` by descending score, then id."""
    if len(rows) > 4 * k:
        least = np.sort(scores[rows])[-k] if scores.dtype == object else np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= least]
    return rows[sorted(range(len(rows)), key=lambda at: (-scores[rows[at]], ids[rows[at]]))[:k]] if len(rows) else rows


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if dims else np.empty(0)
    return flat.astype(np.float64).reshape(len(column), dims)


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    taken = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & finite)
    return taken.select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.size(vector_col).alias("dims"),
    )


def _by_anchor(keys: DataFrame) -> DataFrame:
    """All pairs of an anchor in one partition, in the order of their keys."""
    return keys.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column = "label",
    anchor_every: int = ANCHOR_EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    part_anchors: int = PART_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every row whose id is divisible
    by ``anchor_every`` and each of its first positives, the first negatives in the positive's window."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    # Numbered in written tables, so that a row is dealt to the same tile whenever a task is run again.
    valid = stored(_vectors(rows, id_col, vector_col, label).withColumn("row", F.monotonically_increasing_id()))
    chosen = valid.filter(F.pmod("id", F.lit(anchor_every)) == 0).drop("row").distinct()
    anchors = stored(chosen.withColumn("row", F.monotonically_increasing_id()))
    size = valid.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dims"), F.lit(1)).alias("dims")).first()
    # Tiles of long vectors have fewer rows.
    narrow = max(1, min(block_rows, (1 << 21) // max(1, size.dims)))
    blocks = max(1, math.ceil(size.n / narrow))
    parts = max(1, math.ceil(anchors.count() / min(part_anchors, narrow)))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    tile = ["dims", "block", "part"]
    block, part = (F.pmod(F.xxhash64("row"), F.lit(n)).cast("int") for n in (blocks, parts))
    dealt_rows = valid.select("id", "label", "vector", "dims", block.alias("block"), every(parts, "part")).groupBy(tile)

    def scored(anchors: DataFrame, pick) -> DataFrame:
        """The keys of the pairs that ``pick`` chooses in each tile."""

        def score(of_rows: pa.Table, of_anchors: pa.Table) -> pa.Table:
            keys = []
            if of_rows.num_rows and of_anchors.num_rows:
                dims = of_rows["dims"][0].as_py()
                scorer = Scorer(_matrix(of_rows["vector"], dims), scale)
                ids, labels = of_rows["id"].to_numpy(), of_rows["label"].to_numpy()
                for at, vector in enumerate(_matrix(of_anchors["vector"], dims)):
                    one = of_anchors.slice(at, 1)
                    anchor_id, row = one["id"][0].as_py(), one["row"][0].as_py()
                    name = (anchor_id + _LONG).to_bytes(8, "big") + row.to_bytes(8, "big")
                    scores, others = scorer.scores(vector), ids != anchor_id
                    alike = labels == one["label"][0].as_py()
                    for picked, other_label in pick(scores, ids, alike & others, ~alike & others, one):
                        keys += [pair_key(name, int(scores[i]), other_label, int(ids[i])) for i in picked]
            return pa.table({"key": pa.array(keys, pa.binary())})

        dealt_anchors = anchors.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt_rows.cogroup(dealt_anchors.groupBy(tile)).applyInArrow(score, "key binary")

    def best_alike(scores, ids, alike, different, anchor):
        yield first_rows(scores, ids, np.flatnonzero(alike), positives), False

    def first_in_windows(scores, ids, alike, different, anchor):
        picked = set()
        for score in {unpacked(key)[1] for key in anchor["keys"][0].as_py()}:
            least, most = window(score)
            picked.update(first_rows(scores, ids, np.flatnonzero(different & (scores >= least) & (scores <= most)), negatives).tolist())
        yield sorted(picked), True

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading, n = None, 0
        for batch in batches:
            kept = []
            for key in batch["key"].to_pylist():
                reading, n = key[:16], n + 1 if key[:16] == reading else 1
                if n <= positives:
                    kept.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["key"])

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading, windows = None, []
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        for batch in batches:
            found = []
            for key in batch["key"].to_pylist():
                anchor, score, other_label, row_id = unpacked(key)
                if anchor != reading:
                    reading, windows = anchor, []
                if not other_label:
                    windows.append([*window(score), 0, row_id, score])
                    continue
                for at in windows:
                    if at[0] <= score <= at[1] and at[2] < negatives:
                        at[2] += 1
                        found.append((int.from_bytes(anchor[:8], "big") - _LONG, at[3], at[2], row_id, nearest_long(at[4]), nearest_long(score)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 6, names)

    alike = stored(_by_anchor(scored(anchors, best_alike)).mapInArrow(first_keys, "key binary"))
    name = F.substring("key", 1, 16)
    listed = alike.groupBy(F.conv(F.hex(F.substring(name, 9, 8)), 16, 10).cast("bigint").alias("row")).agg(F.collect_list("key").alias("keys"))
    different = scored(anchors.join(listed, "row"), first_in_windows)
    result = _by_anchor(alike.unionByName(different)).mapInArrow(
        mined, "anchor_id bigint, positive_id bigint, rank bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    return result.withColumn("rank", F.col("rank").cast("int"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, after the labels of every seventh were changed."""
    label = F.col("label").cast("bigint")
    changed = F.when(F.pmod("vec_id", F.lit(RELABEL_EVERY)) == 0, (label + 1) % LABELS).otherwise(label)
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), label_col=changed)


ORACLE_SQL = r"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v, row_number() OVER () AS row
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, a.anchor, r.vec_id, r.row, r.label = a.label AS alike, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM (SELECT vec_id, label, v, min(row) AS anchor FROM whole WHERE vec_id % 50 = 0 GROUP BY vec_id, label, v) a
  JOIN whole r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
), positives AS (
  SELECT anchor_id, anchor, vec_id AS positive_id, row AS positive, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
