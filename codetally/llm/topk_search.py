"""Exact top-k search by inner product over a bit-sliced index.

Every component becomes a whole number, ``floor(scale * x)``. Vectors are dealt into blocks of about ``block_rows``,
and a block's index holds, for each component, bitmaps of the higher bits of its distance from the block's least value
(slices). For a query, the slices are added as bitmaps, weighted by the higher bits of the query's own components: a
tree of full adders leaves one bitmap per bit of the sum, which is a lower bound of the score with a known largest
error. The k-th largest bound is found from the most significant slice downward; the rows that can still reach it are
resolved exactly. Each block gives its best k, the best of all blocks are the answer.

Vectors and queries meet in tiles: some blocks of vectors beside a bounded number of queries, each grouped by tile, so
that nothing of either passes through the driver. A tile indexes one block after the other. Queries are the smaller side
and are repeated for every tile of vectors; vectors are moved once for every tile of queries, mostly one. With many
blocks a tile has several, since what is moved grows with the number of tiles.

The few vectors with a component so large that a score could pass a long are kept beside the slices and resolved with
integers of any size, as are queries that have one.

Defined cases: a vector that is null or has a null or non-finite component takes no part, nor does a row without id. A
score beyond a long ranks as it is and is returned as the nearest long. Vectors are compared with vectors of their own length only. Rows of
one id are never each other's answer; a query that comes twice with the same vector is asked once. Equal scores rank by
id. Columns other than id and vector take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codetally.llm.shared import descending, nearest_long, stored, whole_numbers

SCALE = 1024
K = 10
QUERY_EVERY = 100
BLOCK_ROWS = 8192
#: Queries of a tile, and most of its blocks; it has fewer where there would be less than ``LEAST_TILES``.
QUERIES_AT_ONCE = 8192
BLOCKS_AT_ONCE = 8
LEAST_TILES = 64
#: Bits kept of each component, and of each query component.
SLICES = 6
WEIGHT_BITS = 5
#: Largest component of the slices, less for very long vectors.
MOST_VALUE = 1 << 26


def narrow_limit(dims: int) -> int:
    """The largest component with which no sum of products of so many can pass a long."""
    return min(MOST_VALUE, math.isqrt((1 << 62) // max(1, dims)))


class BitSlicedIndex:
    """Slices of a matrix of whole numbers, one bit per row in each."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.n, self.low = n, values.min(0)
        spread = values.max(0) - self.low
        bits = np.array([int(s).bit_length() for s in spread], np.int64)
        self.dropped = np.maximum(bits - SLICES, 0)
        self.most = (np.int64(1) << bits) - 1
        above = (values - self.low) >> self.dropped
        self.words = (n + 63) // 64
        self.slices = np.zeros((dims, SLICES, self.words), np.uint64)
        for bit in range(SLICES):
            self.slices[:, bit] = self._bitmaps(((above >> bit) & 1).astype(bool).T)
        self.kept = np.minimum(bits, SLICES)
        self.all = self._bitmaps(np.ones((1, n), bool))[0]

    def _bitmaps(self, flags: np.ndarray) -> np.ndarray:
        packed = np.zeros((len(flags), self.words * 8), np.uint8)
        some = np.packbits(flags, axis=1, bitorder="little")
        packed[:, : some.shape[1]] = some
        return packed.view(np.uint64)

    def weighted_sum(self, query: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """Slices of a lower bound of every row's score above the least one thinkable, lowest first, the significance of
        the first, and the most by which the bound can fall short."""
        weight = np.abs(query)
        spare = max(0, int(weight.max(initial=0)).bit_length() - WEIGHT_BITS)
        coarse = weight >> spare
        rest = weight - (coarse << spare)
        short = int((rest * self.most + (weight - rest) * ((np.int64(1) << self.dropped) - 1)).sum())
        # Where the query is negative, a value's distance from the greatest counts: the flipped slices.
        at: dict[int, list[np.ndarray]] = {}
        for bit in range(WEIGHT_BITS):
            chosen = (coarse >> bit) & 1 == 1
            for level in range(SLICES):
                mine = chosen & (level < self.kept)
                for dropped in np.unique(self.dropped[mine]):
                    some = np.flatnonzero(mine & (self.dropped == dropped))
                    maps = self.slices[some, level]
                    maps[query[some] < 0] ^= self.all
                    at.setdefault(level + bit + spare + int(dropped), []).append(maps)
        if not at:
            return [], 0, short
        first, result = min(at), []
        place = first
        while place in at or any(p > place for p in at):
            maps = np.concatenate(at.pop(place)) if place in at else np.zeros((1, self.words), np.uint64)
            carried = []
            while len(maps) > 2:
                m = len(maps) // 3
                a, b, c = maps[:m], maps[m : 2 * m], maps[2 * m : 3 * m]
                half = a ^ b
                carried.append((a & b) | (half & c))
                maps = np.concatenate([half ^ c, maps[3 * m :]])
            if len(maps) == 2:
                carried.append((maps[:1] & maps[1:]))
                maps = maps[:1] ^ maps[1:]
            result.append(maps[0])
            if carried:
                at.setdefault(place + 1, []).extend(carried)
            place += 1
        return result, first, short

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows, others than the query's own."""
        alive = self.all & ~self._bitmaps((self.ids == query_id)[None, :])[0]
        sums, first, short = self.weighted_sum(query)
        if int(np.bitwise_count(alive).sum()) > k and sums:
            # The k-th largest sum, from the most significant slice downward.
            chosen, open_rows, kth = 0, alive, 0
            for place in range(len(sums) - 1, -1, -1):
                high = open_rows & sums[place]
                n = int(np.bitwise_count(high).sum())
                if chosen + n >= k:
                    open_rows, kth = high, kth | 1 << place
                else:
                    chosen, open_rows = chosen + n, open_rows & ~sums[place]
            # Rows whose bound, with its largest error added, reaches that of the k-th row.
            least = max(0, kth - -(-short // (1 << first)))
            above, equal = np.zeros_like(alive), alive
            for place in range(len(sums) - 1, -1, -1):
                if least >> place & 1:
                    equal = equal & sums[place]
                else:
                    above = above | (equal & sums[place])
                    equal = equal & ~sums[place]
            alive = above | equal
        rows = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[: self.n])
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[order]], scores[order]


class Block:
    """The index of a block's vectors, and the few with components too large for it as they are."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: int):
        with np.errstate(over="ignore"):
            values = np.floor(vectors * scale)
        self.scale, self.limit = scale, narrow_limit(vectors.shape[1])
        wide = np.abs(values).max(1, initial=0) > self.limit
        self.index = BitSlicedIndex(ids[~wide], values[~wide].astype(np.int64)) if not wide.all() else None
        self.wide_ids, self.wide = ids[wide], vectors[wide]

    def _exact(self, query_id: int, query: list[int], ids: np.ndarray, rows: list[list[int]]) -> list[tuple[int, int]]:
        return [(-sum(a * b for a, b in zip(query, row, strict=True)), i) for i, row in zip(ids.tolist(), rows, strict=True) if i != query_id]

    def best(self, query_id: int, vector: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The best ``k`` rows other than the query's own, as negated score and id."""
        query, found = whole_numbers(vector, self.scale), []
        if len(self.wide):
            found += self._exact(query_id, query, self.wide_ids, [whole_numbers(row, self.scale) for row in self.wide])
        if self.index and max(map(abs, query), default=0) <= self.limit:
            ids, scores = self.index.best(query_id, np.array(query, np.int64), k)
            found += zip((-scores).tolist(), ids.tolist(), strict=True)
        elif self.index:
            found += self._exact(query_id, query, self.index.ids, self.index.values.tolist())
        return sorted(found)[:k]


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """The vectors of a table, one per row."""
    flat = table["vector"].combine_chunks().flatten().to_numpy() if dims else np.empty(0)
    return flat.reshape(table.num_rows, dims)


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    query_every: int = QUERY_EVERY,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the best rows for every row whose id is divisible by ``query_every``."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    # Floats stay so, which halves what is moved; they are the same numbers when read as doubles.
    kind = "array<float>" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "array<double>"
    valid = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("vector"), F.size(vector_col).alias("dims")
    )
    # Numbered in written tables: a task that is run again deals its rows as before, and rows of one id are dealt apart.
    valid = stored(valid.withColumn("row", F.monotonically_increasing_id()))
    asked = stored(valid.filter(F.pmod("id", F.lit(query_every)) == 0).drop("row").distinct().withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(valid.count() / block_rows))
    together = max(1, min(BLOCKS_AT_ONCE, blocks // LEAST_TILES))
    tiles, parts = math.ceil(blocks / together), max(1, math.ceil(asked.count() / QUERIES_AT_ONCE))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = valid.select("dims", dealt(blocks).alias("block"), "id", "vector").select(
        "dims", F.floor(F.col("block") / together).cast("int").alias("tile"), each(parts).alias("part"), "block", "id", "vector"
    )
    queries = asked.select("dims", each(tiles).alias("tile"), dealt(parts).alias("part"), "id", "vector")

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[tuple[int, int]]] = [[] for _ in range(queries.num_rows)]
        if vectors.num_rows and queries.num_rows:
            dims = vectors["dims"][0].as_py()
            rows, asked = (_matrix(table, dims) for table in (vectors, queries))
            ids, block_of, asked_ids = vectors["id"].to_numpy(), vectors["block"].to_numpy(), queries["id"].to_numpy().tolist()
            for number in np.unique(block_of):
                mine = block_of == number
                block = Block(ids[mine], rows[mine].astype(np.float64), scale)
                for i, query_id in enumerate(asked_ids):
                    found[i] = sorted(found[i] + block.best(query_id, asked[i].astype(np.float64), k))[:k]
        flat = [(query_id, i, -minus) for query_id, best in zip(queries["id"].to_pylist(), found, strict=True) for minus, i in best]
        return pa.table({
            "query_id": pa.array([query_id for query_id, _, _ in flat], pa.int64()),
            "id": pa.array([i for _, i, _ in flat], pa.int64()),
            "score": pa.array([nearest_long(score) for _, _, score in flat], pa.int64()),
            "order": pa.array([descending(score) for _, _, score in flat], pa.binary()),
        })

    at = ["dims", "tile", "part"]
    found = candidates.groupBy(*at).cogroup(queries.groupBy(*at)).applyInArrow(search, "query_id bigint, id bigint, score bigint, order binary")
    order = W.partitionBy("query_id").orderBy("order", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth one."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_SQL = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM whole WHERE vec_id % 100 = 0) q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
