"""Rows written to the shared folder of the cluster, so that what follows starts from them."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Name a folder that all executors share in spark.checkpoint.dir.")
    return tempfile.mkdtemp(prefix="codetally-")


def scratch(spark: SparkSession) -> str:
    """A new folder for written tables."""
    return os.path.join(shared_folder(spark), f"codetally-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once and read from there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ranges in which rows are dealt out at least, so that each has few different values.
LEAST_RANGES = 64


def alike_together(df: DataFrame, ties: list[str], *order_cols: str) -> DataFrame:
    """The rows dealt out by ranges of ``order_cols``, a value that comes often by ranges of ``ties`` as well.

    Long values worked out from these columns are then few and different ones in a task, so that a columnar file holds each
    once, in its dictionary, rather than once for every row. Rows are moved before the long values are made.
    """
    ranges = max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(ranges, *[F.col(c) for c in (*order_cols, *[c for c in ties if c not in order_cols])])


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def _arrow_type(kind: str) -> pa.DataType:
    inner = kind.removeprefix("array<")
    return _ARROW[kind] if inner == kind else pa.list_(_arrow_type(inner.removesuffix(">")))


def carried(spark: SparkSession, lists: dict[str, tuple[str, list]]) -> DataFrame:
    """Lists, given by name with their type, as one struct in a table of one row; its ``scalar()`` travels with the tasks.

    A literal would be printed whole, wherever it is used, into every plan and every update of a plan that Spark hands to
    its listeners and keeps on the driver. Of this table a plan shows its name.
    """
    fields = [(name, _arrow_type(kind)) for name, (kind, _) in lists.items()]
    row = pa.array([{name: values for name, (_, values) in lists.items()}], pa.struct(fields))
    return spark.createDataFrame(pa.table({"lists": row}))


#: Ranges whose totals are added up together before the totals of such groups are.
RANGES_AT_ONCE = 1000


def totals_before(sizes: DataFrame, key_col: str = "_range", size_col: str = "_size") -> DataFrame:
    """``key_col, _before``: the sizes of all smaller keys together, for keys that are whole numbers from 0.

    Sums run inside groups of keys, and over one total per group, so that no task holds more than a group of each.
    """
    group = F.floor(F.col(key_col) / RANGES_AT_ONCE)
    grouped = sizes.select(key_col, size_col, group.alias("_group"))
    until_here = W.orderBy(key_col).rowsBetween(W.unboundedPreceding, -1)
    inside = grouped.select(key_col, "_group", F.coalesce(F.sum(size_col).over(until_here.partitionBy("_group")), F.lit(0)).alias("_inside"))
    totals = grouped.groupBy("_group").agg(F.sum(size_col).alias("_total"))
    earlier = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    groups = totals.select("_group", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    return inside.join(groups, "_group").select(key_col, (F.col("_inside") + F.col("_earlier")).alias("_before"))


def order_of(df: DataFrame, order_cols: list[str], *last: str) -> list[Column]:
    """By ``order_cols``, nulls last, then by all other columns that have an order."""
    others = [f.name for f in df.schema if f.name not in (*order_cols, *last) and not _unordered(f.dataType)]
    return [F.asc_nulls_last(F.col(f"`{c}`")) for c in (*order_cols, *others, *last)]


def _numbered(df: DataFrame) -> DataFrame:
    """The rows written with a number of their own, so that rows equal in everything can be dealt apart."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()))


def in_order(df: DataFrame, order_cols: list[str], position_col: str = "_position") -> DataFrame:
    """Every row with its place, from 0, in the order of ``order_cols``, nulls last.

    Rows equal there are ordered by all their other columns, so places are settled but for rows equal in everything.
    The table is dealt out by ranges and sorted inside each, rows are numbered inside their range, and the sizes of
    the ranges before are added: no task holds more than a range, however often a key or a whole row comes.
    """
    numbered = _numbered(df)
    ordered = numbered.orderBy(order_of(df, order_cols) + [F.asc("_row")])
    # Written, because another run of the same sort could cut the ranges elsewhere.
    placed = written(ordered.select(*df.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = sizes.select("_range", "_first").join(totals_before(sizes), "_range")
    position = F.col("_before") + F.col("_at") - F.col("_first")
    # One row per partition of the sort, whatever the input.
    return placed.join(F.broadcast(before), "_range").withColumn(position_col, position).drop("_range", "_at", "_first", "_before")


def split_by_rank(df: DataFrame, order_cols: list[str], first: int, after: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows whose place in the order of ``in_order`` is from ``first`` to before ``after``, and all others.

    Rows are dealt out by ranges but not sorted. A range that lies wholly on one side is not looked into; only in those
    that hold the first or the last place are rows ranked.
    """
    after = (1 << 62) if after is None else after
    numbered = _numbered(df)
    dealt = written(numbered.repartitionByRange(*order_of(df, order_cols), F.asc("_row")).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    spans = sizes.join(totals_before(sizes), "_range").select("_range", "_before", (F.col("_before") + F.col("_size")).alias("_until"))
    whole = (F.col("_before") >= first) & (F.col("_until") <= after)
    apart = (F.col("_until") <= first) | (F.col("_before") >= after)
    side = spans.select("_range", "_before", F.when(whole, "inside").when(apart, "outside").otherwise("cut").alias("_side"))
    known = dealt.join(F.broadcast(side), "_range")
    ranked = known.filter("_side = 'cut'").withColumn(
        "_place", F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order_of(df, order_cols), F.asc("_row"))) - 1
    )
    chosen = F.col("_place").between(first, after - 1)

    def half(name: str, rows: Column) -> DataFrame:
        return known.filter(F.col("_side") == name).select(df.columns).unionByName(ranked.filter(rows).select(df.columns))

    return half("inside", chosen), half("outside", ~chosen)


def _unordered(kind: T.DataType) -> bool:
    """Whether rows can't be sorted by a column of this type."""
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))
