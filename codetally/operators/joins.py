"""Joins on the record id. Null ids match each other, as they do in the data frames users come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.functions.sets import empty_set


def join_on_id(
    left: DataFrame, right: DataFrame, on: str | list[str] = "unique_id", how: str = "inner", nulls_match: bool = True
) -> DataFrame:
    """Equi-join on the id. No side is forced to be broadcast: the planner decides by size, and splits
    skewed keys at run time.

    Where ids are known not to be null, ``nulls_match=False`` lets the join use the partitioning an
    aggregation by the same id has already made.
    """
    on = [on] if isinstance(on, str) else on
    if not nulls_match:
        return left.join(right, on, how)
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in on})
    condition = F.lit(True)
    for name in on:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_r_{name}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{name}" for name in on])


#: An id with more than this share of the rows is hot, and is dealt out in pieces of about this share.
HOT_PIECE = 1 / 400
#: How many values the sketch that finds them keeps; the shares it tells are wrong by less than a tenth of a piece.
HOT_TRACKED = 1 << 14


def hot_ids(df: DataFrame, on: list[str]) -> DataFrame:
    """``_hot_id, _pieces``: the ids that come in more than ``HOT_PIECE`` of the rows, and in how many pieces to deal them.

    One aggregation: a sketch of the most frequent ids, of bounded size, merged like any partial result. There are fewer
    hot ids than pieces in the whole, so the table is small whatever the input.
    """
    most = round(1 / HOT_PIECE)
    top = F.expr(f"approx_top_k(_key, {most}, {HOT_TRACKED})").alias("_top")
    found = df.select(id_text(on).alias("_key")).agg(top, F.count(F.lit(1)).alias("_rows"))
    each = found.select("_rows", F.inline("_top"))
    return each.filter(F.col("count") > F.col("_rows") * HOT_PIECE).select(
        F.col("item").alias("_hot_id"), F.ceil(F.col("count") / (F.col("_rows") * HOT_PIECE)).cast("int").alias("_pieces")
    )


def id_text(on: list[str]) -> Column:
    """An id as one text, by which hot ids are told; ids that look alike in it are hot together, on both sides."""
    return F.concat_ws(" ", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in on])


def join_salted(left: DataFrame, right: DataFrame, on: str | list[str] = "unique_id") -> DataFrame:
    """Inner equi-join, nulls matching each other, in which the rows of ``left`` with a hot id are dealt over several tasks.

    Only rows of ``right`` with a hot id are copied, once per piece. What piece a row of ``left`` is in follows from its
    values, so a task that is run again deals it as before; rows equal in everything should be counted first.
    """
    on = [on] if isinstance(on, str) else on
    pieces = F.broadcast(hot_ids(left, on))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_id", id_text(on)).join(pieces, F.col("_id") == F.col("_hot_id"), "left").drop("_hot_id", "_id")

    piece = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("_pieces"))).otherwise(0).cast("int")
    copies = F.explode(F.when(F.col("_pieces").isNotNull(), F.sequence(F.lit(0), F.col("_pieces") - 1)).otherwise(F.array(F.lit(0))))
    dealt = marked(left).withColumn("_piece", piece).drop("_pieces")
    copied = marked(right).withColumn("_piece", copies).drop("_pieces")
    return join_on_id(dealt, copied, [*on, "_piece"]).drop("_piece")


def join_repeated_ids(left: DataFrame, right: DataFrame, on: str | list[str] = "unique_id") -> DataFrame:
    """Inner equi-join of ids that may repeat or be null. Adaptive execution, the default, splits skewed partitions of such a
    join when it sees them; where it is off, hot ids are looked for beforehand and dealt over several tasks."""
    conf = left.sparkSession.conf
    splits = all(conf.get(key) == "true" for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"))
    return join_on_id(left, right, on) if splits else join_salted(left, right, on)


def override_from_side(
    main: DataFrame, side: DataFrame, id_col: str, value_col: str, nulls_match: bool = True
) -> DataFrame:
    """Full outer join in which the side table's value wins where it has one.

    Written as a left join plus the side-only rows, so that a small side table can be broadcast and a
    hot id of the main table can be split; a full outer join allows neither.
    """
    other = side.withColumnRenamed(value_col, "_side_value")
    joined = join_on_id(main, other, id_col, "left", nulls_match)
    matched = joined.withColumn(value_col, F.coalesce("_side_value", value_col)).drop("_side_value")
    side_ids = side.select(id_col).distinct()
    known = join_on_id(main.select(id_col), side_ids, id_col, "left_semi", nulls_match).distinct()
    unmatched = join_on_id(side, known, id_col, "left_anti", nulls_match)
    return matched.unionByName(unmatched, allowMissingColumns=True)


def override_unique(main: DataFrame, side: DataFrame | None, id_col: str, value_col: str) -> DataFrame:
    """The same where ids are unique in either table, in one grouping of both and without a join.

    An id that is null, or comes twice in a table, stops the job.
    """
    both = main.select(id_col, F.col(value_col).alias("_main"), F.lit(None).cast("string").alias("_side"), F.lit(False).alias("_is_side"))
    if side is not None:
        both = both.unionByName(side.select(id_col, F.lit(None).cast("string").alias("_main"), F.col(value_col).alias("_side"), F.lit(True).alias("_is_side")))
    grouped = both.groupBy(id_col).agg(
        F.max("_main").alias("_main"), F.max("_side").alias("_side"),
        F.greatest(F.count_if("_is_side"), F.count_if(~F.col("_is_side"))).alias("_copies"),
    )
    broken = F.raise_error(F.concat(F.lit(f"Ids were promised to be unique, but this {id_col} is not: "), F.col(id_col).cast("string")))
    kept = grouped.filter(F.when(F.col("_copies") > 1, broken.cast("boolean")).otherwise(True))
    # Part of the id itself: a join would drop null ids before any filter sees them.
    no_null = F.raise_error(F.lit(f"Ids were promised to be unique, but a {id_col} is null.")).cast(main.schema[id_col].dataType)
    return kept.select(F.coalesce(F.col(id_col), no_null).alias(id_col), F.coalesce("_side", "_main").alias(value_col))


def attach_final_codes(df: DataFrame, final: DataFrame, final_col: str, id_col: str = "unique_id") -> DataFrame:
    """Left join of final codes; a record without any gets the empty set."""
    return join_on_id(df, final, id_col, "left").withColumn(final_col, F.coalesce(final_col, empty_set()))


def compare_coder_rounds(
    earlier: DataFrame, later: DataFrame, id_col: str | list[str] = "unique_id", codes_col: str = "clerical_codes",
    earlier_col: str = "initial_codes",
) -> DataFrame:
    """First-round human codes beside second-round ones, as if the first round were a model."""
    return join_on_id(earlier.withColumnRenamed(codes_col, earlier_col), later, id_col)


def join_levels(left: DataFrame, right: DataFrame, id_col: str = "unique_id", nulls_match: bool = True) -> DataFrame:
    """Join two tables holding their code sets inside ``levels``, then give each level its own row.

    Joining before the levels are laid out moves every record once, however many levels there are.
    Both sides must list the same levels in the same order.
    """
    joined = join_on_id(left, right.withColumnRenamed("levels", "_levels"), id_col, nulls_match=nulls_match)
    others = [c for c in joined.columns if c not in ("levels", "_levels")]
    both = joined.select(*others, F.inline(F.arrays_zip(F.col("levels").alias("l"), F.col("_levels").alias("r"))))
    return both.select(*others, "l.*", *[F.col(f"r.{name}") for name in both.schema["r"].dataType.fieldNames() if name != "digits"])
