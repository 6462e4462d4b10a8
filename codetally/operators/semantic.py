"""Ranked semantic-search results: confidences, shortlists, top candidates and cumulative curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.fixed_values import DISTANCE_EPSILON, DISTANCE_WEIGHT, RANK_WEIGHT
from codetally.functions.codes import digits_label
from codetally.functions.intervals import functions_for
from codetally.functions.sets import is_single, once
from codetally.lineage import written
from codetally.operators.hierarchy import Hierarchy, level_width
from codetally.operators.joins import join_on_id

CANDIDATES = T.ArrayType(
    T.StructType([
        T.StructField("code", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("likelihood", T.DoubleType()),
    ])
)


def _ranked(results: Column, prefix: Column) -> Column:
    """Nearest distance of each code prefix, nearest first, equal distances by code.

    Sorted once: in order of distance, the first of equal prefixes is the nearest.
    """
    usable = F.filter(results, lambda c: c["distance"].isNotNull() & ~F.isnan(c["distance"].cast("double")))
    ordered = F.sort_array(
        F.transform(
            usable,
            lambda c: F.struct(c["distance"].cast("double").alias("distance"), F.substring(c["code"], F.lit(1), prefix).alias("code")),
        )
    )

    def nearest(candidates: Column) -> Column:
        def distinct(codes: Column) -> Column:
            at = lambda code: F.get(candidates, F.array_position(codes, code) - 1)
            return F.transform(F.array_distinct(codes), at)

        return once(F.transform(candidates, lambda c: c["code"]), distinct)

    return once(ordered, nearest)


def distance_to_confidence(results: Column, digits: Column) -> Column:
    """Search results as ranked candidates with a likelihood.

    No result gives null and a single result is certain. Otherwise codes are cut to the digit level, the
    nearest distance of each is kept, and the likelihood falls with the distance, with its part of the
    two nearest distances together, and with the rank.
    """

    def candidate(c: Column, likelihood: Column) -> Column:
        return F.struct(c["code"].alias("code"), c["distance"].cast("double").alias("distance"), likelihood.alias("likelihood"))

    def scored(ranked: Column) -> Column:
        nearest_two = F.aggregate(F.slice(ranked, 1, 2), F.lit(0.0), lambda acc, c: acc + c["distance"]) + DISTANCE_EPSILON

        def likelihood(d: Column, rank: Column, two: Column) -> Column:
            return F.greatest(F.lit(0.0), 1 - F.try_divide(d, two) - d * DISTANCE_WEIGHT - rank * RANK_WEIGHT)

        return once(
            nearest_two,
            lambda two: F.transform(ranked, lambda c, rank: candidate(c, likelihood(c["distance"], rank, two))),
        )

    several = once(_ranked(results, level_width(digits)), scored)
    single = F.transform(results, lambda c: candidate(c, F.lit(1.0)))
    return F.when(F.size(results) == 1, single.cast(CANDIDATES)).when(F.size(results) > 1, several.cast(CANDIDATES))


def top_candidate(
    df: DataFrame, hierarchy: Hierarchy, results_col: str, digits: int | list[int], level_col: str | None = None
) -> DataFrame:
    """Distance and valid code set of each record's nearest result; both null when there is none.

    A distance that is not a number is null.
    """
    nearest = F.get(F.col(results_col), F.lit(0))
    distance = F.nanvl(nearest["distance"].cast("double"), F.lit(None).cast("double"))
    tops = df.withColumns({"top_distance": distance, "_top_code": nearest["code"]})
    found = hierarchy.clean_one_code(tops, "_top_code", digits, "top_candidate", level_col)
    return found.withColumn("top_candidate", F.when(F.size(results_col) > 0, F.col("top_candidate"))).drop("_top_code")


def top_in_truth(top_set: Column, truth: Column) -> Column:
    """Is the nearest candidate (the smallest code, if it means several) among the human codes?"""
    return F.coalesce(F.array_contains(truth, F.array_min(top_set)), F.lit(False))


def curve_points(df: DataFrame, series: list[str], truth_col: str = "clerical_codes", count_col: str | None = None) -> DataFrame:
    """Distances and matches per series and match type: all records (MO), and one-human-code records (OO)."""
    single = functions_for(df.schema[truth_col].dataType).is_single(F.col(truth_col))
    kinds = F.when(single, F.array(F.lit("MO"), F.lit("OO"))).otherwise(F.array(F.lit("MO")))
    counts = [count_col] if count_col else []
    return df.select(*series, "top_distance", "top_in_truth", *counts, F.explode(kinds).alias("match_type"))


def cumulative_curve(
    points: DataFrame, series: list[str], order_col: str = "top_distance", match_col: str = "top_in_truth", count_col: str | None = None
) -> DataFrame:
    """Share of records and running accuracy at each distance, nearest first. A row stands for one record, or for
    as many as ``count_col`` says.

    Records with the same distance form one point, so points are counted first. The counted points are dealt out by
    ranges of the distance, of about equal size whatever the distances are, and written; totals run inside a range and
    the totals of the ranges before are added, so no task holds a whole series.
    Records without a distance, or with one that is not a number, are in the denominator and give no point.
    """
    distance = F.nanvl(F.col(order_col).cast("double"), F.lit(None).cast("double"))
    records = F.col(count_col) if count_col else F.lit(1).cast("bigint")
    matched = F.sum(F.when(F.col(match_col), records).otherwise(0))
    counted = points.groupBy(*series, distance.alias("distance")).agg(F.sum(records).alias("n"), matched.alias("m"))
    dealt = counted.repartitionByRange(*[F.asc(c) for c in series], F.asc_nulls_last("distance"))
    placed = written(dealt.withColumn("_range", F.spark_partition_id()))

    totals = placed.groupBy("_range", *series).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    whole = Window.partitionBy(*series)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "_range", *series, F.sum("n").over(whole).alias("_total"),
        *[F.coalesce(F.sum(part).over(earlier), F.lit(0)).alias(f"_{part}") for part in ("n", "m")],
    )
    inside = Window.partitionBy("_range", *series).orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.filter(F.col("distance").isNotNull()).withColumns({part: F.sum(part).over(inside) for part in ("n", "m")})
    joined = join_on_id(running, before, ["_range", *series])
    subset, matches = F.col("n") + F.col("_n"), F.col("m") + F.col("_m")
    return joined.select(
        *series,
        F.col("distance").alias("distance_threshold"),
        subset.alias("subset_total"),
        matches.alias("match_count"),
        F.try_divide(subset.cast("double"), F.col("_total").cast("double")).alias("codability"),
        F.try_divide(matches.cast("double"), subset.cast("double")).alias("accuracy"),
    )


def drop_small_samples(curve: DataFrame, above: float = 1 / 10) -> DataFrame:
    """Leave out the first points of a curve, which rest on few records."""
    return curve.filter(F.col("codability") > above)


def clerical_codability(joined: DataFrame, clerical: DataFrame, by: str = "digits", codes_col: str = "clerical_codes") -> DataFrame:
    """Per digit level: joined records the coders coded clearly, over all coded records."""
    clear = joined.groupBy(by).agg(F.count_if(is_single(F.col(codes_col))).alias("clear"))
    total = clerical.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    share = F.try_divide(F.col("clear").cast("double"), F.col("total").cast("double"))
    return clear.join(total, by).select(digits_label(F.col(by)).alias("digits"), share.alias("codability"))
