"""Which human and model codes occur together, and how codes are spread over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codetally.functions.sets import both_single, few_but_not_single, only_member
from codetally.functions.stats import wald_half_width

HUMAN, MODEL = "clerical_codes", "initial_codes"


def explode_both(df: DataFrame, subset: str, left: str = HUMAN, right: str = MODEL) -> DataFrame:
    """Every combination of a record's human and model codes; an empty set gives a null.

    Only records of an ambiguity subset take part, so a record has at most four combinations.
    """
    once = ambiguity_subset(df, subset, left, right).withColumn(left, F.explode_outer(left))
    return once.withColumn(right, F.explode_outer(right))


def ambiguity_subset(df: DataFrame, subset: str, left: str = HUMAN, right: str = MODEL) -> DataFrame:
    """``single``: one code on both sides. ``few``: at most two on each side, not one on both."""
    masks = {"single": both_single, "few": few_but_not_single}
    if subset not in masks:
        raise ValueError(f"subset must be one of {sorted(masks)}")
    return df.filter(masks[subset](F.col(left), F.col(right)))


def pair_counts(df: DataFrame, subset: str, left: str = HUMAN, right: str = MODEL) -> DataFrame:
    """How often each pair of codes occurs in an ambiguity subset. Records with an empty side have no pairs."""
    pairs = ambiguity_subset(df, subset, left, right).select(F.explode(left).alias(left), right).select(left, F.explode(right).alias(right))
    return pairs.groupBy(left, right).count()


def frequent_confusions(pairs: DataFrame, left: str = HUMAN, right: str = MODEL, rank: int = 11) -> DataFrame:
    """Off-diagonal pairs occurring strictly more often than the ``rank``-th most frequent (or last) one.

    Pairs tied with that one are all left out, so there are never more than ``rank - 1``.
    """
    top = pairs.filter(F.col(left) != F.col(right)).orderBy(F.desc("count")).limit(rank)
    # A window over at most ``rank`` rows.
    return top.withColumn("_least", F.min("count").over(Window.partitionBy())).filter(F.col("count") > F.col("_least")).drop("_least")


def counts_among_confused(pairs: DataFrame, left: str = HUMAN, right: str = MODEL, rank: int = 11) -> DataFrame:
    """All pair counts, diagonal included, among the codes of the frequent confusions."""
    frequent = frequent_confusions(pairs, left, right, rank)
    labels = frequent.select(F.explode(F.array(left, right)).alias("label")).distinct()
    on_left = labels.withColumnRenamed("label", left)
    on_right = labels.withColumnRenamed("label", right)
    return pairs.join(on_left, left, "left_semi").join(on_right, right, "left_semi").select(left, right, "count")


def code_labels(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct codes occurring in the given set columns."""
    return df.select(F.explode(F.concat(*cols)).alias("label")).distinct()


def single_section(df: DataFrame, codes_col: str, source: str) -> DataFrame:
    """Section of the records with exactly one, tagged with where it comes from."""
    return df.select(only_member(F.col(codes_col)).alias("sic_section"), F.lit(source).alias("source"))


def section_distribution(sections: DataFrame) -> DataFrame:
    """Count, source total, frequency and interval of each section per source."""
    counts = (
        sections.filter(F.col("sic_section").isNotNull())
        .groupBy("sic_section", "source")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return with_group_share(counts, "source").withColumn("ci", wald_half_width(F.col("frequency"), F.col("sample_size")))


def with_group_share(counts: DataFrame, group: str, count_col: str = "count") -> DataFrame:
    """Group total and share beside each count. Meant for tables of counts, one row per category."""
    total = F.sum(count_col).over(Window.partitionBy(group))
    share = F.try_divide(F.col(count_col).cast("double"), F.col("sample_size").cast("double"))
    return counts.withColumn("sample_size", total).withColumn("frequency", share)


def melt_metrics(df: DataFrame, id_cols: list[str], metric_cols: list[str]) -> DataFrame:
    """Metric columns under each other as ``(ids, metrics, value)``."""
    return df.unpivot(id_cols, metric_cols, "metrics", "value")


def add_wald_interval(melted: DataFrame, n_col: str, proportions: list[str]) -> DataFrame:
    """95 % half-width for those metrics that are proportions of ``n``; null for the others."""
    interval = F.when(F.col("metrics").isin(proportions), wald_half_width(F.col("value"), F.col(n_col)))
    return melted.withColumn("ci", interval)
