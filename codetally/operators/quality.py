"""Quality flags of human code columns and the profile tables made from them."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.fixed_values import MEMBERSHIP_GROUPS, QUALITY_FLAGS
from codetally.functions.codes import (
    answer_count,
    has_unknown_digits,
    is_five_digits,
    is_four_or_more,
    is_not_codable,
    leading_division,
    relabel,
)

logger = logging.getLogger(__name__)

CODE_COLUMNS = ["sic_ind_occ1", "sic_ind_occ2", "sic_ind_occ3"]


def count_answers(df: DataFrame, cols: list[str]) -> Column:
    """Number of codes given over the columns that exist."""
    for name in cols:
        if name not in df.columns:
            logger.warning("Answers are counted without %s, which the table does not have.", name)
    return answer_count(*[F.col(c) if c in df.columns else F.lit(None).cast("string") for c in cols])


def add_quality_flags(df: DataFrame, code_cols: list[str] | None = None) -> DataFrame:
    """Add the quality flags of the first code column; a table without the columns comes back unchanged."""
    cols = code_cols or CODE_COLUMNS
    missing = [c for c in cols if c not in df.columns]
    if missing:
        logger.error("No quality flags added: the table lacks %s.", missing)
        return df
    first = F.col(cols[0])
    answers = count_answers(df, cols)
    return df.withColumns({
        "Not_Codeable": is_not_codable(first),
        "Four_Or_More": is_four_or_more(first),
        "SIC_Division": leading_division(first),
        "num_answers": answers,
        "All_Clerical_codes": F.array(*cols),
        "Match_5_digits": is_five_digits(first),
        "Match_3_digits": has_unknown_digits(first, 2),
        "Match_2_digits": has_unknown_digits(first, 3),
        "Unambiguous": (answers == 1) & is_five_digits(first),
    })


def flag_counts(df: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """How often each flag is true, false and null. Flag combinations are counted first, then taken apart."""
    flags = flags or QUALITY_FLAGS
    combined = df.groupBy(*flags).count()
    return combined.unpivot("count", flags, "flag", "value").groupBy("flag", "value").agg(F.sum("count").alias("count"))


def group_membership(flagged: DataFrame) -> DataFrame:
    """The group-membership table: count and percentage of each group, "Other" and the total."""
    answers = F.col("num_answers")
    conditions = [
        answers == 0,
        answers == 4,
        F.col("Match_2_digits"),
        F.col("Match_3_digits"),
        F.col("Unambiguous"),
        F.col("Match_5_digits") & ~F.col("Unambiguous"),
    ]
    names = [f"c{i}" for i in range(len(conditions))]
    counted = flagged.agg(*[F.count_if(c).alias(n) for c, n in zip(conditions, names)], F.count(F.lit(1)).alias("total"))
    known = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    values = [*[F.col(n) for n in names], F.col("total") - known, F.col("total")]
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("category"), value.alias("count"))
        for i, (label, value) in enumerate(zip(MEMBERSHIP_GROUPS, values))
    ]
    share = F.try_divide(F.col("count").cast("double"), F.col("total").cast("double")) * 100
    return counted.select("total", F.inline(F.array(*entries))).select(
        "position", "category", "count", share.alias("percentage")
    )


def frequency_table(
    df: DataFrame, col: str, top_n: int = 10, show_percent: bool = False, labels: dict[str, str] | None = None
) -> DataFrame:
    """The most frequent values and the rest as "Others", in counts or percent of non-null values.

    ``top_percent`` is the share of the listed values together. A column without values gives no rows.
    """
    if col not in df.columns:
        logger.warning("Column '%s' not found. No frequency table.", col)
        return df.sparkSession.createDataFrame([], "position int, value string, amount double, top_percent double")
    value = F.col(col).cast("string")
    counts = df.filter(F.col(col).isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.orderBy(F.desc("n"), F.asc("value")).limit(top_n)
    total = counts.agg(F.sum("n")).scalar()
    # At most top_n rows are gathered into the one array.
    ranked = listed.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "value"))).alias("top"))
    rows = ranked.select("top", total.alias("total")).filter(F.col("total").isNotNull()).withColumn(
        "listed", F.aggregate("top", F.lit(0).cast("bigint"), lambda acc, x: acc - x["rank"])
    )
    entry = lambda position, name, n: F.struct(position.alias("position"), name.alias("value"), n.alias("n"))
    entries = F.transform("top", lambda x, i: entry(i + 1, x["value"], -x["rank"]))
    rest = F.array(entry(F.size("top") + 1, F.lit("Others"), F.col("total") - F.col("listed")))
    flat = rows.select("total", "listed", F.inline(F.concat(entries, rest)))
    amount = percent_of(F.col("n"), F.col("total")) if show_percent else F.col("n").cast("double")
    shown = relabel(F.col("value"), labels) if labels else F.col("value")
    return flat.select(
        "position", shown.alias("value"), amount.alias("amount"), percent_of(F.col("listed"), F.col("total")).alias("top_percent")
    )


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def division_share(flagged: DataFrame, divisions: list[str], col: str = "SIC_Division") -> DataFrame:
    """Percentage of records in the listed divisions."""
    inside = F.count_if(F.coalesce(F.col(col).isin(divisions), F.lit(False)))
    return flagged.agg(inside.alias("n"), F.count(F.lit(1)).alias("total")).select(
        F.try_divide(100 * F.col("n").cast("double"), F.col("total").cast("double")).alias("percent")
    )


def single_answer_share(flagged: DataFrame) -> DataFrame:
    """Percentage of records with exactly one answer."""
    one = F.count_if(F.col("num_answers") == 1)
    return flagged.agg(one.alias("n"), F.count(F.lit(1)).alias("total")).select(
        F.try_divide(100 * F.col("n").cast("double"), F.col("total").cast("double")).alias("percent")
    )
