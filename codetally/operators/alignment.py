"""Label agreement on a wide table: k human labels, m model labels with scores, one row per record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.config import ColumnConfig, ConfusionConfig
from codetally.fixed_values import SUMMARY_THRESHOLDS, THRESHOLD_GRID
from codetally.functions.codes import division, row_max, to_number
from codetally.functions.sets import jaccard, overlaps
from codetally.functions.stats import percent, round_half_even
from codetally.operators.joins import join_on_id
from codetally.operators.prepare import clean_wide_table
from codetally.operators.validation import require_columns, require_unique_ids


def melt_labels(df: DataFrame, id_col: str, label_cols: list[str], value_name: str = "label") -> DataFrame:
    """Label columns under each other as ``(id, variable, label)``, empty labels dropped."""
    return df.unpivot(id_col, label_cols, "variable", value_name).filter(F.col(value_name).isNotNull())


def matches_on_key(df: DataFrame, config: ColumnConfig, key=lambda label: label) -> DataFrame:
    """Ids with a model label and a human label equal under ``key``, each id once."""
    model = melt_labels(df, config.id_col, config.model_label_cols).select(config.id_col, key(F.col("label")).alias("key"))
    human = melt_labels(df, config.id_col, config.clerical_label_cols).select(config.id_col, key(F.col("label")).alias("key"))
    return join_on_id(model.distinct(), human.distinct(), [config.id_col, "key"], "left_semi").select(config.id_col).distinct()


def add_match_flags(df: DataFrame, config: ColumnConfig, unique_ids: bool = False) -> DataFrame:
    """``is_correct`` and ``is_correct_2_digit``: does the record's id have an agreeing pair of labels?

    Records sharing an id share the answer. Labels are reduced to one row per (id, label) before any
    id is brought together, so a very frequent id stays spread over its labels. ``unique_ids`` promises
    ids do not repeat; the answer then depends on the row alone and nothing is shuffled.
    """
    human, model = _label_arrays(config)
    if unique_ids:
        shorten = lambda labels: F.transform(labels, division)
        return df.withColumns({
            "is_correct": overlaps(model, human),
            "is_correct_2_digit": overlaps(shorten(model), shorten(human)),
        })

    def entries(cols: list[str], is_model: bool) -> list[Column]:
        return [
            F.struct(F.lit(full).alias("full"), (F.col(c) if full else division(F.col(c))).alias("key"), F.lit(is_model).alias("is_model"))
            for c in cols
            for full in (True, False)
        ]

    both = F.array(*entries(config.model_label_cols, True), *entries(config.clerical_label_cols, False))
    keys = df.select(F.col(config.id_col), F.inline(both)).filter(F.col("key").isNotNull())
    agreeing = (
        keys.groupBy(config.id_col, "full", "key")
        .agg(F.bool_or("is_model").alias("in_model"), F.bool_or(~F.col("is_model")).alias("in_human"))
        .filter(F.col("in_model") & F.col("in_human"))
    )
    flags = agreeing.groupBy(config.id_col).agg(
        F.bool_or("full").alias("is_correct"), F.bool_or(~F.col("full")).alias("is_correct_2_digit")
    )
    no = F.lit(False)
    return join_on_id(df, flags, config.id_col, "left").withColumns(
        {name: F.coalesce(name, no) for name in ("is_correct", "is_correct_2_digit")}
    )


def add_max_score(df: DataFrame, config: ColumnConfig) -> DataFrame:
    """Scores as numbers and the largest of each row."""
    df = df.withColumns({c: to_number(F.col(c), df.schema[c].dataType) for c in config.model_score_cols})
    return df.withColumn("max_score", row_max([F.col(c) for c in config.model_score_cols]))


def _label_arrays(config: ColumnConfig) -> tuple[Column, Column]:
    human = F.array_compact(F.array(*config.clerical_label_cols))
    model = F.array_compact(F.array(*config.model_label_cols))
    return human, model


class LabelAlignment:
    """A cleaned wide table with match flags, and the tables computed from it.

    ``df`` is lazy; persist it when several tables are wanted. Every method returns a DataFrame.
    ``unique_ids`` promises that ids are neither null nor repeated, which one job over the ids checks first.
    """

    def __init__(self, df: DataFrame, config: ColumnConfig, unique_ids: bool = False):
        self.config = config
        cleaned = clean_wide_table(df, config)
        if unique_ids:
            require_unique_ids(df, [config.id_col])
        self.df = add_max_score(add_match_flags(cleaned, config, unique_ids), config)

    def accuracy(self, threshold: float = 0.0, match_type: str = "full", extended: bool = False) -> DataFrame:
        """Percentage of records at or above a confidence that agree; 0 when there are none."""
        columns = {"full": "is_correct", "2-digit": "is_correct_2_digit"}
        if match_type not in columns:
            raise ValueError(f"There is no match type {match_type!r}; choose one of {sorted(columns)}.")
        confident = self.df.filter(F.col("max_score") >= threshold)
        counted = confident.agg(
            F.count_if(F.col(columns[match_type])).alias("matches"), F.count(F.lit(1)).alias("total_considered")
        )
        value = percent(F.col("matches"), F.col("total_considered"))
        if not extended:
            return counted.select(value.alias("accuracy_percent"))
        return counted.select(
            round_half_even(value, 1).alias("accuracy_percent"),
            "matches",
            (F.col("total_considered") - F.col("matches")).alias("non_matches"),
            "total_considered",
        )

    def coverage(self, threshold: float = 0.0) -> DataFrame:
        """Percentage of all records at or above a confidence; null for an empty table."""
        reached = F.coalesce(F.col("max_score") >= threshold, F.lit(False)).cast("int")
        return self.df.agg((100 * F.avg(reached)).alias("coverage_percent"))

    def threshold_stats(self, thresholds: list[float] | None = None) -> DataFrame:
        """Accuracy and coverage at each threshold, from one pass over the records.

        Records are first counted by how many of the thresholds they reach, so what is left to combine
        is one small row per threshold, whatever the size of the table.
        """
        thresholds = list(THRESHOLD_GRID if thresholds is None else thresholds)
        steps = sorted(set(thresholds))
        reached = sum(F.coalesce((F.col("max_score") >= t).cast("int"), F.lit(0)) for t in steps)
        by_reach = self.df.groupBy(reached.alias("reached")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct")
        )
        wanted = F.array(*[
            F.struct(F.lit(float(t)).alias("threshold"), F.lit(steps.index(t) + 1).alias("step")) for t in thresholds
        ])
        summary = by_reach.agg(F.collect_list(F.struct("reached", "n", "correct")).alias("counts"))
        rows = summary.select("counts", F.inline(wanted))

        def total(field: str, start: Column | int) -> Column:
            return F.aggregate(
                F.filter("counts", lambda c: c["reached"] >= start), F.lit(0).cast("bigint"), lambda acc, c: acc + c[field]
            )

        counted = rows.select(
            "threshold",
            total("n", F.col("step")).alias("considered"),
            total("correct", F.col("step")).alias("matches"),
            total("n", 0).alias("total"),
        )
        share = F.try_divide(F.col("considered").cast("double"), F.col("total").cast("double"))
        return counted.select(
            "threshold", percent(F.col("matches"), F.col("considered")).alias("accuracy"), (100 * share).alias("coverage")
        )

    def summary_stats(self) -> DataFrame:
        """Record count, overall accuracy, accuracy and coverage at the usual thresholds, as one row."""
        score, correct = F.col("max_score"), F.col("is_correct")
        counts = [F.count(F.lit(1)).alias("total_samples")]
        for t in [0.0, *SUMMARY_THRESHOLDS]:
            counts.append(F.count_if(score >= t).alias(f"n_{t}"))
            counts.append(F.count_if((score >= t) & correct).alias(f"hit_{t}"))
        counted = self.df.agg(*counts)
        total = F.col("total_samples").cast("double")
        accuracy = lambda t: percent(F.col(f"`hit_{t}`"), F.col(f"`n_{t}`"))
        return counted.select(
            "total_samples",
            accuracy(0.0).alias("overall_accuracy"),
            *[accuracy(t).alias(f"accuracy_above_{t:.2f}") for t in SUMMARY_THRESHOLDS],
            *[
                (100 * F.try_divide(F.col(f"`n_{t}`").cast("double"), total)).alias(f"coverage_above_{t:.2f}")
                for t in SUMMARY_THRESHOLDS
            ],
        )

    def candidate_contribution(self, candidate_col: str) -> DataFrame:
        """How often one model column agrees with the first human label, and with any of them.

        Agreement with any label counts distinct ids, a null id counting as one.
        """
        id_col, humans = self.config.id_col, self.config.clerical_label_cols
        if candidate_col not in self.df.columns or humans[0] not in self.df.columns:
            raise ValueError(f"{candidate_col} and {humans[0]} must both be columns of the table.")
        made = self.df.filter(F.col(candidate_col).isNotNull())
        candidate = F.col(candidate_col)
        any_match = reduce(lambda a, b: a | b, [F.coalesce(candidate == F.col(c), F.lit(False)) for c in humans])
        counted = made.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(candidate == F.col(humans[0])).alias("primary"),
            F.count_distinct(F.when(any_match, F.col(id_col))).alias("any_ids"),
            F.coalesce(F.bool_or(any_match & F.col(id_col).isNull()), F.lit(False)).cast("int").alias("null_id"),
        )
        anyhow = F.col("any_ids") + F.col("null_id")
        made_any = F.col("total") > 0
        share = lambda part: F.when(made_any, round_half_even(percent(part, F.col("total")), 2))
        return counted.select(
            F.lit(candidate_col).alias("candidate_column"),
            F.col("total").alias("total_predictions_made"),
            share(F.col("primary")).alias("primary_match_percent"),
            F.when(made_any, F.col("primary")).alias("primary_match_count"),
            share(anyhow).alias("any_clerical_match_percent"),
            F.when(made_any, anyhow).alias("any_clerical_match_count"),
        )

    def row_jaccard(self) -> DataFrame:
        """Shared labels over all labels, per record."""
        human, model = _label_arrays(self.config)
        return self.df.withColumn("jaccard", jaccard(model, human))

    def jaccard_similarity(self) -> DataFrame:
        return self.row_jaccard().agg(F.avg("jaccard").alias("jaccard_similarity"))

    def confusion_matrix(self, config: ConfusionConfig) -> DataFrame:
        return confusion_matrix(self.df, config)


def exclude_patterns(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Rows whose text matches none of the patterns; nulls stay."""
    return reduce(lambda d, p: d.filter(~F.coalesce(F.col(col).rlike(p), F.lit(False))), patterns, df)


def top_values(counts: DataFrame, col: str, n: int, count_col: str = "count") -> DataFrame:
    """The ``n`` most frequent non-null values of a table of counts, ties by value."""
    totals = counts.filter(F.col(col).isNotNull()).groupBy(col).agg(F.sum(count_col).alias(count_col))
    return totals.orderBy(F.desc(count_col), F.asc(col)).limit(n)


def confusion_matrix(df: DataFrame, config: ConfusionConfig) -> DataFrame:
    """Counts of (human, model) code pairs among the most frequent codes of each side, in long form."""
    human, model = config.human_code_col, config.model_code_col
    require_columns(df, [human, model])
    kept = exclude_patterns(df.select(human, model), human, config.exclude_patterns)
    pairs = kept.groupBy(human, model).count()
    top_human = top_values(pairs, human, config.top_n).select(human)
    top_model = top_values(pairs, model, config.top_n).select(model)
    return pairs.join(top_human, human, "left_semi").join(top_model, model, "left_semi").select(human, model, "count")


def spread_matrix(pairs: DataFrame, row_col: str, column_col: str, columns: list[str], count_col: str = "count") -> DataFrame:
    """Long pair counts as a matrix with the given columns, zero where a pair never occurs."""
    wide = pairs.groupBy(row_col).pivot(column_col, columns).agg(F.sum(count_col))
    return wide.na.fill(0, columns)
