"""Agreement metrics over code sets. Every function is one aggregation; ``by`` gives one row per group.

With no ``by`` the result is exactly one row, also for an empty table.
"""

from __future__ import annotations

import logging
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.fixed_values import MATCH_METHODS
from codetally.functions.codes import digits_label
from codetally.functions import sets as spelled_sets
from codetally.functions.intervals import functions_for
from codetally.functions.sets import code_set
from codetally.functions.stats import f_score, ratio
from codetally.operators.validation import require_columns

logger = logging.getLogger(__name__)


def _aggregate(df: DataFrame, by: list[str] | None, conditions: dict[str, Column], records: Column | None = None) -> DataFrame:
    """How many records meet each condition, a row standing for one record or for ``records`` of them."""
    count = F.count_if if records is None else lambda c: F.coalesce(F.sum(F.when(c, records)), F.lit(0))
    columns = [count(c).alias(name) for name, c in conditions.items()]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def _ambiguity_counts(model: Column, truth: Column) -> dict[str, Column]:
    return {
        "TP": model & truth,
        "FP": model & ~truth,
        "FN": ~model & truth,
        "TN": ~model & ~truth,
    }


def _ambiguity_metrics(total: Column, prefix: str = "") -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(f"{prefix}{name}") for name in ("TP", "FP", "FN", "TN"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": f_score(precision, recall),
        "accuracy": ratio(tp + tn, total),
        "TP": tp, "FP": fp, "FN": fn, "TN": tn,
    }


def _codability_counts(initial: Column, final: Column | None) -> dict[str, Column]:
    counts = {"initial_codable_count": ~initial}
    if final is not None:
        counts["final_codable_count"] = ~final
    return counts


def _codability_metrics(total: Column, has_final: bool, prefix: str = "") -> dict[str, Column]:
    initial = F.col(f"{prefix}initial_codable_count")
    final = F.col(f"{prefix}final_codable_count") if has_final else F.lit(None).cast("bigint")
    none = F.lit(None).cast("double")
    return {
        "initial_codable_prop": ratio(initial, total),
        "final_codable_prop": ratio(final, total) if has_final else none,
        "codability_improvement_prop": ratio(final - initial, total) if has_final else none,
        "initial_codable_count": initial,
        "final_codable_count": final,
    }


def _comparison(truth: Column, model: Column, prefix: str = "", sets: ModuleType = spelled_sets) -> list[Column]:
    """What the accuracy counts need to know about a pair of sets, worked out once per row."""
    return [
        sets.is_single(truth).alias(f"{prefix}single_truth"),
        sets.is_single(model).alias(f"{prefix}single_model"),
        sets.overlaps(truth, model).alias(f"{prefix}overlap"),
    ]


def _accuracy_counts(prefix: str = "") -> dict[str, Column]:
    truth, model, overlap = (F.col(f"{prefix}{name}") for name in ("single_truth", "single_model", "overlap"))
    return {
        "matches_oo": truth & model & overlap,
        "matches_om": truth & overlap,
        "matches_mo": model & overlap,
        "matches_mm": overlap,
        "unambiguous_records": truth & model,
        "single_truth": truth,
        "single_model": model,
    }


def _accuracy_metrics(total: Column, prefix: str = "") -> dict[str, Column]:
    count = lambda name: F.col(f"{prefix}{name}")
    return {
        "total_records": total,
        "unambiguous_records": count("unambiguous_records"),
        **{f"matches_{m.lower()}": count(f"matches_{m.lower()}") for m in MATCH_METHODS},
        "accuracy_oo_total": ratio(count("matches_oo"), total),
        "accuracy_mm_total": ratio(count("matches_mm"), total),
        "accuracy_oo_unambiguous": ratio(count("matches_oo"), count("unambiguous_records")),
        "accuracy_om_unambiguous": ratio(count("matches_om"), count("single_truth")),
        "accuracy_mo_unambiguous": ratio(count("matches_mo"), count("single_model")),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def ambiguity_metrics(
    df: DataFrame, model_ambiguous_col: str = "initial_ambiguous", truth_ambiguous_col: str = "clerical_ambiguous",
    by: list[str] | None = None,
) -> DataFrame:
    """Precision, recall, F1, accuracy and counts, "ambiguous" being the positive class."""
    counts = _ambiguity_counts(F.col(model_ambiguous_col), F.col(truth_ambiguous_col))
    counted = _aggregate(df, by, {**counts, "_total": F.lit(True)})
    return counted.select(*(by or []), *_named(_ambiguity_metrics(F.col("_total"))))


def codability_metrics(
    df: DataFrame, initial_ambiguous_col: str = "initial_ambiguous", final_ambiguous_col: str | None = "final_ambiguous",
    by: list[str] | None = None,
) -> DataFrame:
    """Share of records with one clear code before and, where known, after follow-up."""
    has_final = final_ambiguous_col in df.columns
    final = F.col(final_ambiguous_col) if has_final else None
    counts = _codability_counts(F.col(initial_ambiguous_col), final)
    counted = _aggregate(df, by, {**counts, "_total": F.lit(True)})
    return counted.select(*(by or []), *_named(_codability_metrics(F.col("_total"), has_final)))


def accuracy_metrics(
    df: DataFrame, model_col: str = "initial_codes", truth_col: str = "clerical_codes", by: list[str] | None = None
) -> DataFrame:
    """Match counts and shares, one-to-one through many-to-many."""
    sets = df.select(*(by or []), *[code_set(F.col(c), df.schema[c].dataType).alias(n) for n, c in (("t", truth_col), ("m", model_col))])
    compared = sets.select(*(by or []), *_comparison(F.col("t"), F.col("m")))
    counted = _aggregate(compared, by, {**_accuracy_counts(), "_total": F.lit(True)})
    return counted.select(*(by or []), *_named(_accuracy_metrics(F.col("_total"))))


def evaluation_metrics(
    df: DataFrame,
    truth_col: str = "clerical_codes",
    initial_model_col: str = "initial_codes",
    final_model_col: str | None = "final_codes",
    by: list[str] | None = None,
    prepared: bool = False,
    count_col: str | None = None,
) -> DataFrame:
    """All metrics of a joined table in one pass, as one nested row per group.

    Code columns may be text, numbers or arrays; ``prepared`` says they already are the code sets made by
    this library, spelled out or as intervals. A row stands for as many records as ``count_col`` says. Without final codes the final
    metrics are null.
    """
    by = by or []
    if final_model_col and final_model_col not in df.columns:
        logger.warning("There is no column %s, so metrics after follow-up are left empty.", final_model_col)
        final_model_col = None
    has_final = final_model_col is not None
    roles = {"truth": truth_col, "initial": initial_model_col, **({"final": final_model_col} if has_final else {})}
    require_columns(df, [*by, *roles.values()])
    as_set = lambda c: F.col(c) if prepared else code_set(F.col(c), df.schema[c].dataType)
    records = F.col(count_col) if count_col else F.lit(1).cast("bigint")
    sets = df.select(*by, records.alias("records"), *[as_set(c).alias(role) for role, c in roles.items()])
    truth, initial = F.col("truth"), F.col("initial")
    kind = functions_for(df.schema[truth_col].dataType) if prepared else spelled_sets
    compared = sets.select(
        *by, "records", *_comparison(truth, initial, "ini_", kind), *(_comparison(truth, F.col("final"), "fin_", kind) if has_final else [])
    )
    return _evaluation(compared, by, has_final)


def metrics_of_pairs(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from counted comparisons: ``single_truth``, ``single_model``, ``overlap`` and ``records``, whose sums count."""
    logger.warning("There is no column final_codes, so metrics after follow-up are left empty.")
    by = by or []
    named = [F.col(name).alias(f"ini_{name}") for name in ("single_truth", "single_model", "overlap")]
    return _evaluation(compared.select(*by, "records", *named), by, False)


def _evaluation(compared: DataFrame, by: list[str], has_final: bool) -> DataFrame:
    counts = {"total": F.lit(True)}
    counts |= _prefixed("amb_", _ambiguity_counts(~F.col("ini_single_model"), ~F.col("ini_single_truth")))
    counts |= _prefixed("cod_", _codability_counts(~F.col("ini_single_model"), ~F.col("fin_single_model") if has_final else None))
    counts |= _prefixed("n_ini_", _accuracy_counts("ini_"))
    if has_final:
        counts |= _prefixed("n_fin_", _accuracy_counts("fin_"))
    # Counted by what sets them apart, a few rows per group, which are then added up for each metric.
    known = compared.groupBy(*[c for c in compared.columns if c != "records"]).agg(F.sum("records").alias("records"))
    counted = _aggregate(known, by, counts, F.col("records"))
    total = F.col("total")
    initial_accuracy = F.struct(*_named(_accuracy_metrics(total, "n_ini_")))
    final_accuracy = F.struct(*_named(_accuracy_metrics(total, "n_fin_" if has_final else "n_ini_")))
    return counted.select(
        *by,
        F.struct(*_named(_ambiguity_metrics(total, "amb_"))).alias("ambiguity_metrics"),
        F.struct(*_named(_codability_metrics(total, has_final, "cod_"))).alias("codability_metrics"),
        initial_accuracy.alias("initial_accuracy_metrics"),
        F.when(F.lit(has_final), final_accuracy).alias("final_accuracy_metrics"),
    )


def _prefixed(prefix: str, columns: dict[str, Column]) -> dict[str, Column]:
    return {f"{prefix}{name}": c for name, c in columns.items()}


def flatten_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nested metrics as plain columns named ``<group>_<metric>``."""
    short = {
        "ambiguity_metrics": "ambiguity",
        "codability_metrics": "codability",
        "initial_accuracy_metrics": "initial",
        "final_accuracy_metrics": "final",
    }
    columns = [
        F.col(f"{group}.{name}").alias(f"{label}_{name}")
        for group, label in short.items()
        for name in metrics.schema[group].dataType.fieldNames()
    ]
    return metrics.select(*(by or []), *columns)


def true_codability(metrics: DataFrame, digits_col: str = "digits", method: str = "truth") -> DataFrame:
    """Share of records the human coders coded clearly, once per digit level."""
    clear = F.col("ambiguity_metrics.TN") + F.col("ambiguity_metrics.FP")
    return metrics.select(
        digits_label(F.col(digits_col)).alias("digits"),
        F.lit(method).alias("method"),
        ratio(clear, F.col("initial_accuracy_metrics.total_records")).alias("codability"),
    ).distinct()
