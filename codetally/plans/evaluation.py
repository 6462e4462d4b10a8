"""Whole evaluations: model output against human codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.functions.codes import digits_label
from codetally.operators.hierarchy import Hierarchy
from codetally.operators.joins import attach_final_codes, join_levels
from codetally.operators.metrics import evaluation_metrics, metrics_of_pairs
from codetally.operators.pairs import add_wald_interval, melt_metrics
from codetally.operators.prepare import Fallback, clerical_code_levels, model_code_levels, prepare_model_codes, stack_methods
from codetally.plans.pairing import coded_records, compared_records
from codetally.sources.readers import read_companion, read_model_output, read_text_csv
from codetally.sources.writers import write_metrics


def joined_codes(
    model: DataFrame,
    clerical: DataFrame,
    hierarchy: Hierarchy,
    four_plus: DataFrame | None = None,
    digits: int = 5,
    threshold: float = 0.0,
    unique_ids: bool = False,
) -> DataFrame:
    """Human, initial and (where the model table has ``final_sic``) final code sets side by side.

    ``unique_ids`` promises that ids are neither repeated nor null. Codes are cleaned where they are read, and each table
    is shuffled by id once, by the join.
    """
    truth = clerical_code_levels(clerical, hierarchy, [digits], four_plus, unique_ids=unique_ids)
    outputs = {"initial_codes": Fallback("alt_sic_candidates", threshold)}
    has_final = "final_sic" in model.columns
    if has_final and unique_ids:
        outputs["final_codes"] = Fallback("final_sic")
    codes = model_code_levels(model, hierarchy, outputs, [digits])
    joined = join_levels(codes, truth, nulls_match=not unique_ids).drop("digits")
    if not has_final or unique_ids:
        return joined
    final = prepare_model_codes(model, hierarchy, alt_codes_col="final_sic", out_col="final_codes", digits=digits)
    return attach_final_codes(joined, final, "final_codes")


def evaluate(
    model: DataFrame, clerical: DataFrame, hierarchy: Hierarchy, four_plus: DataFrame | None = None, digits: int = 5,
    threshold: float = 0.0, unique_ids: bool = False,
) -> DataFrame:
    """All metrics of one model at one digit level, as one nested row."""
    if not unique_ids and "final_sic" not in model.columns:
        return metrics_of_pairs(compared_records(model, clerical, hierarchy, [digits], four_plus, threshold))
    records = coded_records(model, clerical, hierarchy, [digits], four_plus, threshold, unique_ids)
    return evaluation_metrics(records, prepared=True, count_col="records")


def evaluate_files(
    spark: SparkSession,
    hierarchy: Hierarchy,
    evaluation_data: str,
    clerical_file: str | None = None,
    digits: int = 5,
    write_output: bool = False,
    unique_ids: bool = False,
) -> DataFrame:
    """The same from files: model output as parquet, human codes as CSV or in the same table."""
    model = read_model_output(spark, evaluation_data)
    clerical, four_plus = model, None
    if clerical_file:
        clerical, four_plus = read_text_csv(spark, clerical_file), read_companion(spark, clerical_file)
        id_type = model.schema["unique_id"].dataType
        clerical = clerical.withColumn("unique_id", F.col("unique_id").cast(id_type))
        four_plus = four_plus and four_plus.withColumn("unique_id", F.col("unique_id").cast(id_type))
    metrics = evaluate(model, clerical, hierarchy, four_plus=four_plus, digits=digits, unique_ids=unique_ids)
    if write_output:
        write_metrics(metrics, evaluation_data, digits)
    return metrics


def sweep(
    models: dict[str, DataFrame],
    clerical: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    unique_ids: bool = False,
    four_plus: DataFrame | None = None,
    first_round: DataFrame | None = None,
    first_round_four_plus: DataFrame | None = None,
    threshold: float = 0.7,
) -> DataFrame:
    """All metrics for every model and digit level, from one aggregation.

    A first round of human coding can take part as if it were a model, named ``coder_round_1``.
    """
    model, rounds = stack_methods(models), (["method"], first_round, first_round_four_plus)
    if not unique_ids and "final_sic" not in model.columns:
        return metrics_of_pairs(compared_records(model, clerical, hierarchy, levels, four_plus, threshold, *rounds), ["digits", "method"])
    records = coded_records(model, clerical, hierarchy, levels, four_plus, threshold, unique_ids, *rounds)
    return evaluation_metrics(records, by=["digits", "method"], prepared=True, count_col="records")


def model_points(metrics: DataFrame) -> DataFrame:
    """A model's codability with its one-to-one and many-to-one accuracy, per digit level: points beside the curves."""
    kinds = {"OO": "accuracy_oo_unambiguous", "MO": "accuracy_mo_unambiguous"}
    points = [
        F.struct(F.lit(kind).alias("match_type"), F.col(f"initial_accuracy_metrics.{name}").alias("accuracy")) for kind, name in kinds.items()
    ]
    codability = F.col("codability_metrics.initial_codable_prop").alias("codability")
    return metrics.select(digits_label(F.col("digits")).alias("digits"), "method", codability, F.inline(F.array(*points)))


def ambiguity_table(metrics: DataFrame, truth: DataFrame, n_records: DataFrame) -> DataFrame:
    """Ambiguity metrics of a sweep in long form, with the interval for the two that are proportions.

    ``truth`` is the coders' own codability per level; ``n_records`` a one-row table with the number of records ``n``.
    """
    own = metrics.select(
        digits_label(F.col("digits")).alias("digits"),
        "method",
        F.col("codability_metrics.initial_codable_prop").alias("codability"),
        *[F.col(f"ambiguity_metrics.{name}").alias(name) for name in ("precision", "recall", "f1", "accuracy")],
    )
    stacked = own.unionByName(truth, allowMissingColumns=True)
    melted = melt_metrics(stacked, ["digits", "method"], ["codability", "precision", "recall", "f1", "accuracy"])
    return add_wald_interval(melted.withColumn("n", n_records.scalar()), "n", ["codability", "accuracy"]).drop("n")


def accuracy_table(metrics: DataFrame, ids: list[str] | None = None, kinds: tuple[str, ...] = ("OO", "OM", "MO", "MM")) -> DataFrame:
    """Accuracies of a sweep in long form."""
    source = {
        "OO": "accuracy_oo_unambiguous", "OM": "accuracy_om_unambiguous",
        "MO": "accuracy_mo_unambiguous", "MM": "accuracy_mm_total",
    }
    ids = ids or ["method"]
    wide = metrics.select(
        digits_label(F.col("digits")).alias("digits"),
        *ids,
        *[F.col(f"initial_accuracy_metrics.{source[k]}").alias(f"{k} Accuracy") for k in kinds],
    )
    return melt_metrics(wide, ["digits", *ids], [f"{k} Accuracy" for k in kinds])
