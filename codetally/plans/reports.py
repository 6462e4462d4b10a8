"""Reports: sets of tables over one input. Each table is lazy; persist the input when all are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.config import ColumnConfig
from codetally.operators.alignment import LabelAlignment
from codetally.operators.hierarchy import Hierarchy
from codetally.operators.pairs import (
    code_labels,
    counts_among_confused,
    pair_counts,
    section_distribution,
    single_section,
)
from codetally.operators.prepare import prepare_clerical_codes, prepare_model_codes, stack_methods
from codetally.operators.quality import (
    add_quality_flags,
    division_share,
    flag_counts,
    frequency_table,
    group_membership,
    single_answer_share,
)
from codetally.operators.selection import (
    build_requests,
    lookup_text,
    reformat_access_codes,
    seeded_sample,
    split_retained,
    take_window,
)
from codetally.sources.readers import read_text_csv
from codetally.sources.writers import write_csv, write_split


def alignment_report(df: DataFrame, config: ColumnConfig, unique_ids: bool = False) -> dict[str, DataFrame]:
    """Every table of a label-accuracy analysis."""
    aligned = LabelAlignment(df, config, unique_ids)
    return {
        "full_accuracy": aligned.accuracy(match_type="full", extended=True),
        "two_digit_accuracy": aligned.accuracy(match_type="2-digit", extended=True),
        "jaccard_similarity": aligned.jaccard_similarity(),
        "summary_statistics": aligned.summary_stats(),
        "threshold_statistics": aligned.threshold_stats(),
        **{f"contribution_{c}": aligned.candidate_contribution(c) for c in config.model_label_cols},
    }


def flag_file(spark: SparkSession, path: str, out_path: str, code_cols: list[str] | None = None) -> dict[str, DataFrame]:
    """Read a clerical CSV, add quality flags, write the result, return the flagged table and flag counts."""
    flagged = add_quality_flags(read_text_csv(spark, path), code_cols)
    write_csv(flagged, out_path)
    return {"flagged": flagged, "flag_counts": flag_counts(flagged)}


def data_profile(flagged: DataFrame, divisions: list[str], code_col: str = "sic_ind_occ1", top_n: int = 10) -> dict[str, DataFrame]:
    """Group membership and value distributions of a flagged table."""
    return {
        "group_membership": group_membership(flagged),
        "divisions": frequency_table(flagged, "SIC_Division", top_n, show_percent=True),
        "division_share": division_share(flagged, divisions),
        "unambiguous_codes": frequency_table(flagged.filter("Unambiguous"), code_col, top_n, show_percent=True),
        "num_answers": frequency_table(flagged, "num_answers", top_n, show_percent=True, labels={"4": "4+"}),
        "single_answer_share": single_answer_share(flagged),
    }


def confusion_report(joined: DataFrame, digits: int) -> dict[str, DataFrame]:
    """Code-pair counts for clearly coded and for nearly clearly coded records.

    Deeper levels have too many codes to show, so only those in frequent confusions are kept.
    """
    tables = {"labels": code_labels(joined, "clerical_codes")}
    for subset in ("single", "few"):
        pairs = pair_counts(joined, subset)
        tables[subset] = counts_among_confused(pairs) if digits > 1 else pairs
    return tables


def section_report(
    clerical: DataFrame, model: DataFrame, hierarchy: Hierarchy, four_plus: DataFrame | None = None,
    section_col: str = "sic_section", unique_ids: bool = False,
) -> DataFrame:
    """Sections of clearly coded records by source: as registered, by the coders, by the model."""
    admin = clerical.select(F.col(section_col).alias("sic_section"), F.lit("Admin labels").alias("source"))
    human = prepare_clerical_codes(clerical, hierarchy, four_plus, digits=0, unique_ids=unique_ids)
    codes = prepare_model_codes(model, hierarchy, out_col="initial_codes", digits=0)
    sections = admin.unionByName(single_section(human, "clerical_codes", "Clerical codes")).unionByName(
        single_section(codes, "initial_codes", "Model codes")
    )
    return section_distribution(sections)


def question_sample(clerical: DataFrame, models: dict[str, DataFrame], n: int = 20, seed: int = 1, text_col: str = "followup_question") -> DataFrame:
    """Follow-up questions every model asked for a few sampled records."""
    return lookup_text(seeded_sample(clerical.select("unique_id"), "unique_id", n, seed), stack_methods(models), text_col)


def share_access_codes(
    df: DataFrame, n: int, path: str, order_col: str = "survey_access_id", overwrite: bool = False, **names
) -> tuple[str, str]:
    """Reformat an access-code table and write its retained and distributed halves; returns both paths."""
    renamed = reformat_access_codes(df, **names)
    key = dict(zip(df.columns, renamed.columns))[order_col]
    retained, distributed = split_retained(renamed, key, n)
    return write_split(retained, distributed, path, overwrite=overwrite)


def request_batch(
    df: DataFrame, id_col: str, columns: dict[str, str], order_cols: list[str], constants: dict[str, str], skip: int = 0,
    take: int | None = None,
) -> DataFrame:
    """Requests for a window of the records."""
    return build_requests(take_window(df, order_cols, skip, take), id_col, columns, constants)
