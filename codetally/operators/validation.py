"""Checks made while a plan is built. None of them runs a job unless it says so."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.config import ColumnConfig
from codetally.functions.codes import null_missing_label, text_flag, to_number

logger = logging.getLogger(__name__)


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"The table lacks {missing}; it has {df.columns}.")


def validate_wide_table(df: DataFrame, config: ColumnConfig) -> list[str]:
    """Columns present and paired; returns (and logs) warnings about unexpected types."""
    require_columns(df, config.required_cols)
    if len(config.model_label_cols) != len(config.model_score_cols):
        raise ValueError(
            f"Every model label column needs a score column: {config.model_label_cols} against {config.model_score_cols}."
        )
    warnings = [
        f"Scores in {name} are {df.schema[name].dataType.simpleString()} and will be read as numbers."
        for name in config.model_score_cols
        if not isinstance(df.schema[name].dataType, T.NumericType)
    ]
    warnings += [
        f"Labels in {name} are {df.schema[name].dataType.simpleString()} and will be read as text."
        for name in config.label_cols
        if not isinstance(df.schema[name].dataType, T.StringType)
    ]
    for text in warnings:
        logger.warning(text)
    return warnings


def cell_counts(df: DataFrame, config: ColumnConfig) -> dict[str, Column]:
    """Aggregates that tell how many rows there are and how many cells of each kind can't be used.

    Columns the table lacks are left out. A score is unreadable if it is there but no number, a flag if it is there but
    neither true nor false; a label is missing if it is null or spells a missing value.
    """
    counts = {"rows": F.count(F.lit(1))}
    have = {name: df.schema[name].dataType for name in config.required_cols if name in df.columns}
    if config.id_col in have:
        counts[f"null id: {config.id_col}"] = F.count_if(F.col(config.id_col).isNull())
    for name in config.model_score_cols:
        if name in have:
            score = F.col(name)
            counts[f"unreadable score: {name}"] = F.count_if(score.isNotNull() & to_number(score, have[name]).isNull())
    for name in config.label_cols:
        if name in have:
            counts[f"missing label: {name}"] = F.count_if(null_missing_label(F.col(name).cast("string")).isNull())
    if config.filter_unambiguous and "Unambiguous" in have:
        flag = F.col("Unambiguous")
        counts["unreadable flag: Unambiguous"] = F.count_if(flag.isNotNull() & text_flag(flag, have["Unambiguous"]).isNull())
    return counts


def observe_cells(df: DataFrame, config: ColumnConfig, name: str = "cells") -> tuple[DataFrame, Observation]:
    """The table, and the counts of its unusable cells, gathered while the table is used: no job of their own.

    ``Observation.get`` has them once the table was written or collected.
    """
    observation = Observation(name)
    return df.observe(observation, *[c.alias(told) for told, c in cell_counts(df, config).items()]), observation


def validation_report(df: DataFrame, config: ColumnConfig) -> DataFrame:
    """Every outcome of a validation as a row ``check, subject, rows``; ``rows`` is null for what concerns columns.

    What stops an analysis (``missing column``, ``unpaired columns``), what it warns of (``score read as number``,
    ``label read as text``), and how many cells can't be used. One aggregation over the table.
    """
    found = [("missing column", name) for name in config.required_cols if name not in df.columns]
    if len(config.model_label_cols) != len(config.model_score_cols):
        found.append(("unpaired columns", f"{len(config.model_label_cols)} labels, {len(config.model_score_cols)} scores"))
    kinds = {f.name: f.dataType for f in df.schema}
    found += [("score read as number", n) for n in config.model_score_cols if n in kinds and not isinstance(kinds[n], T.NumericType)]
    found += [("label read as text", n) for n in config.label_cols if n in kinds and not isinstance(kinds[n], T.StringType)]
    rows = [F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), F.lit(None).cast("bigint").alias("rows")) for check, subject in found]
    counts = cell_counts(df, config)
    named = {told: (told.split(": ") + ["table"])[:2] for told in counts}
    rows += [F.struct(F.lit(named[t][0]).alias("check"), F.lit(named[t][1]).alias("subject"), F.col(f"`{t}`").alias("rows")) for t in counts]
    return df.agg(*[c.alias(told) for told, c in counts.items()]).select(F.inline(F.array(*rows)))


def require_more_rows(found: int, n: int) -> None:
    """Fail unless more than ``n`` rows were found."""
    if found <= n:
        raise ValueError(f"{n} rows are to be distributed and one retained, but only {found} rows have a key.")


def require_unique_ids(df: DataFrame, id_cols: list[str]) -> None:
    """Fail if the first of the columns is null or all of them together repeat. Runs a job that reads only them."""
    ids = df.groupBy(*id_cols).count()
    broken = ids.filter(F.col(id_cols[0]).isNull() | (F.col("count") > 1)).limit(1).collect()
    if broken:
        raise ValueError(f"Ids were promised to be unique, but there is {broken[0].asDict()}.")


def schema_problems(df: DataFrame, schema: T.StructType) -> list[str]:
    """How a table differs from a declared schema: missing, extra and differently typed columns."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema}
    problems = [f"missing column {name}" for name in want if name not in have]
    problems += [f"unexpected column {name}" for name in have if name not in want]
    problems += [
        f"column {name} is {have[name].simpleString()}, not {want[name].simpleString()}"
        for name in want
        if name in have and have[name] != want[name]
    ]
    return problems
