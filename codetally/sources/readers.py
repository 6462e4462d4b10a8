"""Tables read the way code data needs: as text, nothing guessed."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.fixed_values import CSV_NULL_TOKENS

logger = logging.getLogger(__name__)

REQUEST_TEXT_COLUMNS = ["job_title", "job_description", "org_description"]


def read_text_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, null_tokens: bool = True, multi_line: bool = True
) -> DataFrame:
    """A CSV with a header, every column text. Cells that spell a missing value become null.

    Name the columns to skip reading the header; leading zeros and codes such as ``4+`` survive either way.
    Cells may hold line breaks, so each file is read by one task. ``multi_line=False`` promises that none does,
    which lets large files be read in parts.
    """
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    if not null_tokens:
        return df
    return df.select(*[F.when(~F.col(c).isin(CSV_NULL_TOKENS), F.col(c)).alias(c) for c in df.columns])


def read_typed_csv(
    spark: SparkSession, path: str, types: dict[str, str], columns: list[str] | None = None, strict: bool = True, multi_line: bool = True
) -> DataFrame:
    """A text CSV with the named columns cast.

    A cell that does not fit its type stops the read; with ``strict=False`` it becomes null.
    """
    df = read_text_csv(spark, path, columns, multi_line=multi_line)

    def fitted(name: str, kind: str) -> Column:
        value = F.col(name).try_cast(kind)
        if not strict:
            return value
        unfit = F.col(name).isNotNull() & value.isNull()
        failure = F.raise_error(F.concat(F.lit(f"Column {name} is to be {kind}, which this cell is not: "), F.col(name)))
        return F.when(unfit, failure.cast(kind)).otherwise(value)

    return df.withColumns({c: fitted(c, t) for c, t in types.items()})


def read_model_output(spark: SparkSession, path: str) -> DataFrame:
    """Model or search output with nested candidate arrays."""
    return spark.read.parquet(path)


def read_pipe_delimited(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """``|``-separated text with a header; a line with the wrong number of fields is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns or REQUEST_TEXT_COLUMNS])
    return spark.read.schema(schema).option("sep", "|").option("header", True).option("quote", "").option("mode", "FAILFAST").csv(path)


def companion_path(path: str, prefix: str = "Codes_for_4_plus_") -> str:
    """Where the side table of a clerical file is kept: next to it, with a prefixed name."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}{prefix}{name}"


def read_companion(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """The side table of a clerical file, or None with a warning when there is none."""
    companion = companion_path(path)
    try:
        return read_text_csv(spark, companion, columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        logger.warning("There is no side table at %s, so records marked 4+ keep the codes of the main table.", companion)
        return None
