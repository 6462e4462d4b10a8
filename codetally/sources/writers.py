"""Where results go. Each function runs one write; nothing is collected."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.operators.validation import require_columns, schema_problems

# Result table of the latency test: the only table with a declared schema.
LATENCY_SCHEMA = T.StructType([
    T.StructField("test_id", T.LongType(), False),
    T.StructField("test_description", T.StringType(), False),
    T.StructField("test_timestamp", T.TimestampType(), False),
    T.StructField("step", T.LongType(), False),
    T.StructField("total_latency", T.DoubleType(), False),
    T.StructField("response_time", T.DoubleType(), False),
    T.StructField("status_code", T.StringType(), False),
    T.StructField("job_title", T.StringType(), False),
    T.StructField("job_description", T.StringType(), False),
    T.StructField("org_description", T.StringType(), False),
    T.StructField("classified", T.LongType(), False),
    T.StructField("followup", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
])


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which is all a CSV can hold."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema
    ])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A CSV with a header. Blanks around a cell, quotes and line breaks inside it are kept."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    csv_ready(df).write.mode(mode).options(header=True, escape='"', **blanks).csv(path)
    return path


def beside(path: str, extension: str, suffix: str) -> str:
    """The path with a suffix after its stem: always another path than the one given."""
    return f"{path.rstrip('/').removesuffix(extension)}{suffix}"


def metrics_path(data_path: str, digits: int) -> str:
    return beside(data_path, ".parquet", f"_metrics_{digits}d.json")


def write_metrics(metrics: DataFrame, data_path: str, digits: int) -> str:
    """Nested metrics as JSON next to the data they describe."""
    path = metrics_path(data_path, digits)
    metrics.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_evaluation_run(
    spark: SparkSession, metadata: dict, results: dict[str, DataFrame], save_path: str, when: datetime | None = None
) -> str:
    """One folder per run holding its metadata and each result table as JSON; returns the folder."""
    if not metadata:
        raise ValueError("An evaluation run needs at least one entry of metadata, such as evaluation_type.")
    stamp = (when or datetime.now()).strftime("%Y%m%d_%H%M%S")
    folder = f"{save_path.rstrip('/')}/outputs/{stamp}_{metadata.get('evaluation_type', 'unnamed')}"
    spark.createDataFrame([(json.dumps(metadata),)], "value string").write.text(f"{folder}/metadata")
    for name, table in results.items():
        table.write.option("ignoreNullFields", False).json(f"{folder}/evaluation_result/{name}")
    return folder


def write_response_records(records: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Response records, one JSON object per line."""
    records.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


#: What tells a batch of results apart from all others; stored with its rows.
BATCH_SCHEMA = T.StructType([T.StructField("run_id", T.StringType(), False), T.StructField("batch_id", T.StringType(), False)])


def append_batches(df: DataFrame, path: str, schema: T.StructType = LATENCY_SCHEMA) -> str:
    """Append rows of one or more batches, none of which is there yet.

    Rows have ``run_id`` and ``batch_id`` beside the declared columns. A batch the table already holds is left out whole, so
    an append that is run again adds nothing. Only these two columns of the table are read.
    """
    whole = T.StructType([*BATCH_SCHEMA, *schema])
    require_columns(df, BATCH_SCHEMA.fieldNames())
    if _exists(df.sparkSession, path):
        names = BATCH_SCHEMA.fieldNames()
        there = df.sparkSession.read.schema(whole).parquet(path).select(names).distinct()
        df = df.join(there, names, "left_anti").select(df.columns)
    return append_results(df, path, whole)


def append_results(df: DataFrame, path: str, schema: T.StructType = LATENCY_SCHEMA) -> str:
    """Append rows to a result table after checking them against its declared schema.

    Columns that may not be null are checked while writing: a null stops the write.
    """
    problems = schema_problems(df, schema)
    if problems:
        raise ValueError(f"Rows do not fit the result table: {problems}")

    def checked(field: T.StructField):
        value = F.col(field.name)
        if field.nullable:
            return value
        failure = F.raise_error(f"{field.name} must not be null").cast(field.dataType)
        return F.when(value.isNull(), failure).otherwise(value).alias(field.name)

    df.select(*[checked(f) for f in schema]).write.mode("append").parquet(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def write_split(retained: DataFrame, distributed: DataFrame, path: str, suffixes=("_retained", "_distributed"), overwrite: bool = False) -> tuple[str, str]:
    """The two halves of a split table as two CSVs, named after ``path`` with a suffix each.

    Unless told to overwrite, existing output is an error. It is looked for before anything is written, and each
    write refuses it again.
    """
    if len(set(suffixes)) != 2 or not all(suffixes):
        raise ValueError(f"The halves need two different suffixes, not {suffixes}.")
    extension = ".csv" if path.endswith(".csv") else ""
    paths = tuple(beside(path, extension, f"{suffix}{extension}") for suffix in suffixes)
    if not overwrite:
        for target in paths:
            if _exists(retained.sparkSession, target):
                raise FileExistsError(f"{target} is there already; choose another path or overwrite it.")
    mode = "overwrite" if overwrite else "errorifexists"
    for table, target in zip((retained, distributed), paths):
        write_csv(table, target, mode)
    return paths
