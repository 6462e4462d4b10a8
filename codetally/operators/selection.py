"""Choosing and reshaping rows: windows of rows, samples, access-code splits, request and response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.lineage import order_of, split_by_rank
from codetally.operators.validation import require_columns, require_more_rows

# What a stored response holds that is used later. ``classified`` may be a boolean or a number.
RESPONSE_SCHEMA = "results array<struct<classified string, followup string, code string>>, error string"


#: Up to so many rows from the start, each task keeps its first rows and one task merges them.
FEW_ROWS = 10_000


def take_window(df: DataFrame, order_cols: list[str], skip: int = 0, take: int | None = None) -> DataFrame:
    """Skip ``skip`` rows and take ``take`` rows, or all others, in the order of ``order_cols``, nulls last.

    Rows equal there follow the order of their other columns. A window that ends within the first ``FEW_ROWS`` rows is
    an ordered limit and writes nothing; for any other, rows are dealt by ranges and written, see ``split_by_rank``.
    """
    skip = max(0, skip)
    if not skip and take is None:
        return df
    if take is not None and skip + take <= FEW_ROWS:
        return df.orderBy(order_of(df, order_cols)).offset(skip).limit(max(0, take))
    return split_by_rank(df, order_cols, skip, None if take is None else skip + take)[0]


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones for the same seed in any engine and row order."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return df.orderBy(draw, id_col).limit(n)


def lookup_text(sample: DataFrame, stacked: DataFrame, text_col: str, id_col: str = "unique_id", method_col: str = "method") -> DataFrame:
    """The text each model holds for each sampled id."""
    require_columns(stacked, [id_col, method_col, text_col])
    return stacked.select(id_col, method_col, text_col).join(sample.select(id_col).distinct(), id_col, "left_semi")


def reformat_access_codes(
    df: DataFrame, id_col: str = "survey_access_id", code_col: str = "one_time_passcode",
    id_name: str = "participant_id", code_name: str = "passcode",
) -> DataFrame:
    """Hyphens in the passcode become spaces, both columns get the names used for hand-over."""
    require_columns(df, [id_col, code_col])
    spaced = df.withColumn(code_col, F.translate(F.col(code_col).cast("string"), "-", " "))
    return spaced.withColumnsRenamed({id_col: id_name, code_col: code_name})


def split_retained(df: DataFrame, order_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """``(retained, distributed)``: rows 2 to ``n + 1`` in key order are distributed, all others retained.

    Every row is in exactly one half. Rows without a key are retained; rows that share one follow the order of their
    other columns, so exactly ``n`` rows are distributed. The table is written, dealt by ranges, and its rows with a key
    are counted, to fail early when there are too few.
    """
    if n <= 0:
        raise ValueError(f"At least one row has to be distributed, not {n}.")
    require_more_rows(df.filter(F.col(order_col).isNotNull()).count(), n)
    # Nulls come last, so the first rows all have a key.
    distributed, retained = split_by_rank(df, [order_col], 1, n + 1)
    return retained, distributed


def request_payload(columns: dict[str, str | Column], constants: dict[str, str]) -> Column:
    """The request body as JSON text: constants, then the given columns under their request names."""
    fields = [F.lit(value).alias(name) for name, value in constants.items()]
    fields += [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def build_requests(df: DataFrame, id_col: str, columns: dict[str, str | Column], constants: dict[str, str]) -> DataFrame:
    """``(unique_id, request_payload)`` for every record."""
    return df.select(F.col(id_col).alias("unique_id"), request_payload(columns, constants).alias("request_payload"))


def flatten_responses(df: DataFrame, body_col: str, keep: list[str]) -> DataFrame:
    """First result of each stored response as columns, with defaults where there is none.

    A response that cannot be read, or has no result, counts as not classified.
    """
    body = F.from_json(F.col(body_col), RESPONSE_SCHEMA)
    first = F.try_element_at(body["results"], F.lit(1))
    said = F.lower(first["classified"])
    classified = F.when(said == "true", 1).when(said == "false", 0).otherwise(said.try_cast("int"))
    return df.select(
        *keep,
        F.coalesce(classified, F.lit(0)).alias("classified"),
        F.coalesce(first["followup"], F.lit("")).alias("followup"),
        F.coalesce(first["code"], F.lit("")).alias("code"),
        body["error"].alias("error"),
    )


def response_shapes(df: DataFrame, body_col: str, keep: list[str]) -> DataFrame:
    """What each stored response holds, whatever its shape: the type of ``classified`` in its first result, in the words of
    JSON, how many results there are, and whether the text is no JSON at all.

    The type is null where there is no such entry, ``null`` where it is null. Nothing is declared beforehand, so
    responses whose shape changed are read as they are.
    """
    body = F.try_parse_json(F.col(body_col))
    entry = F.try_variant_get(body, "$.results[0].classified", "variant")
    kind = F.schema_of_variant(entry)
    told = (
        F.when(kind == "VOID", "null").when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.isNotNull(), "number")
    )
    listed = F.try_variant_get(body, "$.results", "array<variant>")
    return df.select(
        *keep,
        told.alias("classified_type"),
        F.coalesce(F.size(listed), F.lit(0)).cast("bigint").alias("n_results"),
        (F.col(body_col).isNotNull() & body.isNull()).alias("malformed"),
    )


def response_records(df: DataFrame, body_col: str, id_col: str, payload_col: str) -> DataFrame:
    """Stored responses with the record id and the request that led to them."""
    flat = flatten_responses(df, body_col, [id_col, payload_col])
    return flat.withColumnsRenamed({id_col: "unique_id", payload_col: "request_payload"})


def keep_members(df: DataFrame, col: str, members: DataFrame) -> DataFrame:
    """Rows whose value is in a one-column table."""
    return df.join(members.toDF(col), col, "left_semi")
