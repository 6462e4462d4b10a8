"""Cleaning and flagging of single code columns. Everything here is Column -> Column."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.fixed_values import (
    CODE_LENGTH,
    CODE_PATTERN,
    FOUR_OR_MORE,
    INVALID_TOKENS,
    MISSING_TOKENS,
    NOT_CODABLE,
)

logger = logging.getLogger(__name__)

# Decimal text only. Spark's own cast also takes "12d", which is not a number here.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_BLANKS = " \t\n\r\f\v"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def code_text(col: Column, dtype: T.DataType) -> Column:
    """A code column as text. Whole numbers read as floating point lose their ``.0``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (~F.isnan(col)) & (col == F.floor(col))
        return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def pad_digits(code: Column, width: int = CODE_LENGTH) -> Column:
    """Zero-pad on the left without ever shortening."""
    return F.lpad(code, F.greatest(F.length(code), F.lit(width)), F.lit("0"))


def _padded_number(text: Column, as_it_was: Column) -> Column:
    """Numeric text as a whole number of at least five characters, zeros after the sign."""
    whole = F.trim(text).try_cast("double").try_cast("bigint")
    return F.when(whole.isNotNull(), F.format_string(f"%0{CODE_LENGTH}d", whole)).otherwise(as_it_was)


def pad_numeric_label(col: Column) -> Column:
    """Numeric-looking labels become whole numbers padded to five digits; all else stays."""
    return (
        F.when(col.rlike(r"\A[0-9]{1,5}\z"), F.lpad(col, CODE_LENGTH, "0"))
        .when(col.rlike(_NUMBER) & (col != NOT_CODABLE), _padded_number(col, col))
        .otherwise(col)
    )


def null_missing_label(col: Column) -> Column:
    """Text that spells a missing value becomes null."""
    return F.when(~col.isin(MISSING_TOKENS), col)


def clean_label(col: Column) -> Column:
    """Both of the above. No text that spells a missing value looks like a number."""
    text = col.cast("string")
    return F.when(~text.isin(MISSING_TOKENS), pad_numeric_label(text))


def parse_codes(text: Column, pattern: str = CODE_PATTERN, width: int = CODE_LENGTH) -> Column:
    """Every code written in a text, zero-padded, distinct and sorted.

    The special codes are deleted wherever they occur, so ``14+`` reads as ``1``.
    """
    empty = F.array().cast("array<string>")
    try:
        re.compile(pattern)
    except re.error as error:
        logger.warning("%r is no regular expression (%s), so no codes are read.", pattern, error)
        return empty
    trimmed = F.btrim(text, F.lit(_BLANKS))
    bare = F.replace(F.replace(trimmed, F.lit(NOT_CODABLE)), F.lit(FOUR_OR_MORE))
    found = F.regexp_extract_all(bare, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0))
    padded = F.array_sort(F.array_distinct(F.transform(found, lambda code: pad_digits(code, width))))
    return F.when(text.isNull() | trimmed.isin(INVALID_TOKENS), empty).otherwise(padded)


def code_stem(code: Column) -> Column:
    """The known digits of a code: trailing x's cut, null unless only digits remain."""
    stem = F.rtrim(code, F.lit("xX"))
    return F.when(stem.rlike("^[0-9]+$"), stem)


def division(label: Column) -> Column:
    """First two characters of a label."""
    return F.substring(label, 1, 2)


def join_codes(*cols: Column) -> Column:
    """Codes of several columns as one ``;``-separated text, nulls skipped."""
    return F.concat_ws(";", *cols)


def is_not_codable(col: Column) -> Column:
    return F.coalesce(col == NOT_CODABLE, F.lit(False))


def is_four_or_more(col: Column) -> Column:
    return F.coalesce(col == FOUR_OR_MORE, F.lit(False))


def leading_division(col: Column) -> Column:
    """Two leading digits, or an empty text when the code is special or starts otherwise."""
    usable = col.rlike("^[0-9]{2}") & ~is_not_codable(col) & ~is_four_or_more(col)
    return F.when(usable, division(col)).otherwise("")


def answer_count(first: Column, *others: Column) -> Column:
    """How many codes were given; ``-9`` counts as none and ``4+`` as four."""
    given = [
        F.coalesce(c.isNotNull() & (F.btrim(c, F.lit(_BLANKS)) != "") & (F.upper(c) != "NA"), F.lit(False)).cast("int")
        for c in (first, *others)
    ]
    return F.when(is_not_codable(first), 0).when(is_four_or_more(first), 4).otherwise(sum(given[1:], given[0]))


def is_five_digits(col: Column) -> Column:
    return F.coalesce(col.rlike("^[0-9]{5}$"), F.lit(False))


def has_unknown_digits(col: Column, unknown: int) -> Column:
    """Five characters, digits and x's only, exactly ``unknown`` x's, at least one digit."""
    text = F.coalesce(col, F.lit(""))
    return (
        (F.length(text) == CODE_LENGTH)
        & text.rlike("^[0-9xX]*$")
        & text.rlike("[0-9]")
        & (F.regexp_count(text, F.lit("[xX]")) == unknown)
    )


def to_number(col: Column, dtype: T.DataType) -> Column:
    """A score as double; text that is not a number, and NaN, become null."""
    if isinstance(dtype, T.StringType):
        col = F.when(col.rlike(_NUMBER) | col.rlike(_INFINITY), F.trim(col).try_cast("double"))
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def row_max(cols: list[Column]) -> Column:
    """Largest non-null value of a row."""
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def text_flag(col: Column, dtype: T.DataType | None = None) -> Column:
    """``true``/``false`` in any case as a boolean; everything else is null."""
    if isinstance(dtype, T.BooleanType):
        return col
    lowered = F.lower(col.cast("string"))
    return F.when(lowered == "true", True).when(lowered == "false", False)


def digits_label(digits: Column) -> Column:
    """Digit level as shown in tables: ``S`` for section level."""
    return F.when(digits == 0, "S").otherwise(digits.cast("string"))


def parse_digits(text: str | None) -> int:
    """Digit level as typed by a user: nothing means 5, ``S`` means section level."""
    if text is None:
        return CODE_LENGTH
    if text not in ("0", "1", "2", "3", "4", "5", "S"):
        raise ValueError(f"{text!r} is no digit level; use 0 to 5, or S for sections.")
    return 0 if text == "S" else int(text)


def relabel(col: Column, mapping: dict[str, str]) -> Column:
    """Replace listed category names, keep the others."""
    text = col.cast("string")
    out = text
    for old, new in mapping.items():
        out = F.when(text == old, new).otherwise(out)
    return out
