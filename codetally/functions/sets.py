"""Code sets: distinct, sorted ``array<string>`` columns. An empty set is ``array()``, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.fixed_values import INVALID_TOKENS, MATCH_METHODS


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row rather than at each place ``body`` uses it."""
    return F.aggregate(F.array(), value, lambda kept, _: kept, body)


def empty_set() -> Column:
    return F.array().cast("array<string>")


def code_set(col: Column, dtype: T.DataType) -> Column:
    """A scalar or array column as a code set; texts are taken whole, never split."""
    values = F.array(col.cast("string"))
    if isinstance(dtype, T.ArrayType):
        values = col if isinstance(dtype.elementType, T.StringType) else F.transform(col, lambda c: c.cast("string"))
    never_codes = F.array(*[F.lit(token) for token in INVALID_TOKENS], F.lit(None).cast("string"))
    return F.coalesce(F.sort_array(F.array_except(values, never_codes)), empty_set())


def is_single(codes: Column) -> Column:
    return F.size(codes) == 1


def is_ambiguous(codes: Column) -> Column:
    """Not exactly one code, so an empty set is ambiguous too."""
    return F.size(codes) != 1


def overlaps(left: Column, right: Column) -> Column:
    return F.arrays_overlap(left, right)


def codes_match(truth: Column, model: Column, method: str = "MM") -> Column:
    """Do two code sets agree? First letter: one/many human codes, second: one/many model codes."""
    if method not in MATCH_METHODS:
        raise ValueError(f"{method!r} is none of the ways to compare code sets: {MATCH_METHODS}.")
    match = overlaps(truth, model)
    if method[0] == "O":
        match = is_single(truth) & match
    # "OM" asks for a single human code, "MO" for a single model code.
    if method in ("OO", "MO"):
        match = is_single(model) & match
    return match


def jaccard(left: Column, right: Column) -> Column:
    """Shared codes over all codes; two empty sets agree fully. Nulls inside are ignored."""
    a, b = F.array_compact(left), F.array_compact(right)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def only_member(codes: Column) -> Column:
    """The code of a one-code set, else null."""
    return F.when(is_single(codes), F.get(codes, F.lit(0)))


def fill_empty(codes: Column, other: Column) -> Column:
    return F.when(F.size(codes) == 0, other).otherwise(codes)


def shortlist(candidates: Column, length: int | None) -> Column:
    """First ``length`` entries of a ranked list, all of them when no length is given."""
    return F.slice(candidates, 1, length) if length else candidates


def both_single(left: Column, right: Column) -> Column:
    return is_single(left) & is_single(right)


def few_but_not_single(left: Column, right: Column, below: int = 3) -> Column:
    """Both sets small, at least one of them not a single code."""
    return (F.size(left) < below) & (F.size(right) < below) & ~both_single(left, right)


def set_text(codes: Column) -> Column:
    """A code set as one sorted ``;``-separated text."""
    return F.array_join(F.sort_array(codes), ";")
