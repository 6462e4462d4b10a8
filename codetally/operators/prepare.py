"""From raw coder and model tables to one code set per record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.config import ColumnConfig
from codetally.fixed_values import CODE_LENGTH
from codetally.functions.codes import clean_label, code_text, join_codes, parse_codes, text_flag
from codetally.functions.intervals import once, stems
from codetally.operators.hierarchy import Hierarchy, Side, levels_laid_out, text_side
from codetally.operators.joins import override_from_side, override_unique
from codetally.operators.validation import require_columns, validate_wide_table

ID_COL = "unique_id"
FIRST = "_first"
CONFIDENT = "_confident"


def keep_unambiguous(df: DataFrame, flag_col: str = "Unambiguous", required: bool = True, strict: bool = True) -> DataFrame:
    """Rows flagged true. Text flags may be in any case; a row without a flag is dropped.

    Text that is neither true nor false stops the job; with ``strict=False`` its row is dropped as well.
    """
    if flag_col not in df.columns and not required:
        return df
    require_columns(df, [flag_col])
    given = F.col(flag_col)
    flag = text_flag(given, df.schema[flag_col].dataType)
    if strict:
        failure = F.raise_error(F.concat(F.lit(f"{flag_col} is neither true nor false: "), given.cast("string")))
        flag = F.when(given.isNotNull() & flag.isNull(), failure.cast("boolean")).otherwise(flag)
    return df.filter(flag)


def clean_labels(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """Missing-value text to null, numeric labels padded; other columns untouched."""
    return df.withColumns({name: clean_label(F.col(name)) for name in label_cols})


def clean_wide_table(df: DataFrame, config: ColumnConfig) -> DataFrame:
    """Validate, optionally filter, clean: the table every label analysis starts from."""
    validate_wide_table(df, config)
    if config.filter_unambiguous:
        df = keep_unambiguous(df)
    return clean_labels(df, config.label_cols)


def clerical_text(
    df: DataFrame,
    four_plus: DataFrame | None = None,
    clerical_col: str = "sic_ind_occ",
    id_col: str = ID_COL,
    unique_ids: bool = False,
) -> DataFrame:
    """Three code columns as one text, replaced by the side table's text where that has one."""
    parts = [f"{clerical_col}{i}" for i in (1, 2, 3)]
    require_columns(df, [id_col, *parts])
    joined = join_codes(*[code_text(F.col(p), df.schema[p].dataType) for p in parts])
    text = df.select(id_col, joined.alias(clerical_col))
    side = four_plus and four_plus.select(
        id_col, code_text(F.col(clerical_col), four_plus.schema[clerical_col].dataType).alias(clerical_col)
    )
    if unique_ids:
        return override_unique(text, side, id_col, clerical_col)
    return text if side is None else override_from_side(text, side, id_col, clerical_col)


def clerical_code_levels(
    df: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    four_plus: DataFrame | None = None,
    clerical_col: str = "sic_ind_occ",
    out_col: str = "clerical_codes",
    id_col: str = ID_COL,
    unique_ids: bool = False,
    count_col: str | None = None,
) -> DataFrame:
    """``(id, levels)``: the valid human codes of each record at every level, one row per record.

    With ``count_col`` records with the same id and codes are one row, counted there.
    """
    text = clerical_text(df, four_plus, clerical_col, id_col, unique_ids)
    return add_up_copies(hierarchy.clean_code_sets(text, [id_col], [text_side(clerical_col, out_col)], levels), count_col)


def add_up_copies(cleaned: DataFrame, count_col: str | None) -> DataFrame:
    """Equal rows of cleaned codes as one, with their number."""
    return cleaned if count_col is None else cleaned.groupBy(*cleaned.columns).agg(F.count(F.lit(1)).alias(count_col))


def prepare_clerical_codes(
    df: DataFrame,
    hierarchy: Hierarchy,
    four_plus: DataFrame | None = None,
    clerical_col: str = "sic_ind_occ",
    out_col: str = "clerical_codes",
    digits: int | list[int] = 5,
    id_col: str = ID_COL,
    unique_ids: bool = False,
) -> DataFrame:
    """``(id, out_col)``: the valid codes the human coders gave, one row per record.

    A list of digit levels gives one row per record and level, with a ``digits`` column.
    ``unique_ids`` promises that ids are neither repeated nor null; a broken promise fails.
    """
    levels = digits if isinstance(digits, list) else [digits]
    cleaned = clerical_code_levels(df, hierarchy, levels, four_plus, clerical_col, out_col, id_col, unique_ids)
    return rows_per_level(cleaned, digits)


def rows_per_level(cleaned: DataFrame, digits: int | list[int]) -> DataFrame:
    """The sets inside ``levels`` as columns; a list of levels gives a row for each."""
    others = [c for c in cleaned.columns if c != "levels"]
    rows = cleaned.select(*others, levels_laid_out())
    return rows if isinstance(digits, list) else rows.drop("digits")


@dataclass(frozen=True)
class Fallback:
    """Where a model code set comes from when the first choice yields no valid code.

    ``column`` holds alternatives as text or as an array of structs; ``threshold`` is the confidence used to
    prune them.
    """

    column: str | None
    threshold: float = 0.0


def model_side(
    df: DataFrame, outputs: dict[str, Fallback], codes_col: str | None = "initial_code", code_name: str = "code", score_name: str = "likelihood"
) -> Side:
    """The first choice or, where that yields no valid code, a fallback, for every output."""
    codes_col = codes_col if codes_col in df.columns else None
    found = {out: f for out, f in outputs.items() if f.column in df.columns}
    if codes_col is None and not found:
        raise ValueError(f"The table has neither a first choice nor alternatives to it: {df.columns}.")
    read = {}
    if codes_col:
        read[FIRST] = stems(parse_codes(code_text(F.col(codes_col), df.schema[codes_col].dataType)), CODE_LENGTH)
    for out, fallback in found.items():
        codes, confident = _fallback_codes(df, fallback, code_name, score_name)
        read |= {out: stems(codes, CODE_LENGTH), out + CONFIDENT: stems(confident, CODE_LENGTH)}

    def decide(meant: dict[str, str], single: Callable[[str], str]) -> dict[str, str]:
        def outcome(out: str) -> str:
            if out not in found:
                return meant[FIRST]
            # Exactly one confident code stands alone; otherwise every candidate stays.
            fallback = once(meant[out + CONFIDENT], "sure", f"if({single('sure')}, sure, {meant[out]})")
            # Looked at only where the first choice names no valid code.
            return once(meant[FIRST], "first", f"if(size(first) > 0, first, {fallback})") if codes_col else fallback

        return {out: outcome(out) for out in outputs}

    return Side(read, lambda given, level: {name: f"{given}.{name}" for name in read}, decide)


def _fallback_codes(df: DataFrame, fallback: Fallback, code_name: str, score_name: str) -> tuple[Column, Column]:
    """All codes of a column of alternatives, and the confident ones.

    Text has no scores, so none of its codes is confident and nothing is pruned. A missing score counts as 0 and a NaN
    score never reaches the threshold.
    """
    dtype = df.schema[fallback.column].dataType
    if not isinstance(dtype, T.ArrayType):
        return parse_codes(code_text(F.col(fallback.column), dtype)), F.array().cast("array<string>")
    fields = dtype.elementType.fieldNames() if isinstance(dtype.elementType, T.StructType) else []
    if code_name not in fields:
        raise ValueError(f"'{fallback.column}' must hold structs with a field '{code_name}'")
    listed = F.coalesce(F.col(fallback.column), F.array().cast(dtype))

    def sure(item: Column) -> Column:
        score = F.coalesce(item[score_name].cast("double"), F.lit(0.0)) if score_name in fields else F.lit(0.0)
        return ~F.isnan(score) & (score >= fallback.threshold)

    def code(item: Column) -> Column:
        return item[code_name].cast("string")

    return F.transform(listed, code), F.transform(F.filter(listed, sure), code)


def model_code_levels(
    df: DataFrame,
    hierarchy: Hierarchy,
    outputs: dict[str, Fallback],
    levels: list[int],
    codes_col: str | None = "initial_code",
    alt_codes_name: str = "code",
    score_name: str = "likelihood",
    keep: list[str] | None = None,
    id_col: str = ID_COL,
    count_col: str | None = None,
) -> DataFrame:
    """``(id, keep, levels)``: several model code sets of each record at every level, in one pass.

    Every output is the first choice in ``codes_col`` or, where that yields no valid code, its fallback.
    ``keep`` columns are carried along and, like the id, tell records apart. With ``count_col`` records with
    the same id and codes are one row, counted there.
    """
    keep = keep or []
    require_columns(df, [id_col, *keep])
    side = model_side(df, outputs, codes_col, alt_codes_name, score_name)
    return add_up_copies(hierarchy.clean_code_sets(df, [id_col, *keep], [side], levels), count_col)


def prepare_model_codes(
    df: DataFrame,
    hierarchy: Hierarchy,
    codes_col: str | None = "initial_code",
    alt_codes_col: str | None = "alt_sic_candidates",
    out_col: str = "model_codes",
    alt_codes_name: str = "code",
    threshold: float = 0.0,
    digits: int | list[int] = 5,
    keep: list[str] | None = None,
    id_col: str = ID_COL,
) -> DataFrame:
    """``(id, out_col)``: the model's first choice, or its pruned alternatives where that is no valid code."""
    levels = digits if isinstance(digits, list) else [digits]
    outputs = {out_col: Fallback(alt_codes_col, threshold)}
    cleaned = model_code_levels(
        df, hierarchy, outputs, levels, codes_col, alt_codes_name, keep=keep, id_col=id_col
    )
    return rows_per_level(cleaned, digits)


def stack_methods(tables: dict[str, DataFrame], name_col: str = "method") -> DataFrame:
    """Tables of several models under each other, told apart by ``name_col``."""
    named = [df.withColumn(name_col, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
