"""Human and model codes side by side: joined as raw text and only then turned into code sets.

What is moved between tasks are the short raw texts and candidate lists. Sets are intervals of numbered codes, a few
numbers however many codes a short text means, made and compared in the task that has the joined row. Where ids may
repeat, sets are made and counted per table, and pairs are counted without being formed (``operators.repeated``); with
final codes, which take part by a join of their own, equal records are counted before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetally.functions.codes import code_text
from codetally.operators.hierarchy import Hierarchy, Side, levels_laid_out, text_side
from codetally.operators.joins import join_on_id, join_repeated_ids
from codetally.operators.prepare import Fallback, clerical_text, model_side
from codetally.operators.repeated import compared_pairs, counted_sets
from codetally.operators.validation import require_columns, require_unique_ids

ID_COL = "unique_id"
TRUTH, FIRST, ALTERNATIVES, FINAL, ROUND = "_truth", "_first", "_alternatives", "_final", "_round"
FIRST_ROUND = "coder_round_1"


def counted_rows(df: DataFrame, count_col: str, unique: bool) -> DataFrame:
    """Equal rows as one with their number; where ids are unique there is nothing to count."""
    if unique:
        return df.withColumn(count_col, F.lit(1).cast("bigint"))
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count_col))


def raw_truth(clerical: DataFrame, four_plus: DataFrame | None, unique_ids: bool) -> DataFrame:
    """``unique_id``, the text of the human codes and ``n_truth``."""
    text = clerical_text(clerical, four_plus, unique_ids=unique_ids).withColumnRenamed("sic_ind_occ", TRUTH)
    return counted_rows(text, "n_truth", unique_ids)


def raw_model(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """The raw columns a model's codes are read from, candidates reduced to code and likelihood."""
    require_columns(df, [ID_COL, *by])

    def raw(source: str):
        kind = df.schema[source].dataType
        if not isinstance(kind, T.ArrayType):
            return code_text(F.col(source), kind)
        fields = kind.elementType.fieldNames() if isinstance(kind.elementType, T.StructType) else []
        if "code" not in fields:
            raise ValueError(f"'{source}' must hold structs with a field 'code'")
        score = (lambda c: c["likelihood"].cast("double")) if "likelihood" in fields else (lambda c: F.lit(0.0))
        return F.transform(source, lambda c: F.struct(c["code"].cast("string").alias("code"), score(c).alias("likelihood")))

    return df.select(ID_COL, *by, *[raw(source).alias(name) for name, source in columns.items() if source in df.columns])


def code_sets(rows: DataFrame, hierarchy: Hierarchy, sides: list[Side], levels: list[int], by: list[str]) -> DataFrame:
    """``by``, ``records``, ``digits`` and the sets of all sides as intervals, for rows that hold raw columns and ``records``."""
    found = hierarchy.sets_of(rows, [*by, "records"], sides, levels)
    return found.select(*by, "records", levels_laid_out())


def beside_truth(
    rows: DataFrame, clerical: DataFrame, four_plus: DataFrame | None, hierarchy: Hierarchy, levels: list[int]
) -> DataFrame:
    """Rows beside the human code sets of their record where ids are unique: ``TRUTH`` has them at all levels.

    They are made once per record, however many rows it has, and after its text was moved.
    """
    texts = raw_truth(clerical, four_plus, True).repartition(ID_COL)
    sets = hierarchy.sets_of(texts, [ID_COL, "n_truth"], [text_side(TRUTH, "clerical_codes")], levels)
    return join_on_id(rows, sets.withColumnRenamed("levels", TRUTH), ID_COL, nulls_match=False)


def laid_out_beside_truth(found: DataFrame, by: list[str]) -> DataFrame:
    """What ``code_sets`` gives, of sets in ``levels`` and the human code sets of the same levels."""
    laid_out = found.select(*by, "records", TRUTH, F.posexplode_outer("levels").alias("_at", "_level"))
    truth = F.get(TRUTH, F.col("_at"))["clerical_codes"].alias("clerical_codes")
    return laid_out.select(*by, "records", truth, "_level.*")


def coded_records(
    model: DataFrame,
    clerical: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    four_plus: DataFrame | None = None,
    threshold: float = 0.0,
    unique_ids: bool = False,
    by: list[str] | None = None,
    first_round: DataFrame | None = None,
    first_round_four_plus: DataFrame | None = None,
) -> DataFrame:
    """Human, initial and (where the model table has ``final_sic``) final code sets per digit level, equal records counted.

    Records that share an id all pair up; counting them first keeps that to one row per different pair, and hot ids are
    dealt over several tasks. ``unique_ids``
    promises ids that are neither null nor repeated, per ``by``; a broken promise fails. ``first_round``, an earlier
    round of human coding, takes part as if it were a model.
    """
    by = by or []
    if unique_ids:
        require_unique_ids(model, [ID_COL, *by])
    made = raw_outputs(model, by, unique_ids, first_round, first_round_four_plus)
    counted = counted_rows(made, "n_model", unique_ids)
    if unique_ids:
        rows = beside_truth(counted, clerical, four_plus, hierarchy, levels).withColumn("records", F.col("n_model") * F.col("n_truth"))
        found = hierarchy.sets_of(rows, [*by, "records", TRUTH], output_sides(rows, threshold), levels)
        return with_first_round(laid_out_beside_truth(found, by), by)

    joined = join_repeated_ids(counted, raw_truth(clerical, four_plus, False), ID_COL)
    joined = joined.withColumn("records", F.col("n_model") * F.col("n_truth"))
    sides = [text_side(TRUTH, "clerical_codes"), *output_sides(joined, threshold)]
    if "final_sic" in model.columns:
        # Final codes of all records with the id, as a join of the two tables gives them.
        renamed = {"_final_first": "initial_code", "_final_text": "final_sic"}
        final = counted_rows(raw_model(model, [], renamed), "n_final", False)
        joined = join_repeated_ids(joined, final, ID_COL).withColumn("records", F.col("records") * F.col("n_final"))
        sides.append(model_side(final, {"final_codes": Fallback("_final_text")}, "_final_first"))
    return with_first_round(code_sets(joined, hierarchy, sides, levels, by), by)


def raw_outputs(
    model: DataFrame, by: list[str], with_final: bool, first_round: DataFrame | None, first_round_four_plus: DataFrame | None
) -> DataFrame:
    """The raw columns of the models, and of an earlier round of human coding under them."""
    names = {FIRST: "initial_code", ALTERNATIVES: "alt_sic_candidates", **({FINAL: "final_sic"} if with_final else {})}
    made = raw_model(model, by, names)
    if first_round is None:
        return made
    # Read like a first choice that has no alternatives, unless final codes are read beside it.
    role = FIRST if FIRST in made.columns and FINAL not in made.columns else ROUND
    earlier = clerical_text(first_round, first_round_four_plus, unique_ids=with_final).withColumnRenamed("sic_ind_occ", role)
    return made.unionByName(earlier.withColumn(by[0], F.lit(FIRST_ROUND)), allowMissingColumns=True)


def output_sides(rows: DataFrame, threshold: float) -> list[Side]:
    """How the code sets of the models, and of an earlier round, are read."""
    outputs = {"initial_codes": Fallback(ALTERNATIVES, threshold)}
    if FINAL in rows.columns:
        outputs["final_codes"] = Fallback(FINAL)
    return [model_side(rows, outputs, FIRST), *([text_side(ROUND, "_round_codes")] if ROUND in rows.columns else [])]


def with_first_round(sets: DataFrame, by: list[str]) -> DataFrame:
    """An earlier round's codes in the place of a model's, where they have a column of their own."""
    if "_round_codes" not in sets.columns:
        return sets
    chosen = F.when(F.col(by[0]) == FIRST_ROUND, F.col("_round_codes")).otherwise(F.col("initial_codes"))
    return sets.withColumn("initial_codes", chosen).drop("_round_codes")


def truth_sets(clerical: DataFrame, four_plus: DataFrame | None, hierarchy: Hierarchy, levels: list[int]) -> DataFrame:
    """Human code sets per id and digit level where ids may repeat, equal ones counted."""
    rows = raw_truth(clerical, four_plus, False).withColumnRenamed("n_truth", "records")
    sets = code_sets(rows, hierarchy, [text_side(TRUTH, "clerical_codes")], levels, [ID_COL])
    return counted_sets(sets, [ID_COL, "digits"], "clerical_codes")


def compared_records(
    model: DataFrame,
    clerical: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    four_plus: DataFrame | None = None,
    threshold: float = 0.0,
    by: list[str] | None = None,
    first_round: DataFrame | None = None,
    first_round_four_plus: DataFrame | None = None,
) -> DataFrame:
    """What ``coded_records`` gives where ids may repeat and there are no final codes, as counted comparisons: no pair is formed."""
    by = by or []
    made = raw_outputs(model, by, False, first_round, first_round_four_plus)
    rows = counted_rows(made, "records", False)
    sets = with_first_round(code_sets(rows, hierarchy, output_sides(rows, threshold), levels, [ID_COL, *by]), by)
    coded = counted_sets(sets, [ID_COL, *by, "digits"], "initial_codes")
    return compared_pairs(truth_sets(clerical, four_plus, hierarchy, levels), coded, ID_COL, by)
