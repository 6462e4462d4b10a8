"""Evaluation of semantic search: shortlists of several lengths, and the nearest candidate alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.fixed_values import CODE_LENGTH
from codetally.functions.codes import digits_label
from codetally.functions.intervals import least_is_in, stems
from codetally.operators.hierarchy import Hierarchy, Side, level_width, text_side
from codetally.operators.joins import join_on_id, join_repeated_ids
from codetally.operators.metrics import evaluation_metrics, metrics_of_pairs
from codetally.operators.prepare import add_up_copies, rows_per_level, stack_methods
from codetally.operators.repeated import compared_pairs, counted_sets, first_code, nearest_pairs
from codetally.operators.semantic import cumulative_curve, curve_points, distance_to_confidence
from codetally.operators.validation import require_unique_ids
from codetally.plans.evaluation import model_points
from codetally.plans.pairing import (
    ID_COL, TRUTH, beside_truth, code_sets, counted_rows, laid_out_beside_truth, raw_truth, truth_sets,
)


def shortlist_code_levels(
    results: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    lengths: tuple[int | None, ...] = (5, 10, None),
    results_col: str = "semantic_search_results",
    id_col: str = "unique_id",
    count_col: str | None = None,
) -> DataFrame:
    """Code sets of the first candidates per record and method: ``levels`` with a ``codes<i>`` per length.

    The candidates are the only source of codes, and their likelihoods are never negative, so there is
    nothing to prune.
    """

    def lists(read: str, level: int) -> dict[str, str]:
        return {f"codes{i}": first_of(f"{read}.at_{level}", n) for i, n in enumerate(lengths)}

    def ranked(level: int) -> Column:
        candidates = F.coalesce(distance_to_confidence(F.col(results_col), F.lit(level)), F.array())
        return stems(F.transform(candidates, lambda candidate: candidate["code"]), CODE_LENGTH)

    side = Side({f"at_{level}": ranked(level) for level in levels}, lists, lambda found, single: found)
    return add_up_copies(hierarchy.clean_code_sets(results, [id_col, "method"], [side], levels), count_col)


def first_of(listed: str, length: int | None) -> str:
    """The first entries of a list in SQL text, all of them where no length is given."""
    return listed if length is None else f"if(size({listed}) <= {length}, {listed}, slice({listed}, 1, {length}))"


def rows_per_length(df: DataFrame, lengths: tuple[int | None, ...]) -> DataFrame:
    """One row per shortlist length; no length is shown as ``All``."""
    named = F.array(*[
        F.struct(F.lit("All" if n is None else str(n)).alias("shortlist_size"), F.col(f"codes{i}").alias("initial_codes"))
        for i, n in enumerate(lengths)
    ])
    others = [c for c in df.columns if c not in {f"codes{i}" for i in range(len(lengths))}]
    return df.select(*others, F.inline(named))


def rows_per_set(df: DataFrame, lengths: tuple[int | None, ...]) -> DataFrame:
    """The same with equal sets of a record as one row: ``shortlist_size`` lists all lengths that give the set."""
    sized = F.array(*[
        F.struct(F.lit("All" if n is None else str(n)).alias("size"), F.col(f"codes{i}").alias("codes")) for i, n in enumerate(lengths)
    ])
    different = F.array_distinct(F.array(*[F.col(f"codes{i}") for i in range(len(lengths))]))

    def with_sizes(codes: Column) -> Column:
        sizes = F.transform(F.filter(sized, lambda s: s["codes"] == codes), lambda s: s["size"])
        return F.struct(sizes.alias("shortlist_size"), codes.alias("initial_codes"))

    others = [c for c in df.columns if c not in {f"codes{i}" for i in range(len(lengths))}]
    return df.select(*others, F.inline_outer(F.transform(different, with_sizes)))


def shortlist_codes(
    results: DataFrame, hierarchy: Hierarchy, levels: list[int], lengths: tuple[int | None, ...] = (5, 10, None), **options
) -> DataFrame:
    """Code sets of the first candidates, per record, method, digit level and shortlist length."""
    cleaned = shortlist_code_levels(results, hierarchy, levels, lengths, **options)
    return rows_per_length(rows_per_level(cleaned, levels), lengths)


def nearest_first(results: Column) -> Column:
    """The codes of search results, nearest first, equal distances by code. A single result needs no distance."""
    usable = F.filter(results, lambda c: c["distance"].isNotNull() & ~F.isnan(c["distance"].cast("double")))
    ordered = F.sort_array(F.transform(usable, lambda c: F.struct(c["distance"].cast("double").alias("distance"), c["code"].cast("string").alias("code"))))
    codes = F.transform(ordered, lambda c: c["code"])
    return F.when(F.size(results) == 1, F.transform(results, lambda c: c["code"].cast("string"))).otherwise(codes)


def shortlist_side(col: str, lengths: tuple[int | None, ...], levels: list[int]) -> Side:
    """Sets ``codes<i>`` of the first candidates of a list of codes, nearest first, per length.

    The list is in order at every level: what remains of it when codes are cut and repetitions dropped.
    """
    def lists(read: str, level: int) -> dict[str, str]:
        return {f"codes{i}": first_of(f"{read}.at_{level}", n) for i, n in enumerate(lengths)}

    codes = F.coalesce(F.col(col), F.array().cast("array<string>"))
    cut = {n: F.array_distinct(F.transform(codes, lambda code: F.substring(code, F.lit(1), level_width(F.lit(n))))) for n in levels}
    return Side({f"at_{n}": stems(listed, CODE_LENGTH) for n, listed in cut.items()}, lists, lambda found, single: found)


def raw_searches(searches: dict[str, DataFrame], content: dict[str, Column], unique_ids: bool, count_col: str) -> DataFrame:
    """Raw content of each record's results, equal records counted."""
    stacked = stack_methods(searches).select(ID_COL, "method", *[c.alias(name) for name, c in content.items()])
    if unique_ids:
        require_unique_ids(stacked, [ID_COL, "method"])
    return counted_rows(stacked, count_col, unique_ids)


def counted_searches(
    searches: dict[str, DataFrame], clerical: DataFrame, four_plus: DataFrame | None, content: dict[str, Column], unique_ids: bool
) -> DataFrame:
    """Raw content of each record's results beside its raw human codes, equal records counted in ``records``."""
    found = raw_searches(searches, content, unique_ids, "n_model")
    truth = raw_truth(clerical, four_plus, unique_ids)
    joined = join_on_id(found, truth, ID_COL, nulls_match=False) if unique_ids else join_repeated_ids(found, truth, ID_COL)
    return joined.withColumn("records", F.col("n_model") * F.col("n_truth"))


def searches_beside_truth(
    searches: dict[str, DataFrame],
    clerical: DataFrame,
    four_plus: DataFrame | None,
    hierarchy: Hierarchy,
    levels: list[int],
    content: dict[str, Column],
) -> DataFrame:
    """Raw content of each record's results beside its human code sets, where ids are unique."""
    found = raw_searches(searches, content, True, "n_model")
    return beside_truth(found, clerical, four_plus, hierarchy, levels).withColumn("records", F.col("n_model") * F.col("n_truth"))


def shortlist_sweep(
    searches: dict[str, DataFrame],
    clerical: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    lengths: tuple[int | None, ...] = (5, 10, None),
    four_plus: DataFrame | None = None,
    results_col: str = "semantic_search_results",
    unique_ids: bool = False,
) -> DataFrame:
    """All metrics for every search, digit level and shortlist length, from one aggregation."""
    content = {"_listed": nearest_first(F.col(results_col))}
    by = ["digits", "method", "shortlist_size"]
    if not unique_ids:
        found = raw_searches(searches, content, False, "records")
        listed = code_sets(found, hierarchy, [shortlist_side("_listed", lengths, levels)], levels, [ID_COL, "method"])
        coded = counted_sets(rows_per_set(listed, lengths), [ID_COL, *by], "initial_codes")
        truth = truth_sets(clerical, four_plus, hierarchy, levels)
        # Short lists are the same at every length, and so are their pairs, which are added up before they count for each.
        compared = compared_pairs(truth, coded, ID_COL, ["method", "shortlist_size"])
        added = compared.groupBy(*[c for c in compared.columns if c != "records"]).agg(F.sum("records").alias("records"))
        return metrics_of_pairs(added.withColumn("shortlist_size", F.explode("shortlist_size")), by)
    rows = searches_beside_truth(searches, clerical, four_plus, hierarchy, levels, content)
    found = hierarchy.sets_of(rows, ["method", "records", TRUTH], [shortlist_side("_listed", lengths, levels)], levels)
    sets = laid_out_beside_truth(found, ["method"])
    return evaluation_metrics(rows_per_length(sets, lengths), by=by, prepared=True, count_col="records")


def nearest_content(results_col: str) -> dict[str, Column]:
    """Code and distance of the nearest candidate."""
    nearest = F.get(F.col(results_col), F.lit(0))
    return {"_nearest": nearest["code"].cast("string"), "top_distance": F.nanvl(nearest["distance"].cast("double"), F.lit(None).cast("double"))}


def nearest_side() -> Side:
    return text_side("_nearest", "top_candidate", lambda code: F.array_compact(F.array(code)))


def nearest_candidates(
    searches: dict[str, DataFrame],
    clerical: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    four_plus: DataFrame | None = None,
    results_col: str = "semantic_search_results",
    unique_ids: bool = False,
) -> DataFrame:
    """Nearest candidate beside the human codes, both as intervals, per record, method and digit
    level; a row stands for ``records``."""
    content, by = nearest_content(results_col), [ID_COL, "method", "top_distance"]
    if unique_ids:
        rows = searches_beside_truth(searches, clerical, four_plus, hierarchy, levels, content)
        sets = laid_out_beside_truth(hierarchy.sets_of_one(rows, [*by, "records", TRUTH], "_nearest", "top_candidate", levels), by)
    else:
        rows = counted_searches(searches, clerical, four_plus, content, False)
        sets = code_sets(rows, hierarchy, [text_side(TRUTH, "clerical_codes"), nearest_side()], levels, by)
    return sets.withColumn("top_in_truth", least_is_in(F.col("top_candidate"), F.col("clerical_codes")))


def nearest_points(
    searches: dict[str, DataFrame],
    clerical: DataFrame,
    hierarchy: Hierarchy,
    levels: list[int],
    four_plus: DataFrame | None = None,
    results_col: str = "semantic_search_results",
) -> DataFrame:
    """The points that ``curve_points`` makes of ``nearest_candidates`` where ids may repeat, counted without forming pairs."""
    found = raw_searches(searches, nearest_content(results_col), False, "records")
    sets = code_sets(found, hierarchy, [nearest_side()], levels, [ID_COL, "method", "top_distance"])
    by = ["method", "top_distance"]
    least = first_code(F.array_min("top_candidate")).alias("_least")
    nearest = sets.groupBy(ID_COL, "digits", *by, least).agg(F.sum("records").alias("records"))
    pairs = nearest_pairs(truth_sets(clerical, four_plus, hierarchy, levels), nearest, ID_COL, by, "_least")
    kinds = F.when(F.col("single_truth"), F.array(F.lit("MO"), F.lit("OO"))).otherwise(F.array(F.lit("MO")))
    return pairs.select("digits", *by, "top_in_truth", "records", F.explode(kinds).alias("match_type"))


def nearest_candidate_curves(
    searches: dict[str, DataFrame], clerical: DataFrame, hierarchy: Hierarchy, levels: list[int], unique_ids: bool = False, **options
) -> DataFrame:
    """Codability against accuracy as the allowed distance grows, per method, digit level and match type."""
    if unique_ids:
        nearest = nearest_candidates(searches, clerical, hierarchy, levels, unique_ids=True, **options)
        points = curve_points(nearest, ["digits", "method"], count_col="records")
    else:
        points = nearest_points(searches, clerical, hierarchy, levels, **options)
    curve = cumulative_curve(points, ["digits", "method", "match_type"], count_col="records")
    return curve.withColumn("digits", digits_label(F.col("digits")))


def curves_beside_model(curves: DataFrame, model_metrics: DataFrame) -> DataFrame:
    """The curves with one model's points under them; a point has neither distance nor counts."""
    return curves.unionByName(model_points(model_metrics), allowMissingColumns=True)
