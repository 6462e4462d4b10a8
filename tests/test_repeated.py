import random
import re

import pytest
from pyspark.sql import functions as F

from codetally import Hierarchy
from codetally.operators import joins, repeated
from codetally.operators.metrics import evaluation_metrics, flatten_metrics
from codetally.operators.semantic import cumulative_curve, curve_points
from codetally.plans import search as S
from codetally.plans.evaluation import sweep
from codetally.plans.pairing import coded_records
from codetally.plans.search import nearest_candidate_curves, nearest_candidates, shortlist_sweep
from tests.conftest import HEALTH

CODES = [*HEALTH, "861xx", "86xxx", "8xxxx", "01110", "01420", "0xxxx", "05100", "20100", "66xxx", "66210", "99999", "nan"]
BY = ["digits", "method", "shortlist_size"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    ids = [1, 1, 1, 2, 3, None]
    some = lambda n: rng.sample(CODES, rng.randrange(n + 1))
    texts = [(rng.choice(ids), *(some(3) + [None] * 3)[:3]) for _ in range(60)]
    clerical = spark.createDataFrame(texts, "unique_id bigint, sic_ind_occ1 string, sic_ind_occ2 string, sic_ind_occ3 string")
    made = [(rng.choice([*ids, 9]), rng.choice([None, None, "86101", "86xxx"]), [(c, rng.choice([0.2, 0.8])) for c in some(3)]) for _ in range(60)]
    model = spark.createDataFrame(made, "unique_id bigint, initial_code string, alt_sic_candidates array<struct<code:string,likelihood:double>>")
    lists = [(rng.choice([*ids, 9]), [(c, rng.randrange(1, 9) / 10) for c in some(14)]) for _ in range(50)]
    found = spark.createDataFrame(lists, "unique_id bigint, semantic_search_results array<struct<code:string,distance:double>>")
    return clerical, model, found


def rows_of(df, order):
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)


@pytest.mark.parametrize(("longest", "most"), [(8, 2000), (2, 2000), (8, 5)])
def test_counted_pairs_equal_formed_pairs(spark, hierarchy, tables, monkeypatch, longest, most):
    monkeypatch.setattr(repeated, "LONGEST", longest)
    monkeypatch.setattr(repeated, "MOST_COMBINATIONS", most)
    clerical, model, found = tables
    levels = [0, 3, 5]
    got = flatten_metrics(sweep({"m": model}, clerical, hierarchy, levels, threshold=0.7), BY[:2])
    formed = coded_records(model.withColumn("method", F.lit("m")), clerical, hierarchy, levels, threshold=0.7, by=["method"])
    want = flatten_metrics(evaluation_metrics(formed, by=BY[:2], prepared=True, count_col="records"), BY[:2])
    assert rows_of(got, want.columns) == rows_of(want, want.columns)

    got = flatten_metrics(shortlist_sweep({"s": found}, clerical, hierarchy, levels, (2, None)), BY)
    rows = S.counted_searches({"s": found}, clerical, None, {"_listed": S.nearest_first(F.col("semantic_search_results"))}, False)
    sides = [S.text_side(S.TRUTH, "clerical_codes"), S.shortlist_side("_listed", (2, None), levels)]
    sets = S.rows_per_length(S.code_sets(rows, hierarchy, sides, levels, ["method"]), (2, None))
    want = flatten_metrics(evaluation_metrics(sets, by=BY, prepared=True, count_col="records"), BY)
    assert rows_of(got, want.columns) == rows_of(want, want.columns)


def test_counted_curves_equal_those_of_formed_pairs(spark, hierarchy, tables):
    clerical, _, found = tables
    got = nearest_candidate_curves({"s": found}, clerical, hierarchy, [5, 2, 0])
    points = curve_points(nearest_candidates({"s": found}, clerical, hierarchy, [5, 2, 0]), BY[:2], count_col="records")
    want = cumulative_curve(points, [*BY[:2], "match_type"], count_col="records")
    order = ["method", "match_type", "distance_threshold", "subset_total", "match_count", "codability", "accuracy"]
    assert rows_of(got, order) == rows_of(want, order)


def test_many_equal_ids_cost_no_pairs(spark, hierarchy):
    """Forty thousand different records on one id a side: 1.6 billion pairs, which no join of records got through in a test's time."""
    n = 40000
    distance = (F.col("id") + 1) / n
    code = F.when(F.col("id") % 2 == 0, "86101").otherwise("05100")
    results = spark.range(n).select(F.lit(1).cast("bigint").alias("unique_id"), F.array(F.struct(code.alias("code"), distance.alias("distance"))).alias("semantic_search_results"))
    text = F.concat(F.lit("86101;"), F.col("id").cast("string"))
    clerical = spark.range(n).select(F.lit(1).cast("bigint").alias("unique_id"), text.alias("sic_ind_occ1"), F.lit(None).cast("string").alias("sic_ind_occ2"), F.lit(None).cast("string").alias("sic_ind_occ3"))
    last = nearest_candidate_curves({"s": results}, clerical, hierarchy, [5]).filter("match_type = 'MO'").orderBy(F.desc("distance_threshold")).first()
    assert last.subset_total == n * n and last.match_count >= n * n // 2


def test_plans_do_not_print_the_holders(spark):
    """Lists by code number, of the wide intervals of either table: the driver keeps the plans of all jobs."""
    codes = spark.range(20000).select(F.lit("A").alias("section"), F.lpad((F.col("id") * 5).cast("string"), 5, "0").alias("code"))
    some = [f"{i:02d}xxx" for i in range(100)] + [f"{i}xxxx" for i in range(10)] + ["00005", "99995"]
    clerical = spark.createDataFrame([(i % 7, c, None, None) for i, c in enumerate(some)], "unique_id bigint, sic_ind_occ1 string, sic_ind_occ2 string, sic_ind_occ3 string")
    model = spark.createDataFrame([(i % 7, c) for i, c in enumerate(reversed(some))], "unique_id bigint, initial_code string")
    swept = sweep({"m": model}, clerical, Hierarchy(codes), [5])
    assert len(swept._jdf.queryExecution().toString()) < 300_000
    total = swept.first().initial_accuracy_metrics.total_records
    assert total == sum(len(range(i, len(some), 7)) ** 2 for i in range(7))


def test_combinations_are_not_moved(spark, hierarchy, tables):
    clerical, _, found = tables
    swept = shortlist_sweep({"s": found}, clerical, hierarchy, [5], (2, None))
    dealt_by = re.findall(r"hashpartitioning\(([^)]*)\)", swept._jdf.queryExecution().executedPlan().toString())
    assert any("_first" in by and "_second" in by for by in dealt_by)
    assert not any("_held" in by or "_rest" in by for by in dealt_by)


def test_equal_shortlists_are_one_row(spark):
    rows = spark.createDataFrame([(1, [5], [5], [5]), (2, [5], [5, 6], [5, 6]), (3, [], [], [])], "i int, codes0 array<bigint>, codes1 array<bigint>, codes2 array<bigint>")
    got = sorted((r.i, r.initial_codes, r.shortlist_size) for r in S.rows_per_set(rows, (1, 2, None)).collect())
    assert got == [(1, [5], ["1", "2", "All"]), (2, [5], ["1"]), (2, [5, 6], ["2", "All"]), (3, [], ["1", "2", "All"])]


@pytest.mark.parametrize("share", [1.0, 1 / 20])
def test_counted_pairs_without_or_with_few_hot_codes(spark, hierarchy, tables, monkeypatch, share):
    monkeypatch.setattr(joins, "HOT_PIECE", share)
    test_counted_pairs_equal_formed_pairs(spark, hierarchy, tables, monkeypatch, 8, 2000)
