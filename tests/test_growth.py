"""Work that must not be done again per method, list or metric."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from catalogue import views
from codetally import Hierarchy
from codetally.operators.metrics import evaluation_metrics
from codetally.plans.evaluation import accuracy_table, sweep
from codetally.plans.pairing import coded_records
from codetally.plans.search import nearest_candidates

LINES = "l_orderkey bigint, l_partkey bigint, l_extendedprice double, l_quantity double, l_tax double"
CLERICAL = "unique_id int, sic_ind_occ1 string, sic_ind_occ2 string, sic_ind_occ3 string"


def plan_of(df, stage="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


def test_search_lists_deal_lines_out_once(spark, tmp_path, monkeypatch):
    rows = [(1, 1, 300.0, 5.0, 0.0), (1, 1, 100.0, 10.0, 0.0), (1, 2, 200.0, 1.0, 0.5), (1, None, None, 1.0, 0.0), (2, 3, 50.0, 50.0, 0.25)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "written", lambda df: df)
    views.new_query()
    lists = views.search_lists(spark, str(tmp_path))
    views.new_query()
    assert plan_of(lists, "executedPlan").count("Exchange ") == 1
    found = {r.unique_id: ([tuple(c) for c in r.price], [tuple(c) for c in r.quantity]) for r in lists.collect()}
    assert found == {
        1: ([(None, None), (0.001, "00037"), (0.002, "00074")], [(0.02, None), (0.1, "00037"), (0.52, "00074")]),
        2: ([(0.0005, "00111")], [(1.25, "00111")]),
    }
    assert lists.schema["price"].dataType.elementType.fieldNames() == ["distance", "code"]


def test_human_codes_are_read_once_per_record(spark, hierarchy):
    model = spark.createDataFrame([(1, "a", "86101"), (1, "b", "8610x"), (2, "a", None)], "unique_id int, method string, initial_code string")
    clerical = spark.createDataFrame([(1, "86101", "05100", None), (2, "-9", None, None)], CLERICAL)
    earlier = spark.createDataFrame([(1, "0510x", None, None)], CLERICAL)
    records = coded_records(model, clerical, hierarchy, [5, 0], unique_ids=True, by=["method"], first_round=earlier)
    above = plan_of(records).split("Join Inner")[0]
    assert above.count("regexp_extract_all") == 1  # the first choices, and an earlier round's codes as if they were
    sizes = [F.size(c).alias(n) for c, n in (("clerical_codes", "t"), ("initial_codes", "m"))]
    counts = sorted((r.method, r.digits, r.t, r.m) for r in records.select("method", "digits", *sizes).collect())
    each = [("a", 0, 0), ("a", 2, 1), ("b", 2, 1), ("coder_round_1", 2, 1)]
    assert counts == sorted((method, digits, t, m) for method, t, m in each for digits in (0, 5))


def test_nearest_candidate_is_looked_up_as_one_code(spark, hierarchy):
    kind = "unique_id int, semantic_search_results array<struct<code:string,distance:double>>"
    rows = [(1, [("8610x", 0.1)]), (2, [("99999", 0.2)]), (3, []), (4, [("abc", 0.3)]), (5, [("86101", 0.4)])]
    clerical = spark.createDataFrame([(i, "8610x", None, None) for i in range(1, 6)], CLERICAL)
    both = [nearest_candidates({"s": spark.createDataFrame(rows, kind)}, clerical, hierarchy, [5, 2, 0], unique_ids=unique) for unique in (True, False)]
    told = [sorted(tuple(map(str, (r.unique_id, r.digits, r.top_distance, r.top_candidate, r.clerical_codes, r.top_in_truth))) for r in df.collect()) for df in both]
    assert told[0] == told[1] and len(told[0]) == 15
    assert plan_of(both[0]).split("Join Inner")[0].count("aggregate(") == 0


def test_metrics_are_added_up_from_counted_comparisons(spark):
    rows = spark.createDataFrame([(["a"], ["a"]), (["a"], ["a"]), (["a", "b"], ["b"]), ([], ["c"])], "clerical_codes array<string>, initial_codes array<string>")
    metrics = evaluation_metrics(rows)
    assert plan_of(metrics).count("Aggregate ") == 2
    row = metrics.first().initial_accuracy_metrics
    assert (row.total_records, row.matches_oo, row.matches_mo, row.matches_mm, row.unambiguous_records) == (4, 2, 3, 3, 2)
    assert evaluation_metrics(rows.limit(0)).first().initial_accuracy_metrics.total_records == 0


def test_plans_do_not_print_the_codes(spark):
    """The driver keeps the plans of all jobs, and each time a plan changes, that text again."""
    codes = spark.range(20000).select(F.lit("A").alias("section"), F.lpad((F.col("id") * 5).cast("string"), 5, "0").alias("code"))
    model = spark.createDataFrame([(1, "00005"), (2, "0001x"), (3, "3")], "unique_id int, initial_code string")
    clerical = spark.createDataFrame([(1, "00005", None, None), (2, "0xxxx", None, None), (3, "00010", None, None)], CLERICAL)
    table = accuracy_table(sweep({"m": model}, clerical, Hierarchy(codes), [0, 2, 5], unique_ids=True))
    assert len(table._jdf.queryExecution().toString()) < 100_000
    found = {(r.digits, r.metrics): r.value for r in table.collect()}
    assert found["5", "MM Accuracy"] == 2 / 3 and found["2", "OO Accuracy"] == 1.0


def test_long_code_sets_are_not_written_for_every_line(spark, tmp_path):
    """Ten long texts, on a third of the lines, among many shorter ones: too much for the dictionary of a file that has all."""
    spark.range(100_000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    kind = F.col("id") % 3
    line, quantity = F.when(kind == 0, 5).when(kind == 1, 1).otherwise(7), F.when(kind == 2, 6.0).otherwise(20.0)
    lines = spark.range(12_000).select(F.col("id").alias("l_orderkey"), (F.col("id") * 23).alias("l_partkey"), line.alias("l_linenumber"), quantity.alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    queries()["clean_code_sets_five_digits"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/found")
    assert sum(path.stat().st_size for path in (tmp_path / "found").glob("*.parquet")) < 10_000_000
    sizes = spark.read.parquet(f"{tmp_path}/found").filter("l_linenumber != 7").groupBy("l_linenumber", F.length("codes").alias("size")).count().collect()
    assert sorted(map(tuple, sizes)) == [(1, 599, 4000), (5, 59_999, 4000)]
