import random

import pytest
from pyspark.sql import functions as F

from codetally import ColumnConfig, clean_wide_table, evaluation_metrics, prepare_clerical_codes, prepare_model_codes
from codetally.operators.joins import attach_final_codes, join_on_id, join_salted
from codetally.operators.prepare import keep_unambiguous, stack_methods
from codetally.plans.evaluation import evaluate, joined_codes, sweep
from codetally.plans.search import shortlist_sweep
from tests.conftest import PAIRS

CLERICAL = "unique_id string, sic_ind_occ1 string, sic_ind_occ2 string, sic_ind_occ3 string"
MODEL = "unique_id string, initial_code string, alt_sic_candidates array<struct<code:string,likelihood:double>>"


@pytest.fixture(scope="module")
def clerical(spark):
    return spark.createDataFrame(
        [("A1", "86101", "1420", "86210"), ("A2", "86210", "663xx", None), ("A3", "-9", "nan", "NAN"), ("A4", "4+", None, None)], CLERICAL
    )


def sets(df, col):
    return sorted((r["unique_id"] or "", r[col]) for r in df.collect())


def test_clerical_codes(spark, hierarchy, clerical):
    want = [("A1", ["01420", "86101", "86210"]), ("A2", ["66300", "86210"]), ("A3", []), ("A4", [])]
    assert sets(prepare_clerical_codes(clerical, hierarchy), "clerical_codes") == want
    assert sets(prepare_clerical_codes(clerical.repartition(3), hierarchy, unique_ids=True), "clerical_codes") == want


def test_clerical_codes_with_side_table(spark, hierarchy, clerical):
    side = spark.createDataFrame([("A4", "66210;66220;66290;663xx"), ("B9", "86xxx"), ("A1", None), ("B8", None)], "unique_id string, sic_ind_occ string")
    found = dict(sets(prepare_clerical_codes(clerical, hierarchy, side, digits=3), "clerical_codes"))
    assert found == {"A1": ["014", "861", "862"], "A2": ["662", "663", "862"][1:], "A3": [], "A4": ["662", "663"], "B9": ["861", "862", "869"], "B8": []}


def test_side_table_matches_null_and_repeated_ids(spark, hierarchy):
    main = spark.createDataFrame([(None, "86101", None, None), ("A", "86101", None, None), ("A", "86101", None, None)], CLERICAL)
    side = spark.createDataFrame([(None, "66210"), ("A", "85100"), ("A", "05100")], "unique_id string, sic_ind_occ string")
    found = sets(prepare_clerical_codes(main, hierarchy, side), "clerical_codes")
    assert found == [("", ["66210"]), ("A", ["05100"]), ("A", ["05100"]), ("A", ["85100"]), ("A", ["85100"])]


def test_empty_tables(spark, hierarchy):
    assert prepare_clerical_codes(spark.createDataFrame([], CLERICAL), hierarchy).count() == 0
    assert prepare_model_codes(spark.createDataFrame([], MODEL), hierarchy).count() == 0


def test_pruning_needs_exactly_one_confident_code(spark, hierarchy):
    rows = [
        ("one", "", [("86101", 0.8), ("86210", 0.5), ("01420", 0.4)]),
        ("two", "-9", [("86101", 0.8), ("86210", 0.7), ("01420", 0.4)]),
        ("wide", None, [("86xxx", 0.9), ("01420", 0.1)]),
        ("best", None, [("86101", 0.1), ("86101", 0.9), ("01420", 0.2)]),
        ("nan", None, [("86101", float("nan")), ("01420", 0.9)]),
        ("null", None, [("86101", None), (None, 0.9), ("01420", 0.1)]),
        ("none", None, None),
        ("first", "05100", [("86101", 0.9)]),
    ]
    found = dict(sets(prepare_model_codes(spark.createDataFrame(rows, MODEL), hierarchy, threshold=0.7), "model_codes"))
    health = ["86100", "86101", "86102", "86210", "86220", "86230", "86900"]
    assert found == {
        "one": ["86101"], "two": ["01420", "86101", "86210"], "wide": ["01420", *health], "best": ["86101"], "nan": ["01420"],
        "null": ["01420", "86101"], "none": [], "first": ["05100"],
    }


def test_negative_scores_follow_the_threshold_rule(spark, hierarchy):
    rows = spark.createDataFrame([("a", None, [("86101", -0.5), ("86210", 0.2)])], MODEL)
    assert sets(prepare_model_codes(rows, hierarchy, threshold=0.0), "model_codes") == [("a", ["86210"])]


def test_missing_columns(spark, hierarchy):
    with pytest.raises(ValueError):
        prepare_model_codes(spark.createDataFrame([("12345",)], "initial_code string"), hierarchy)
    with pytest.raises(ValueError):
        prepare_model_codes(spark.createDataFrame([("A1",)], "unique_id string"), hierarchy)
    only_first = spark.createDataFrame([("A1", "86101;2xxxx")], "unique_id string, initial_code string")
    assert sets(prepare_model_codes(only_first, hierarchy, digits=2), "model_codes")[0][1] == [f"{d}" for d in range(20, 30)] + ["86"]


def test_repeated_model_rows_are_kept(spark, hierarchy):
    rows = spark.createDataFrame([("A", "86101", None)] * 4 + [("A", "05100", None), (None, "86101", None), (None, "86101", None)], MODEL)
    found = sets(prepare_model_codes(rows.repartition(3), hierarchy), "model_codes")
    assert found == [("", ["86101"])] * 2 + [("A", ["05100"])] + [("A", ["86101"])] * 4


def test_joins_match_nulls_and_multiply_repeats(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "unique_id string, x int")
    right = spark.createDataFrame([(None, ["p"]), ("a", ["q"]), ("a", ["r"])], "unique_id string, final_codes array<string>")
    assert join_on_id(left, right).count() == 5
    attached = attach_final_codes(left, right, "final_codes").filter("unique_id = 'b'").first()
    assert attached.final_codes == []


def test_evaluation_with_and_without_unique_ids(spark, hierarchy, clerical):
    model = spark.createDataFrame(
        [("A1", "86101", None, "66210"), ("A2", None, [("86210", 0.4)], "x"), ("A4", "-9", [], "66xxx"), ("Z", "86101", None, None)],
        MODEL + ", final_sic string",
    )
    side = spark.createDataFrame([("A4", "66210;66220")], "unique_id string, sic_ind_occ string")
    both = [evaluate(model, clerical, hierarchy, four_plus=side, digits=3, unique_ids=u).first() for u in (True, False)]
    assert both[0] == both[1]
    joined = joined_codes(model, clerical, hierarchy, side, digits=3)
    assert {r.unique_id: (r.initial_codes, r.final_codes) for r in joined.collect()} == {
        "A1": (["861"], ["861"]), "A2": (["862"], []), "A4": ([], ["662", "663"]),
    }
    without = evaluate(model.drop("final_sic"), clerical, hierarchy, digits=3).first()
    assert without.final_accuracy_metrics is None and without.initial_accuracy_metrics.total_records == 3


def test_a_third_of_the_records_sharing_one_id(spark, hierarchy):
    """Many copies of one record, a null id held by many records, and ordinary records."""
    rng = random.Random(11)
    codes = ["86101", "86210", "8610x", "05100", "2xxxx", "99999", "-9", ""]
    human = [("hot", "86101;86210")] * 60 + [(None, rng.choice(codes)) for _ in range(12)] + [(f"r{i}", rng.choice(codes)) for i in range(50)]
    model = [("hot", "86101")] * 3 + [(None, rng.choice(codes)) for _ in range(9)] + [(f"r{i}", rng.choice(codes)) for i in range(50)]
    clerical = spark.createDataFrame([(i, c, None, None) for i, c in human], CLERICAL).repartition(6)
    output = spark.createDataFrame(model, "unique_id string, initial_code string").repartition(4)

    def valid(text):
        found = set()
        for part in filter(None, text.replace("-9", "").split(";")):
            stem = part.rstrip("x")
            found |= {c[:3] for _, c in PAIRS if c.startswith(stem[:3])}
        return found

    pairs = [(valid(t), valid(m)) for i, t in human for j, m in model if i == j]
    got = evaluate(output, clerical, hierarchy, digits=3).first().initial_accuracy_metrics
    assert got.total_records == len(pairs) == 60 * 3 + 12 * 9 + 50
    assert got.matches_mm == sum(bool(t & m) for t, m in pairs)
    assert got.matches_om == sum(len(t) == 1 and bool(t & m) for t, m in pairs)
    assert got.matches_mo == sum(len(m) == 1 and bool(t & m) for t, m in pairs)
    assert got.matches_oo == sum(len(m) == 1 and len(t) == 1 and t == m for t, m in pairs)


def test_counted_sweeps_equal_row_by_row_sweeps(spark, hierarchy):
    clerical = spark.createDataFrame([("a", "86101", None, None)] * 3 + [("b", "2xxxx", None, None), (None, "-9", None, None)], CLERICAL)
    rows = [("a", "86101", None)] * 4 + [("a", None, [("86210", 0.9), ("05100", 0.2)]), ("b", "20100", None), (None, "86101", None)]
    models = {"m": spark.createDataFrame(rows, MODEL), "n": spark.createDataFrame(rows[3:], MODEL)}
    levels, by = [5, 0], ["digits", "method"]
    counted = sweep(models, clerical, hierarchy, levels, first_round=clerical)
    plain = []
    for digits in levels:
        truth = prepare_clerical_codes(clerical, hierarchy, digits=digits)
        rounds = {name: joined_codes(model, clerical, hierarchy, digits=digits, threshold=0.7) for name, model in models.items()}
        rounds["coder_round_1"] = join_on_id(truth.withColumnRenamed("clerical_codes", "initial_codes"), truth)
        plain += [tuple(evaluation_metrics(r.withColumns({"digits": F.lit(digits), "method": F.lit(n)}), by=by).first()) for n, r in rounds.items()]
    assert sorted(map(tuple, counted.collect())) == sorted(plain)
    found = spark.createDataFrame(
        [("a", [("86101", 0.1), ("05100", 0.2)])] * 3 + [("b", [("20100", 0.3)])],
        "unique_id string, semantic_search_results array<struct<code:string,distance:double>>",
    )
    swept = shortlist_sweep({"s": found}, clerical, hierarchy, [5], (1, None))
    assert {(r.shortlist_size, r.initial_accuracy_metrics.total_records, r.initial_accuracy_metrics.matches_mm) for r in swept.collect()} == {
        ("1", 10, 10), ("All", 10, 10),
    }


def test_a_broken_promise_of_unique_ids_fails(spark, hierarchy):
    once = spark.createDataFrame([("a", "86101", None, None), ("b", "86210", None, None)], CLERICAL)
    model = spark.createDataFrame([("a", "86101"), ("b", "86210")], "unique_id string, initial_code string")
    assert evaluate(model, once, hierarchy, unique_ids=True).first().initial_accuracy_metrics.matches_oo == 2
    for broken in (once.union(once), once.union(spark.createDataFrame([(None, "1", None, None)], CLERICAL))):
        with pytest.raises(Exception, match="promised to be unique"):
            evaluate(model, broken, hierarchy, unique_ids=True).collect()
        with pytest.raises(Exception, match="promised to be unique"):
            prepare_clerical_codes(broken, hierarchy, unique_ids=True).collect()
    with pytest.raises(ValueError, match="promised to be unique"):
        evaluate(model.union(model), once, hierarchy, unique_ids=True)
    side = spark.createDataFrame([("a", "86220"), ("a", "86230")], "unique_id string, sic_ind_occ string")
    with pytest.raises(Exception, match="promised to be unique"):
        evaluate(model, once, hierarchy, four_plus=side, unique_ids=True).collect()


WIDE = ColumnConfig(["model_label_1", "model_label_2"], ["model_score_1", "model_score_2"], ["clerical_label_1", "clerical_label_2"], "unique_id")


def test_clean_wide_table(spark):
    rows = [
        ("A", "12345", "23456", "12345", "99999", 0.9, 0.1, "TRUE"), ("B", "1234", None, "01234", "12300", 0.8, 0.7, "true"),
        ("C", "-9", "4+", "99999", "54322", 0.99, 0.98, "FALSE"), ("D", "nan", "", "54321", "88888", 0.7, 0.6, None),
        ("E", "5432x", "54321", "54322", "54322", 0.85, 0.8, "maybe"),
    ]
    table = spark.createDataFrame(rows, ["unique_id", *WIDE.clerical_label_cols, *WIDE.model_label_cols, *WIDE.model_score_cols, "Unambiguous"])
    cleaned = {r.unique_id: (r.clerical_label_1, r.clerical_label_2) for r in clean_wide_table(table, WIDE).collect()}
    assert cleaned == {"A": ("12345", "23456"), "B": ("01234", None), "C": ("-9", "4+"), "D": (None, None), "E": ("5432x", "54321")}
    strict = ColumnConfig(**{**WIDE.__dict__, "filter_unambiguous": True})
    assert {r.unique_id for r in clean_wide_table(table.filter("unique_id <> 'E'"), strict).collect()} == {"A", "B"}
    with pytest.raises(Exception, match="neither true nor false: maybe"):
        clean_wide_table(table, strict).collect()
    assert {r.unique_id for r in keep_unambiguous(table, strict=False).collect()} == {"A", "B"}
    assert keep_unambiguous(table.drop("Unambiguous"), required=False).count() == 5
    with pytest.raises(ValueError):
        clean_wide_table(table.drop("Unambiguous"), strict)
    with pytest.raises(ValueError):
        clean_wide_table(table, ColumnConfig(["model_label_1"], [], ["clerical_label_1"], "unique_id"))


def test_stack_methods(spark):
    a, b = spark.range(2), spark.range(3).withColumn("extra", F.lit(1))
    assert stack_methods({"a": a, "b": b}).groupBy("method").count().collect().__len__() == 2


def test_a_hot_id_is_dealt_over_tasks(spark):
    left = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) as unique_id", "id as v")
    right = spark.range(60_000).selectExpr("id as unique_id", "id * 2 as w")
    nulls = spark.createDataFrame([(None, -1), (None, -2)], "unique_id long, v long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("false", "-1", "16")):
            spark.conf.set(key, value)
        joined = join_salted(left.unionByName(nulls), right.unionByName(spark.createDataFrame([(None, 5)], "unique_id long, w long")))
        rows = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(rows) == 60_002
    assert max(rows) <= 3 * sorted(rows)[len(rows) // 2]
    # The same rows as a plain join that matches nulls.
    pairs = joined.select("unique_id", "v", "w")
    plain = join_on_id(left.unionByName(nulls), right.unionByName(spark.createDataFrame([(None, 5)], "unique_id long, w long")), "unique_id")
    assert pairs.exceptAll(plain.select("unique_id", "v", "w")).count() == 0
