import pytest

from codetally import accuracy_metrics, ambiguity_metrics, codability_metrics, evaluation_metrics
from codetally.operators.metrics import flatten_metrics, true_codability

SETS = "clerical_codes array<string>, initial_codes array<string>, final_codes array<string>"


def test_ambiguity(spark):
    rows = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False)], "initial_ambiguous boolean, clerical_ambiguous boolean")
    m = ambiguity_metrics(rows).first()
    assert (m.TP, m.FP, m.FN, m.TN) == (1, 1, 1, 1)
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.5, 0.5, 0.5, 0.5)


def test_codability(spark):
    rows = spark.createDataFrame([(True, True), (False, False), (True, False), (False, False)], "initial_ambiguous boolean, final_ambiguous boolean")
    m = codability_metrics(rows).first()
    assert (m.initial_codable_prop, m.final_codable_prop, m.codability_improvement_prop) == (0.5, 0.75, 0.25)
    assert codability_metrics(rows.drop("final_ambiguous")).first().final_codable_count is None


def test_accuracy(spark):
    rows = spark.createDataFrame(
        [(["A"], ["A"]), (["B"], ["B", "C"]), (["C"], ["C"]), (["E"], ["D"])], "clerical_codes array<string>, initial_codes array<string>"
    )
    m = accuracy_metrics(rows).first()
    assert (m.total_records, m.matches_oo, m.matches_mm, m.matches_om, m.matches_mo) == (4, 2, 3, 3, 2)
    assert (m.accuracy_oo_total, m.accuracy_mm_total) == (0.5, 0.75)


def test_evaluation_of_mixed_columns(spark):
    rows = spark.createDataFrame(
        [("A", ["A"], ["A"]), ("B", ["B", "C"], ["B"]), ("-9", None, ["C"]), ("E", ["D"], ["D"])],
        "clerical_codes string, initial_codes array<string>, final_codes array<string>",
    )
    m = evaluation_metrics(rows).first()
    assert m.ambiguity_metrics.f1 == pytest.approx(2 / 3)
    assert m.codability_metrics.codability_improvement_prop == 0.5
    assert m.initial_accuracy_metrics.accuracy_mo_unambiguous == 0.5
    assert m.final_accuracy_metrics.accuracy_om_unambiguous == pytest.approx(2 / 3)


def test_empty_table_gives_one_row_of_zeros(spark):
    empty = spark.createDataFrame([], SETS)
    m = flatten_metrics(evaluation_metrics(empty)).collect()
    assert len(m) == 1 and not any(m[0])
    assert not any(accuracy_metrics(empty).first())


def test_groups_and_missing_columns(spark):
    rows = spark.createDataFrame(
        [(3, "x", ["A"], ["A"], []), (3, "x", [], ["A"], []), (0, "x", ["A"], ["B"], [])], "digits int, method string, " + SETS
    )
    metrics = evaluation_metrics(rows, by=["digits", "method"])
    found = {r.digits: r.codability for r in true_codability(metrics).collect()}
    assert found == {"3": 0.5, "S": 1.0}
    with pytest.raises(ValueError):
        evaluation_metrics(rows.drop("initial_codes"))
    assert evaluation_metrics(rows.drop("final_codes")).first().final_accuracy_metrics is None
