import itertools

import pytest
from pyspark.sql import functions as F

from codetally import ColumnConfig, ConfusionConfig, LabelAlignment
from codetally.operators.alignment import exclude_patterns, spread_matrix

# Runs of (human code, model code, records); scores go 0.9, 0.8 ... 0.1 and start over.
RUNS = [
    ("10001", "10000", 7), ("10000", "10000", 2), ("10000", "20000", 3), ("10000", "30000", 1), ("20000", "10000", 2),
    ("20000", "20000", 8), ("20000", "30000", 5), ("30000", "20000", 4), ("30000", "30000", 7),
]
CONFIG = ColumnConfig(["SA_1", "SA_2"], ["SA_score_1", "SA_score_2"], ["CC_1", "CC_2"], "unique_id")


@pytest.fixture(scope="module")
def golden(spark):
    scores = itertools.cycle(["0.9", "0.8", "0.7", "0.6", "0.5", "0.4", "0.3", "0.2", "0.1"])
    pairs = [(human, model) for human, model, n in RUNS for _ in range(n)]
    rows = [(f"t{i}", h, "nan", m, "nan", next(scores), "0") for i, (h, m) in enumerate(pairs)]
    df = spark.createDataFrame(rows, ["unique_id", "CC_1", "CC_2", "SA_1", "SA_2", "SA_score_1", "SA_score_2"])
    aligned = LabelAlignment(df, CONFIG)
    aligned.df.cache()
    return aligned


def test_golden_accuracy(golden):
    full = golden.accuracy(extended=True).first()
    assert (full.accuracy_percent, full.matches, full.non_matches, full.total_considered) == (43.6, 17, 22, 39)
    assert golden.accuracy(match_type="2-digit", extended=True).first().matches == 24
    assert golden.jaccard_similarity().first()[0] == pytest.approx(0.4358974358974359)
    with pytest.raises(ValueError):
        golden.accuracy(match_type="other")


def test_golden_summary_and_thresholds(golden):
    s = golden.summary_stats().first()
    assert s.total_samples == 39 and s.overall_accuracy == pytest.approx(43.5897, abs=1e-4)
    assert [round(s[f"accuracy_above_{t}"], 4) for t in ("0.50", "0.60", "0.70", "0.80")] == [34.7826, 36.8421, 40.0, 40.0]
    assert [round(s[f"coverage_above_{t}"], 4) for t in ("0.50", "0.60", "0.70", "0.80")] == [58.9744, 48.7179, 38.4615, 25.641]
    points = {r.threshold: r for r in golden.threshold_stats([0.9, 0.5, 0.5, 2.0, 0.0]).collect()}
    assert golden.threshold_stats([0.9, 0.5, 0.5]).count() == 3
    assert points[0.9].accuracy == 40.0 and points[0.9].coverage == pytest.approx(12.8205, abs=1e-4)
    assert (points[2.0].accuracy, points[2.0].coverage) == (0.0, 0.0)
    assert points[0.0].coverage == 100.0
    grid = {round(r.threshold, 2): r for r in golden.threshold_stats().collect()}
    assert len(grid) == 21 and grid[0.6].coverage < s["coverage_above_0.60"]


def test_golden_confusion(golden):
    matrix = golden.confusion_matrix(ConfusionConfig("CC_1", "SA_1"))
    wide = {r.CC_1: (r["10000"], r["20000"], r["30000"]) for r in spread_matrix(matrix, "CC_1", "SA_1", ["10000", "20000", "30000"]).collect()}
    assert wide == {"10000": (2, 3, 1), "10001": (7, 0, 0), "20000": (2, 8, 5), "30000": (0, 4, 7)}
    # Without human codes starting with 2, the top human code is 30000 and the top model code 10000.
    for n, want in ((1, []), (2, [("10001", "10000", 7), ("30000", "30000", 7)])):
        only = golden.confusion_matrix(ConfusionConfig("CC_1", "SA_1", top_n=n, exclude_patterns=["^2"]))
        assert sorted(tuple(r) for r in only.collect()) == want


def test_candidate_contribution(golden):
    first = golden.candidate_contribution("SA_1").first()
    assert (first.total_predictions_made, first.primary_match_percent, first.primary_match_count) == (39, 43.59, 17)
    none = golden.candidate_contribution("SA_2").first()
    assert none.total_predictions_made == 0 and none.primary_match_percent is None
    with pytest.raises(ValueError):
        golden.candidate_contribution("nope")


def test_one_good_record_makes_its_id_correct(spark):
    rows = [
        ("a", "1", None, "2", None, "0.5", None), ("a", None, "3", "1", None, "x", "nan"),
        (None, "7", None, "8", None, "1", None), (None, "9", None, "7", None, "1", None),
        ("b", "12345", None, "12999", None, "0.1", "0.4"), ("c", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "unique_id string, CC_1 string, CC_2 string, SA_1 string, SA_2 string, SA_score_1 string, SA_score_2 string")
    want = [
        ("a", True, True, 0.5), ("a", True, True, None), (None, True, True, 1.0), (None, True, True, 1.0),
        ("b", False, True, 0.4), ("c", False, False, None),
    ]
    for shaped in (df, df.repartition(4)):
        flagged = LabelAlignment(shaped, CONFIG).df.select("unique_id", "is_correct", "is_correct_2_digit", "max_score")
        assert sorted(map(tuple, flagged.collect()), key=str) == sorted(want, key=str)
    every_prediction_right = LabelAlignment(df, CONFIG)
    every_prediction_right.df = every_prediction_right.df.withColumn("SA_1", F.col("CC_1"))
    found = every_prediction_right.candidate_contribution("SA_1").first()
    assert (found.total_predictions_made, found.any_clerical_match_count) == (4, 3)


def test_row_local_flags_agree_when_ids_are_unique(golden):
    by_row = LabelAlignment(golden.df.select("unique_id", *CONFIG.label_cols, *CONFIG.model_score_cols), CONFIG, unique_ids=True).df
    columns = ["unique_id", "is_correct", "is_correct_2_digit", "max_score"]
    assert by_row.select(columns).exceptAll(golden.df.select(columns)).count() == 0


def test_empty_table(spark, golden):
    empty = LabelAlignment(golden.df.select("unique_id", *CONFIG.label_cols, *CONFIG.model_score_cols).limit(0), CONFIG)
    points = empty.threshold_stats([0.5]).first()
    assert points.accuracy == 0.0 and points.coverage is None
    assert empty.accuracy().first()[0] == 0.0 and empty.coverage().first()[0] is None


def test_patterns_keep_nulls(spark):
    df = spark.createDataFrame([("12x",), ("-9",), (None,), ("123",)], "c string")
    assert {r.c for r in exclude_patterns(df, "c", ["x", "-9"]).collect()} == {None, "123"}
