import random

import pytest
from pyspark.sql import functions as F

from codetally.operators import pairs as P
from codetally.operators.semantic import cumulative_curve, distance_to_confidence, top_candidate, top_in_truth
from codetally.plans.search import shortlist_codes

RESULTS = "i int, r array<struct<code:string,distance:double>>"


def brute_confidence(results, digits):
    if not results:
        return None
    if len(results) == 1:
        return [(results[0][0], results[0][1], 1.0)]
    width = digits or 2
    nearest = {}
    for code, distance in results:
        nearest[code[:width]] = min(distance, nearest.get(code[:width], distance))
    ranked = sorted((d, c) for c, d in nearest.items())
    two = sum(d for d, _ in ranked[:2]) + 0.00001
    return [(c, d, max(0, 1 - d / two - d * 0.4 - i * 0.1)) for i, (d, c) in enumerate(ranked)]


def test_confidence_matches_brute_force(spark):
    rng = random.Random(3)
    lists = [[], [("86101", 0.4)], [("86101", 0.4), ("86102", 0.3)]]
    lists += [[(f"{rng.randrange(8610, 8640)}{rng.randrange(10)}", rng.randrange(1, 9) / 10) for _ in range(rng.randrange(2, 9))] for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(lists)), RESULTS)
    for digits in (0, 3, 5):
        found = rows.select("i", distance_to_confidence(F.col("r"), F.lit(digits)).alias("c")).orderBy("i").collect()
        for row, results in zip(found, lists):
            want = brute_confidence(results, digits)
            if want is None:
                assert row.c is None
            else:
                assert [(c.code, c.distance) for c in row.c] == [w[:2] for w in want]
                assert [c.likelihood for c in row.c] == pytest.approx([w[2] for w in want])


def test_top_candidate(spark, hierarchy):
    rows = spark.createDataFrame([(0, [("86101", 0.1), ("05100", 0.2)]), (1, []), (2, [("99999", 0.3)]), (3, [("86xxx", 0.4)])], RESULTS)
    found = {r.i: r for r in top_candidate(rows, hierarchy, "r", 5).withColumn("hit", top_in_truth(F.col("top_candidate"), F.array(F.lit("86101"), F.lit("86100")))).collect()}
    assert (found[0].top_distance, found[0].top_candidate, found[0].hit) == (0.1, ["86101"], True)
    assert found[1].top_distance is None and found[1].top_candidate is None and not found[1].hit
    assert found[2].top_candidate == [] and not found[2].hit
    assert found[3].hit


def test_shortlists(spark, hierarchy):
    rows = spark.createDataFrame(
        [("a", "m", [("86101", 0.1), ("05100", 0.2), ("01110", 0.3)]), ("b", "m", [])],
        "unique_id string, method string, semantic_search_results array<struct<code:string,distance:double>>",
    )
    found = {(r.unique_id, r.digits, r.shortlist_size): r.initial_codes for r in shortlist_codes(rows, hierarchy, [5, 0], (1, 2, None)).collect()}
    assert found[("a", 5, "1")] == ["86101"] and found[("a", 5, "2")] == ["05100", "86101"]
    assert found[("a", 0, "All")] == ["A", "B", "Q"] and found[("b", 5, "All")] == []
    assert len(found) == 12


def test_curve_matches_brute_force(spark):
    rng = random.Random(5)
    points = [(s, rng.choice([rng.randrange(5) / 4, rng.random(), 0.5 + rng.random() * 1e-6]), rng.random() < 0.5) for s in "xxy" for _ in range(150)]
    points += [("x", None, True), ("z", 0.25, False)]
    rows = spark.createDataFrame(points, "s string, top_distance double, top_in_truth boolean")
    found = {(r.s, r.distance_threshold): r for r in cumulative_curve(rows, ["s"]).collect()}
    assert set(found) == {(s, d) for s, d, _ in points if d is not None}
    for (s, d), r in found.items():
        upto = [hit for t, x, hit in points if t == s and x is not None and x <= d]
        total = sum(t == s for t, _, _ in points)
        assert (r.subset_total, r.match_count) == (len(upto), sum(upto))
        assert r.codability == len(upto) / total and r.accuracy == sum(upto) / len(upto)


def test_pairs(spark):
    rows = spark.createDataFrame(
        [(1, ["a"], ["a"]), (2, ["a", "b"], ["b"]), (3, [], ["b"]), (4, ["a"], ["b"]), (5, ["c"], ["d"])],
        "i int, clerical_codes array<string>, initial_codes array<string>",
    )
    assert P.explode_both(rows, "few").count() == 3
    counts = {(r.clerical_codes, r.initial_codes): r["count"] for s in ("single", "few") for r in P.pair_counts(rows, s).collect()}
    assert counts == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 1, ("c", "d"): 1}
    pairs = P.pair_counts(rows, "single").unionByName(P.pair_counts(rows, "few")).groupBy("clerical_codes", "initial_codes").agg(F.sum("count").alias("count"))
    frequent = P.frequent_confusions(pairs).collect()
    assert [(r.clerical_codes, r.initial_codes) for r in frequent] == [("a", "b")]
    among = {(r.clerical_codes, r.initial_codes) for r in P.counts_among_confused(pairs).collect()}
    assert among == {("a", "a"), ("a", "b"), ("b", "b")}
    assert P.frequent_confusions(P.pair_counts(rows.filter("i = 1"), "single")).count() == 0
    assert {r.i for r in P.ambiguity_subset(rows, "few").collect()} == {2, 3}
    assert {r.label for r in P.code_labels(rows, "clerical_codes").collect()} == {"a", "b", "c"}
