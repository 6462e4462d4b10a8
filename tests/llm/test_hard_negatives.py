import math
import random

import numpy as np
import pytest

from codetally.llm import hard_negatives as h
from codetally.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"
LONG = 1 << 63


def brute(rows):
    """Plain Python over all pairs; labels as given in ``rows``."""
    whole = [(i, label, [math.floor(x * 256) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    result = []
    for anchor, label, vector in {(i, label, tuple(v)) for i, label, v in whole if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, other == label) for i, other, v in whole if i != anchor and len(v) == len(vector))
        for minus, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [(-n, i) for n, i, alike in scored if not alike and 50 * -minus <= 100 * -n <= 95 * -minus][:3]
            clip = lambda s: max(-LONG, min(LONG - 1, s))
            result += [(anchor, positive, rank + 1, i, clip(-minus), clip(s)) for rank, (s, i) in enumerate(fits)]
    return sorted(result)


def relabelled(rows):
    return [(i, v, (label + 1) % 10 if i is not None and label is not None and i % 7 == 0 else label) for i, v, label in rows]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in v], int(i * 7 % 10)) for i, v in enumerate(rng.normal(size=(400, 6)) + 0.4)]
    rows += [(i, rows[50][1], i % 3) for i in range(400, 520)]  # ties
    rows += [(600, None, 1), (650, [None] * 6, 1), (700, [float("nan")] * 6, 1), (750, [float("inf")] * 6, 1), (None, rows[0][1], 1), (800, rows[3][1], None)]
    rows += [(850, [1.0, 2.0], 4), (851, [1.0, 2.5], 4), (852, [1.0, 1.2], 5), (900, [], 1), (901, [], 1), (902, [], 2), (-950, rows[5][1], 0)]
    # Scores of zero: rows of another label before and after the positive.
    rows += [(1000, [0.0, 0.0, 0.0], 8), (1003, [1.0, 0.0, 0.0], 8), (1001, [2.0, 0.0, 0.0], 3), (1004, [0.0, 5.0, 0.0], 3), (999, [0.0, 1.0, 1.0], 3), (1005, [1.0, 1.0, 1.0], 3)]
    rows += [rows[100], rows[120], (150, rows[151][1], 9)]
    return rows


def found(frame, **options):
    return sorted(map(tuple, h.hard_negatives(frame, **options).collect()))


def test_query_like_brute_force(spark, tables, vectors):
    folder = tables(embeddings=spark.createDataFrame(vectors, SCHEMA).repartition(3))
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, folder).collect())) == brute(relabelled(vectors))


def test_many_tiles(spark, vectors):
    frame = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    want = brute(vectors)
    assert len(want) > 40
    assert found(frame, block_rows=40, part_anchors=3) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.random() * 10.0 ** rng.randint(0, 40) for _ in range(3)], i % 2) for i in range(160)]
    rows += [(200, [1e308, -1e308, 3.0], 0), (201, [1e308, 0.1, 2.0], 0), (202, [0.7e308, 5.0, 2.0], 1), (203, [2.0, 5.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    exact = [(i, v, label) for i, v, label in rows]

    def whole(x):
        return math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256

    scale = [(i, [whole(x) for x in v], label) for i, v, label in exact]
    result = []
    for anchor, vector, label in scale:
        if anchor % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, other == label) for i, v, other in scale if i != anchor)
            for minus, positive, _ in [s for s in scored if s[2]][:5]:
                fits = [(-n, i) for n, i, alike in scored if not alike and 50 * -minus <= 100 * -n <= 95 * -minus][:3]
                result += [(anchor, positive, rank + 1, i, h.nearest_long(-minus), h.nearest_long(s)) for rank, (s, i) in enumerate(fits)]
    assert found(frame) == sorted(result)


def test_keys_sort_as_pairs_do():
    rng = random.Random(1)
    scores = [0, 1, -1, 255, 256, -255, -256, -257, 2**63, -(2**63), 2**2000, -(2**2000)] + [rng.randint(-(10**k), 10**k) for k in range(1, 40) for _ in range(5)]
    pairs = [(bytes([rng.randint(0, 3)]) * 16, s, rng.random() < 0.5, rng.randint(-5, 5)) for s in scores for _ in range(3)]
    keys = sorted(h.pair_key(*p) for p in pairs)
    assert [h.unpacked(k) for k in keys] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_window_is_the_condition():
    for positive in range(-60, 200):
        least, most = h.window(positive)
        assert all((50 * positive <= 100 * n <= 95 * positive) == (least <= n <= most) for n in range(-80, 220))


def test_hot_label_and_equal_rows(spark):
    rows = [(i, [1.0, 0.5], 1) for i in range(300)] + [(1, [1.0, 0.5], 1)] * 200 + [(1000 + i, [0.8, 0.1 + i / 1000], 2) for i in range(40)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", key string, row int")
    assert found(frame, block_rows=64) == brute(rows)


def test_no_vectors(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(50, [1.0], 1), (1, None, 2)], SCHEMA)) == []
