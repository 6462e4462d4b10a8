import numpy as np
import pytest

from codetally.llm import topk_search as t
from codetally.llm.queries import QUERIES


def brute(rows, k=10):
    whole = [(i, [t.math.floor(x * 1024) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    result = []
    for q, a in {(i, tuple(v)): (i, v) for i, v in whole if i % 100 == 0}.values():
        dot = lambda b: sum(x * y for x, y in zip(a, b))
        scored = sorted(((-dot(b), i) for i, b in whole if i != q and len(a) == len(b)))[:k]
        result += [(q, rank + 1, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(scored)]
    return sorted(result)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(700, 12)))]
    rows += [(i, rows[100][1]) for i in range(700, 760)]  # ties
    rows += [(1000, None), (1100, [None] * 12), (1200, [float("nan")] * 12), (1300, [float("inf")] * 12), (None, rows[0][1]), (1400, [1.0, 2.0]), (1401, [0.5, -3.0])]
    rows += [(1500, []), (1501, []), rows[200], (-100, rows[5][1]), (1600, [0.0] * 12)]
    return rows


def test_query_like_brute_force(spark, tables, vectors):
    folder = tables(embeddings=spark.createDataFrame([(*r, 1) for r in vectors], "vec_id long, embedding array<float>, label int").repartition(3))
    assert sorted(map(tuple, QUERIES["op5_topk_search"](spark, folder).collect())) == brute(vectors)


def test_several_blocks(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, t.top_k(frame, block_rows=50).collect())) == brute(vectors)


def test_index_alone():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, dims, most = int(rng.integers(1, 80)), int(rng.integers(1, 6)), int(rng.choice([0, 1, 3, 100, 2**20]))
        values, ids, query = rng.integers(-most, most + 1, (n, dims)), rng.integers(0, 60, n), rng.integers(-most, most + 1, dims)
        found, scores = t.BitSlicedIndex(ids, values).best(7, query, 5)
        keep = ids != 7
        want = values[keep] @ query
        order = np.lexsort((ids[keep], -want))[:5]
        assert found.tolist() == ids[keep][order].tolist()
        assert scores.tolist() == want[order].tolist()


def test_no_vectors(spark):
    assert t.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_components_take_part(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 12)).tolist()) for i in range(250)]
    rows += [(500, [1.0, 70000.0, 0.0]), (300, [1e300, -1e300, 2.0]), (301, [1e300, 0.1, 2.0]), (302, [0.5e300, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, t.top_k(frame, block_rows=60).collect())) == brute(rows)


def test_a_hot_id_is_dealt_apart(spark):
    rows = [(100, [float(i), 1.0]) for i in range(400)] + [(i, [float(i % 7), 2.0]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = t.top_k(frame, block_rows=100).collect()
    of_hot = [r for r in got if r.query_id == 100]
    assert len(of_hot) == 10 and all(r.vec_id != 100 for r in of_hot)


def test_tiles_of_several_blocks_and_parts_of_queries(spark, vectors, monkeypatch):
    monkeypatch.setattr(t, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(t, "LEAST_TILES", 4)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, t.top_k(frame, block_rows=20).collect())) == brute(vectors)


def test_queries_are_not_broadcast(spark, vectors):
    """However few they are: once for each block they are many, and the driver would hold them."""
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    plan = t.top_k(frame, block_rows=2)._jdf.queryExecution()
    plan.toRdd().count()
    assert "Broadcast" not in plan.executedPlan().toString()
