import hashlib
import random
import re

import pytest

from codetally.llm import decontaminate as d
from codetally.llm.queries import QUERIES

ITEMS = "item_id long, text string, extra string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(text, items):
    mine, hit, found = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        size = min(10, len(theirs))
        for i in range(len(theirs) - size + 1 if theirs else 0):
            for j in range(len(mine) - size + 1):
                if mine[j : j + size] == theirs[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add("null" if item is None else str(item))
    return len(mine), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    vocabulary = ["a", "B", "c\u00e9", "d1", "\u65e5\u672c"]
    text = lambda n: rng.choice([" ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([10, 12, 25, 3, 9, 11])] + [(9, ""), (10, None), (2, text(10)), (11, "!!"), (None, text(15))]
    docs = [None, "", "!?", *(text(n) for n in (1, 5, 9, 10, 40, 200)), items[2][1].upper(), "x, " + items[1][1] + " y", f"{items[10][1]}\n{items[0][1]}"]
    return docs + [docs[-1]], items


@pytest.mark.parametrize("shard_chars", [400_000, 40])
def test_like_brute_force(spark, case, shard_chars):
    docs, items = case
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item string")
    benchmark = spark.createDataFrame([(*item, "x") for item in items], ITEMS)
    found = d.find_benchmark_text(rows, benchmark, shard_chars=shard_chars).collect()
    assert len(found) == len(docs)
    for row in found:
        n_words, n_hit, n_items, _, _ = brute(docs[row.doc_id], items)
        assert (row.found.n_words, sum(s.last - s.first for s in row.found.spans), len(row.found.items)) == (n_words, n_hit, n_items)
        for span in row.found.spans:
            assert words(docs[row.doc_id][span.start : span.end]) == words(docs[row.doc_id])[span.first : span.last]


def test_query(spark, tables, case):
    docs, items = case
    folder = tables(
        documents=spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
        benchmark=spark.createDataFrame([(*item, "x") for item in items], ITEMS),
    )
    for row in QUERIES["op7_benchmark_decontamination"](spark, folder).collect():
        assert tuple(row)[1:] == brute(docs[row.doc_id], items)


def test_empty_benchmark(spark, documents):
    found = d.find_benchmark_text(documents, spark.createDataFrame([], ITEMS))
    assert found.filter("size(found.spans) > 0").count() == 0
    assert found.count() == documents.count()


def test_repeated_items_come_once(spark):
    text = " ".join(f"word{i}" for i in range(12))
    benchmark = spark.createDataFrame([("a", text)] * 400 + [("b", text + " more")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " + text + " y", "old")], "doc_id long, text string, found string")
    [row] = d.find_benchmark_text(docs, benchmark, shard_chars=100).collect()
    assert row.found["items"] == ["a", "b"] and row.doc_id == 1
