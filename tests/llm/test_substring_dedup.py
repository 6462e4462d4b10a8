import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from codetally.llm import substring_dedup as s
from codetally.llm.queries import QUERIES
from tests.llm.conftest import prose


def brute(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    result = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        result.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return result


def test_query_like_brute_force(tables, documents):
    rows = QUERIES["op3_substring_dedup"](documents.sparkSession, tables(documents=documents)).collect()
    given = documents.collect()
    want = [(r.doc_id, *b) for r, b in zip(given, brute([r.text for r in given]), strict=True)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert sum(r.n_removed for r in rows) > 300


@pytest.mark.parametrize(("window", "seed_words"), [(35, 6), (5, 2), (4, 4)])
def test_shared_passages_in_different_places(spark, window, seed_words):
    passage, other = prose(window + 7, 20), prose(window, 21)
    texts = [prose(30, i) + " " + passage + " " + prose(30, 100 + i) for i in range(8)]
    texts += [passage, passage + " " + other, other + " " + passage, "lead " + other, other, other, "a b " * 30, prose(window - 1, 22), prose(window - 1, 22)]
    texts += [f"{prose(10, 40 + i)} {' '.join(passage.split()[: window - 1])} {prose(10, 60 + i)}" for i in range(3)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hash string").repartition(4)
    rows = {r.doc_id: r for r in s.remove_repeats(docs, window=window, seed_words=seed_words).collect()}
    for i, (n_words, n_removed, digest) in enumerate(brute(texts, window)):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (n_words, n_removed, digest), i
        if rows[i].kept is not None:
            assert hashlib.sha256(rows[i].kept.encode()).hexdigest() == digest


def test_ids_with_two_texts(spark):
    docs = spark.createDataFrame([(1, prose(50, 1)), (1, prose(50, 2)), (2, prose(50, 2))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in s.remove_repeats(docs).collect()) == [(1, 0), (1, 50), (2, 50)]


def test_texts_of_one_id_with_equal_short_hashes(spark):
    """The shorter text shares nothing; both have the same 32-bit hash."""
    texts = [f"{prose(60, 1)} 27854", f"{prose(40, 2)} 38259", prose(60, 1)]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (2, texts[2])], "doc_id long, text string")
    assert docs.filter("doc_id is null").select(F.hash("text")).distinct().count() == 1
    rows = [(r.n_words, r.n_removed, r.kept_sha256) for r in s.remove_repeats(docs).collect()]
    assert sorted(rows) == sorted(brute(texts))


def test_no_documents(no_documents):
    assert s.remove_repeats(no_documents).count() == 0
