import itertools
import math

import numpy as np
import pytest

from codetally.llm import language_id as li
from codetally.llm.queries import QUERIES

SENTENCES = {
    "en": "the weather was fine and we walked through the old town with our friends before the shops were closed",
    "de": "das wetter war schön und wir gingen durch die alte stadt mit unseren freunden bevor die läden schlossen",
    "es": "el tiempo era bueno y caminamos por la ciudad vieja con nuestros amigos antes de que cerraran las tiendas",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for language, sentence in SENTENCES.items():
        words = sentence.split()
        for i in range(60):
            rows.append((len(rows), " ".join(words[(i * 7 + k * 3) % len(words)] for k in range(12)) + ".", language))
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !?", "es"), (903, "something without a language", None), (904, "x" * 5000, "de"), rows[0]]
    return spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")


def segmentations(word, chances):
    """Sum over all ways to cut the word, by trying them all."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        pieces, start = [], 0
        for i, here in enumerate([*cuts, True], 1):
            if here:
                pieces.append(word[start:i])
                start = i
        total += math.prod(chances.get(p, li.OTHER if len(p) == 1 else 0.0) for p in pieces)
    return total


def test_forward_sums_all_segmentations():
    chances = {"▁": 0.2, "a": 0.1, "b": 0.05, "▁a": 0.1, "ab": 0.2, "ba": 0.01, "aba": 0.3}
    pieces = sorted(chances)
    table = np.array([[chances[p], 1 / 7] for p in pieces] + [[li.OTHER, li.OTHER], [0.0, 0.0]])
    lattice = li.Lattice(pieces, table)
    words = ["a", "ab", "abab", "bba", "abz", "z"]
    for word, logs in zip(words, lattice.log_chances(words), strict=True):
        assert math.isclose(math.exp(logs[0]), segmentations("▁" + word, chances), rel_tol=1e-9)
    long = "abz" * 40
    assert np.allclose(lattice._long(long[:20]), lattice.log_chances([long[:20]])[0])
    assert np.isfinite(lattice.log_chances(["abz" * 4000])).all()


def test_expected_uses_are_those_of_all_segmentations():
    chances = {"▁": 0.2, "a": 0.1, "▁a": 0.3, "aa": 0.4}
    pieces = sorted(chances)
    lattice = li.Lattice(pieces, np.array([[chances[p]] for p in pieces] + [[li.OTHER], [0.0]]))
    used = lattice.expected(["aa"], np.array([[2.0]]))
    ways = {("▁", "a", "a"): 0.2 * 0.01, ("▁", "aa"): 0.08, ("▁a", "a"): 0.03}
    for i, piece in enumerate(pieces):
        want = 2 * sum(w * cut.count(piece) for cut, w in ways.items()) / sum(ways.values())
        assert math.isclose(used[i, 0], want, rel_tol=1e-9)


def test_query_and_held_out_accuracy(tables, labelled):
    rows = QUERIES["op8_language_id"](labelled.sparkSession, tables(documents=labelled)).collect()
    given = {r.doc_id: r for r in labelled.collect()}
    assert len(rows) == labelled.count()
    right = [r.lang_pred == given[r.doc_id].lang for r in rows if r.held_out and r.doc_id < 900]
    assert len(right) > 20
    assert sum(right) >= 0.95 * len(right)
    for row in rows:
        assert 0 <= row.score <= 1
        assert (row.lang_pred == "und") == (not li.words_of(given[row.doc_id].text))
        assert row.lang_pred in {*SENTENCES, "und"}


def test_held_out_rows_and_labels_are_never_used(spark, labelled):
    """Wrong labels on held-out rows change nothing."""
    def predictions(docs):
        model = li.fit(docs.filter(~li.held_out()))
        return sorted((r.doc_id, r.language.lang, r.language.score) for r in li.identify(docs, model).collect())

    from pyspark.sql import functions as F

    spoiled = labelled.withColumn("lang", F.when(li.held_out(), "xx").otherwise(F.col("lang")))
    assert predictions(spoiled) == predictions(labelled)


def test_nothing_to_learn_from(spark, documents, no_documents):
    model = li.fit(no_documents)
    assert {r.language.lang for r in li.identify(documents, model).collect()} == {"und"}
    assert li.identify(no_documents, model).count() == 0


def test_the_sample_is_bounded(labelled):
    languages, drawn = li._sampled(labelled.filter("lang is not null"), "lang", "doc_id", "text", 20)
    assert languages == ["de", "en", "es"]
    assert all(r["count"] < 45 for r in drawn.groupBy("lang").count().collect())


def test_number_signs_are_no_letters(spark):
    assert [li.words_of(t) for t in ["½ ² ① Ⅻ ४ 12", "a½b", "日本 éß"]] == [[], ["a", "b"], ["日本", "éß"]]


def test_long_words_are_worked_out_alike():
    chances = {"▁": 0.2, "a": 0.1, "b": 0.05, "▁a": 0.1, "ab": 0.2, "aba": 0.3}
    pieces = sorted(chances)
    lattice = li.Lattice(pieces, np.array([[chances[p], 1 / 9] for p in pieces] + [[li.OTHER, li.OTHER], [0.0, 0.0]]))
    word, counts = "abzab" * 5, np.array([2.0, 3.0])
    used = np.zeros_like(lattice.chances)
    lattice._long_expected(word, counts, used)
    assert np.allclose(used, lattice.expected([word], counts[None, :]))
    whole = lattice.expected(["az" * 300], np.array([[1.0, 1.0]]))
    letters = sum(used * len(p) for p, used in zip([*pieces, "z"], whole[:-1, 0], strict=True))
    assert math.isclose(letters, 601, rel_tol=1e-6)


def test_words_outside_the_vocabulary_break_nothing(spark, labelled):
    """Letters no piece has, 29 to 400 in a row, in the texts learnt from."""
    odd = [(2000 + i, "ሀ" * n, language, "s") for i, (n, language) in enumerate(itertools.product([29, 30, 38, 39, 40, 400], ["en", "de"]))]
    docs = labelled.unionByName(spark.createDataFrame(odd, labelled.schema))
    rows = li.identify(docs, li.fit(docs)).collect()
    assert all(0 <= r.language.score <= 1 for r in rows)
    known = [r for r in rows if r.doc_id < 180]
    assert sum(r.language.lang == r.lang for r in known) >= 0.95 * len(known)
