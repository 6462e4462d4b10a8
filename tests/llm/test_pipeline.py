import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codetally.llm.queries import ORACLES, QUERIES
from tests.llm import test_decontaminate, test_pii, test_simhash
from tests.llm.conftest import DOCS, prose
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def case(spark, awkward):
    item = prose(14, 77)
    texts = [*awkward, f"{prose(60, 31)} {item} {prose(40, 32)}", f"{prose(200, 33)} write to joe@example.org or 4111 1111 1111 1111 {prose(20, 34)}"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    benchmark = spark.createDataFrame([(1, item, "x"), (2, None, "x")], "item_id long, text string, lang string")
    return spark.createDataFrame([*rows, rows[6]], DOCS), benchmark


def test_stages_like_plain_python(spark, tables, case):
    docs, benchmark = case
    folder = tables(documents=docs, benchmark=benchmark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        kept[name] = docs.collect()
    given = [(r.doc_id, r.text) for r in case[0].collect()]

    from codetally.llm.language_id import words_of

    rows = [(i, t) for i, t in given if words_of(t)]
    assert sorted(r.doc_id for r in kept["language_id"]) == sorted(i for i, _ in rows)
    chosen = {c for _, _, c in test_simhash.brute_components(rows)}
    assert sorted(r.doc_id for r in kept["simhash_near_dedup"]) == sorted(chosen)
    items = [(r.item_id, r.text) for r in case[1].collect()]
    texts = dict(rows)
    clean = {i for i in chosen if not test_decontaminate.brute(texts[i], items)[4]}
    assert clean != chosen
    assert {r.doc_id for r in kept["benchmark_decontamination"]} == clean
    terms = test_pii.brute_terms([texts[i] for i in sorted(clean)])
    assert not terms
    for row in kept["pii"]:
        want = texts[row.doc_id]
        for start, _, kind, end in reversed(test_pii.brute_base(want)):
            want = f"{want[:start]}[{kind.upper()}]{want[end:]}"
        assert row.text == want
        assert row.n_chars == len(want)
    assert any("[EMAIL]" in r.text for r in kept["pii"])
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert [f.name for f in spark.read.parquet(f"{folder}/after-{name}").schema] == [f.name for f in case[0].schema]
    check_packing(kept["best_fit_packing"], {r.doc_id: r.text for r in kept["pii"]})


def test_run(spark, tables, case):
    folder = tables(documents=case[0], benchmark=case[1])
    rows = QUERIES["pipeline"](spark, folder)
    assert rows.count() == len(rows.select("doc_id", "piece").distinct().collect()) > 5


def test_run_on_nothing(spark, tables, no_documents):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, tables(documents=no_documents, benchmark=benchmark)).count() == 0


def test_columns_keep_their_kinds_and_clashing_names(spark, tables, case):
    docs = case[0].withColumns({c: F.lit("x") for c in ("fp", "spans", "base", "found", "hash", "root", "score", "lang_pred", "id", "_id", "_hash", "_copy", "_kept_id", "_found", "_language", "_spans", "_clean", "found_", "row")})
    folder = tables(documents=docs, benchmark=case[1])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.dtypes == docs.dtypes
        assert {r.spans for r in found.collect()} == {"x"}


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(ORACLES) <= set(QUERIES)
