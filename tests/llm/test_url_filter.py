import pytest

from codetally.llm import url_filter as u
from codetally.llm.queries import ORACLES  # noqa: F401  the queries import


@pytest.fixture(scope="module")
def judged(spark):
    def run(urls, **options):
        rows = spark.createDataFrame([(i, url, "kept") for i, url in enumerate(urls)], "page_id long, url string, rule string")
        return [r.asDict(True) for r in u.judge_urls(rows, **options).orderBy("page_id").collect()]

    return run


def test_hosts_and_paths(judged):
    found = judged(["HTTP://A.Org/Path?q#f", "x://h#frag/a", "x://h?a://b/c", "no scheme", None, "", "a://", "http://www.Example.ORG/en/1x"])
    assert [(r["judged"]["host"], r["judged"]["path"]) for r in found] == [
        ("a.org", "/Path"), ("h", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("www.example.org", "/en/1x"),
    ]
    assert [r["rule"] for r in found] == ["kept"] * 8


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://a.org/x", "org/", "allow"), ("http://example.org/es/1", "example.org/es/", "block"), ("http://m.example.org/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "org/", "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://x.com/fr/porn", "com/fr/", "allow"),
        ("http://x.com/de/", "com/de/", "block"), ("http://x.com/de", None, "allow"), ("http://a.org", None, "allow"), ("http://xcom/fr/", None, "allow"),
        ("http://x.net/porn", None, "block"), ("http://x.net/popcorn-pornography", None, "allow"), ("http://x.net/sex-poker", None, "block"),
        ("http://x.net/sex/sex/sex", None, "allow"), ("http://x.net/XXX", None, "block"),
    ],
)
def test_verdicts(judged, url, rule, verdict):
    [row] = judged([url])
    assert (row["judged"]["rule"], row["judged"]["verdict"]) == (rule, verdict)


def test_no_vocabulary_and_no_rules(judged, spark):
    [row] = judged(["http://a.org/porn"], rules={}, strict=(), soft={})
    assert (row["judged"]["verdict"], row["judged"]["strict"]) == ("allow", [])
    assert u.judge_urls(spark.createDataFrame([], "url string")).count() == 0


def test_too_many_entries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(u, "MOST_ENTRIES", 3)
    with pytest.raises(ValueError, match="too many"):
        u.judge_urls(spark.createDataFrame([], "url string"))
