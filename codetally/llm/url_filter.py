"""URL filter: host and path rules first, then a weighted vocabulary matched by one Aho-Corasick automaton.

A rule (``net/``, ``example.org/en/1``) fits its host and all subdomains if the path starts with the rule's; of the
rules that fit, the longest wins (of two equally long ones, the one with the longer host, then the blocking one).
Without a rule, the vocabulary decides: the lower-cased address is scanned once for all terms, a term counts only
where neither neighbour is an ASCII letter or digit. One strict term blocks, and so do distinct soft terms whose
weights reach ``threshold``.

Rules and vocabulary are parameters that go to every task; both are lists a person maintains, refused beyond
``MOST_ENTRIES``.

Defined cases: a null address, or one without ``://``, has an empty host and path and fits no rule; a null address has
no terms. An empty vocabulary allows everything. Rows are judged one by one and all their columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.shared import LOWER, UPPER

MOST_ENTRIES = 1_000_000
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Terms that block an address on their own.
STRICT = ("porn", "porno", "xxx", "xvideos", "hentai", "milf", "camgirl", "camgirls", "escort-service", "sex-cam", "online-casino")
#: Terms that block only together, with their weights.
SOFT = {
    "adult": 1.0, "sex": 1.5, "sexy": 1.0, "nude": 1.5, "naked": 1.0, "erotic": 1.5, "fetish": 1.5, "dating": 0.5, "hot": 0.5, "girls": 0.5,
    "casino": 1.5, "poker": 1.0, "betting": 1.0, "jackpot": 1.0, "slots": 1.0, "bonus": 0.5, "free": 0.5, "cheap": 0.5, "pills": 1.0,
    "viagra": 1.5, "cialis": 1.5, "torrent": 1.0, "warez": 1.5, "crack": 1.0, "keygen": 1.5, "loan": 0.5, "payday": 1.0,
}
THRESHOLD = 2.0
JUDGED_TYPE = "struct<rule:string, verdict:string, strict:array<string>, soft:array<string>, weight:double>"
_JUDGED = pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("strict", pa.list_(pa.string())), ("soft", pa.list_(pa.string())), ("weight", pa.float64())])
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def vocabulary_automaton(strict: tuple[str, ...], soft: Mapping[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in [*soft.items(), *((term, None) for term in strict)]:
        found.add_word(term.lower(), (term.lower(), weight))
    if len(found):
        found.make_automaton()
    return found


def terms_in(address: str | None, vocabulary: ahocorasick.Automaton) -> tuple[set[str], dict[str, float]]:
    """Distinct strict and soft terms standing free in the address."""
    strict: set[str] = set()
    soft: dict[str, float] = {}
    if not address or not len(vocabulary):
        return strict, soft
    for end, (term, weight) in vocabulary.iter(address):
        start = end - len(term) + 1
        if (start == 0 or address[start - 1] not in _ALNUM) and (end + 1 == len(address) or address[end + 1] not in _ALNUM):
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
    return strict, soft


def rules_by_host(rules: Mapping[str, str]) -> dict[str, list[tuple[str, str, str]]]:
    """Path, rule and verdict of each rule, by host."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules.items():
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append((slash + path, rule, verdict))
    return by_host


def fitting_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits and its verdict."""
    best = None
    labels = host.split(".") if host else []
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        for rule_path, rule, verdict in by_host.get(suffix, ()):
            if path.startswith(rule_path):
                best = max(best or (0, 0, "", ""), (len(rule), len(suffix), verdict, rule))
    return (best[3], best[2]) if best else None


def judge_urls(
    rows: DataFrame,
    url_col: str = "url",
    rules: Mapping[str, str] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: Mapping[str, float] = SOFT,
    threshold: float = THRESHOLD,
    out_col: str = "judged",
) -> DataFrame:
    """Add ``out_col``: host, path, the rule that won, the verdict, the terms found and their weight."""
    if len(rules) + len(strict) + len(soft) > MOST_ENTRIES:
        raise ValueError(f"rules and terms together exceed {MOST_ENTRIES} entries, too many to send to every task")
    given = rows.sparkSession.sparkContext.broadcast((dict(rules), tuple(strict), dict(soft)))

    def judge(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        listed, hard, weighted = given.value
        by_host, vocabulary = rules_by_host(listed), vocabulary_automaton(hard, weighted)
        for batch in batches:
            judged = []
            for address, host, path in zip(*(column.to_pylist() for column in batch), strict=True):
                certain, distinct = terms_in(address, vocabulary)
                weight = sum(distinct[term] for term in sorted(distinct))
                rule = fitting_rule(host, path, by_host)
                verdict = rule[1] if rule else "block" if certain or weight >= threshold and len(distinct) > 1 else "allow"
                judged.append({"rule": rule and rule[0], "verdict": verdict, "strict": sorted(certain), "soft": sorted(distinct), "weight": weight})
            yield pa.array(judged, _JUDGED)

    lowered = F.translate(F.col(url_col), UPPER.decode(), LOWER.decode())
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(lowered, parts, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col(url_col), parts, 2), F.lit(""))
    judging = F.arrow_udf(judge, JUDGED_TYPE).asNondeterministic()
    judged = rows.withColumn(out_col, judging(lowered, host, path))
    return judged.withColumn(out_col, F.struct(host.alias("host"), path.alias("path"), F.col(f"{out_col}.*")))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the address of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", *(F.col(f"judged.{name}").alias(name) for name in ("host", "path", "rule", "verdict")))


def _oracle() -> str:
    lowered = f"translate(url, '{UPPER.decode()}', '{LOWER.decode()}')"
    free = "regexp_matches({u}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = " OR ".join(free.format(u="u", t=t) for t in STRICT)
    weight = " + ".join(f"CASE WHEN {free.format(u='u', t=t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())
    distinct = " + ".join(f"CASE WHEN {free.format(u='u', t=t)} THEN 1 ELSE 0 END" for t in SOFT)
    fits = []
    for rule in sorted(RULES, key=lambda r: (-len(r), r)):
        host, slash, path = rule.partition("/")
        fits.append((rule, f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash + path}')"))
    rule = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in fits) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN '{name}' THEN '{verdict}'" for name, verdict in RULES.items()) + " END"
    return rf"""
WITH split AS (
  SELECT page_id, {lowered} AS u,
         coalesce(regexp_extract({lowered}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, {rule} AS rule FROM split
)
SELECT page_id, host, path, rule,
       coalesce({ruled}, CASE WHEN u IS NULL THEN 'allow'
         WHEN {strict} OR (({weight}) >= {THRESHOLD} AND ({distinct}) > 1) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


ORACLE_SQL = _oracle()
