"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Both sides are lower-cased (A-Z) and reduced to words of ASCII letters, digits and non-ASCII characters. Every run
of ``window`` consecutive words of a benchmark item is a pattern; an item with fewer words, but not none, is one
pattern. Each document is scanned once. A word inside any occurrence of a pattern is hit, and hits are mapped back to
code-point spans of the original text.

The automaton goes to every task, so its size is bounded: items are dealt into shards of about ``shard_chars``
characters, and with more than one shard the documents pass through one bounded automaton after the other, their
lineage cut in between.

Defined cases: a null text has no words and is clean. Items without words, and null item texts, match nothing. Items
with a null id count as one item, listed as ``null``. Repeated items and repeated documents are judged row by row. An
empty benchmark leaves every document clean. All columns of the documents are kept, whatever their names; the result
is one added struct column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.shared import code_point_offsets, cut, documents

WINDOW = 10
SHARD_CHARS = 400_000
FOUND_TYPE = "struct<n_words:bigint, spans:array<struct<first:bigint, last:bigint, start:bigint, end:bigint>>, items:array<string>>"
_SPAN = pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])

# Letters and digits of ASCII, lower-cased, and every byte of a non-ASCII character; all else parts words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def automaton(items: list[tuple[str, str | None]], window: int) -> ahocorasick.Automaton:
    """Patterns of all items; each carries its number of words and the items it comes from."""
    patterns: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normalised_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            pattern = (b" " + b" ".join(words[i : i + size]) + b" ").decode("latin-1")
            patterns.setdefault(pattern, (size, set()))[1].add(item)
    found = ahocorasick.Automaton()
    for pattern, (size, names) in patterns.items():
        found.add_word(pattern, (size, tuple(names)))
    if patterns:
        found.make_automaton()
    return found


def scan(text: str | None, patterns: ahocorasick.Automaton) -> dict:
    """Words, merged hit spans and items of one text."""
    raw = (text or "").encode()
    normal = raw.translate(_NORMAL)
    words = normal.split()
    result: dict = {"n_words": len(words), "spans": [], "items": []}
    if not words or not len(patterns):
        return result
    padded = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(patterns.iter(padded))
    if not hits:
        return result
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    # In the padded text, the space after word i is at closing[i].
    closing = np.cumsum(lengths)
    last = np.searchsorted(closing, np.fromiter((end for end, _ in hits), np.int64, len(hits))) + 1
    first = last - np.fromiter((size for _, (size, _) in hits), np.int64, len(hits))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    covered = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    starts = np.flatnonzero(covered[1:] & ~covered[:-1])
    ends = np.flatnonzero(~covered[1:] & covered[:-1])
    where = [m.span() for m in _WORD.finditer(normal)]
    points = code_point_offsets(raw)
    result["spans"] = [
        {"first": int(a), "last": int(b), "start": int(points[where[a][0]]), "end": int(points[where[b - 1][1]])}
        for a, b in zip(starts, ends, strict=True)
    ]
    result["items"] = sorted({item for _, (_, names) in hits for item in names})
    return result


def merged(found: dict, earlier: dict | None) -> dict:
    """Both findings about one text as one."""
    if not earlier:
        return found
    spans: list[dict] = []
    for span in sorted([*found["spans"], *earlier["spans"]], key=lambda s: (s["first"], -s["last"])):
        if spans and span["first"] <= spans[-1]["last"]:
            if span["last"] > spans[-1]["last"]:
                spans[-1] = spans[-1] | {"last": span["last"], "end": span["end"]}
        else:
            spans.append(span)
    return found | {"spans": spans, "items": sorted({*found["items"], *earlier["items"]})}


def _judge(listed: Broadcast, window: int) -> Callable:
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        patterns = automaton(listed.value, window)
        for column, before in batches:
            known = before.to_pylist() if before.null_count < len(before) else [None] * len(column)
            yield pa.array([merged(scan(t, patterns), b) for t, b in zip(column.to_pylist(), known, strict=True)], _FOUND)

    return judge


def find_benchmark_text(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    out_col: str = "found",
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """Add ``out_col``: number of words, hit spans (in words and in code points) and the items found.

    Repeated items count once. A column that already has the name of the result is replaced, all others are kept.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("body")).distinct()
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_chars))
    result = docs
    for shard in range(shards):
        mine = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(shards)) == shard)
        # A shard holds about shard_chars characters, whatever the size of the benchmark.
        listed = spark.sparkContext.broadcast([(row.item, row.body) for row in mine.collect()])
        earlier = F.lit(None).cast(FOUND_TYPE) if shard == 0 else F.col(out_col)

        # Nondeterministic only in name: it keeps the planner from running the scan twice under a filter.
        judging = F.arrow_udf(_judge(listed, window), FOUND_TYPE).asNondeterministic()
        result = result.withColumn(out_col, judging(F.col(text_col), earlier))
        if shard + 1 < shards:
            result = cut(result)
    return result


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda total, s: total + s["last"] - s["first"])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every whole document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_benchmark_text(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.concat_ws(",", F.array_sort("found.items"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit(F.col("found")).alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), starts AS (
  SELECT item, ws, least(len(ws), 10) AS size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0
), patterns AS (
  SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS gram FROM starts
), sizes AS (
  SELECT DISTINCT size FROM patterns
), grams AS (
  SELECT r, size, i, array_to_string(ws[i : i + size - 1], ' ') AS gram
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, sizes WHERE len(ws) >= size)
), hits AS (
  SELECT g.r, g.i, g.size, p.item FROM grams g JOIN patterns p ON g.size = p.size AND g.gram = p.gram
), words AS (
  SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(i, i + size)) AS w FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.listed, '')) AS items_sha256, w.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN words w ON d.r = w.r LEFT JOIN named m ON d.r = m.r
"""
