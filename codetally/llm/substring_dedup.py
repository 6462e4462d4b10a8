"""Removal of repeated passages by seed and extend.

A passage is repeated if its word sequence of ``window`` words starts in more than one place, in any document. Seeds
are runs of ``seed_words`` words; of all seeds in a window, the one with the least hash (the first of equals) is the
window's anchor, so equal windows have equal anchors at equal places and far fewer anchors than words have to be
compared. Documents are joined on anchors that occur more than once. From there matches are extended both ways, as far
as the windows that the anchor stands for reach: occurrences whose whole reach is equal form one class, and only where
an anchor has several classes are these compared window by window, by one member each. Words covered
by a repeated window are removed, which is the union of the maximal repeats of at least ``window`` words.

Occurrences are counted before they are moved and never paired with each other: an anchor that a third of all documents
share is a count. Joins on anchors and windows are left to the planner, which splits skewed keys. Texts are moved
compressed, and a second time only for documents with an anchor that had to be compared window by window.

Defined cases: a null text has no words. Repeated rows repeat each other's windows. A document is known by its row's number in
a table written first, so rows that share an id, a text or a hash are told apart. Columns other than id and text take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.shared import documents, stored, packed, slices, texts, word_spans

WINDOW = 35
SEED_WORDS = 6

_BYTE_BASE, _WORD_BASE, _SEED_BASE = (np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1), modulo 2^64."""
    result = np.full(n, base, np.uint64)
    result[:1] = 1
    return np.cumprod(result, dtype=np.uint64)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of each number over all bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RunHashes:
    """Hashes of runs of a sequence of numbers, by their places only."""

    def __init__(self, numbers: np.ndarray, base: np.uint64):
        n = len(numbers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers * _powers(base, n), dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(_inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


class Words:
    """The words of some texts, one text after the other: ``first[i]`` to ``first[i + 1]`` are those of text ``i``."""

    def __init__(self, column: pa.Array):
        self.raw, offsets = packed(column)
        self.starts, self.ends, self.first = word_spans(~_SPACE[self.raw], offsets)
        by_byte = RunHashes(self.raw.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        self.hashes = by_byte.of(self.starts, self.ends)

    def windows(self, window: int) -> np.ndarray:
        """The first words of all windows."""
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.arange(len(self.hashes))
        return at[at + window <= self.first[1:][text]]


def anchors(words: Words, window: int, seed_words: int) -> dict[str, np.ndarray]:
    """Each anchor's text, place, reach (the windows it stands for: ``place - before`` to ``place - after``) and hashes."""
    at = words.windows(window)
    if not len(at):
        empty = np.empty(0, np.int64)
        return {"text": empty, "place": empty, "before": empty, "after": empty, "seed": empty, "reach": empty}
    last = len(words.hashes) - seed_words + 1
    every = np.arange(last)
    seeds = RunHashes(words.hashes, _SEED_BASE).of(every, every + seed_words)
    least = np.empty(len(at), np.int64)
    choices = np.lib.stride_tricks.sliding_window_view(seeds, window - seed_words + 1)
    for some in range(0, len(at), 100_000):
        least[some : some + 100_000] = choices[at[some : some + 100_000]].argmin(1)
    anchor = at + least
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    ends = np.concatenate([begins[1:], [len(at)]]) - 1
    place, low, high = anchor[begins], at[begins], at[ends]
    reach = RunHashes(words.hashes, _WORD_BASE).of(low, high + window)
    text = np.searchsorted(words.first, place, "right") - 1
    return {
        "text": text, "place": place - words.first[text], "before": place - low, "after": place - high,
        "seed": seeds[place].view(np.int64), "reach": reach.view(np.int64),
    }


def _covered(n_words: int, intervals: list[tuple[int, int]]) -> np.ndarray:
    change = np.zeros(n_words + 1, np.int64)
    for start, end in intervals:
        change[start] += 1
        change[end] -= 1
    return np.cumsum(change[:-1]) > 0


def _reach(at: int, window: int) -> tuple[int, int]:
    """The words that an anchor's windows cover."""
    place, before, after = at // window // window, at // window % window, at % window
    return place - before, place - after + window


def _unpacked(column: pa.Array) -> pa.Array:
    unpress = zstandard.ZstdDecompressor()
    return pa.array([unpress.decompress(b).decode() for b in column.to_pylist()], pa.large_string())


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``number`` (what a document is known by, fixed by writing it), ``id`` and ``text``."""
    return stored(docs.select(F.monotonically_increasing_id().alias("number"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed_words: int = SEED_WORDS
) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_removed`` and ``kept``, the kept words joined by one space.

    Where nothing is removed ``kept`` is null, and ``kept_sha256`` tells the kept words of every row.
    """
    numbered = _numbered(docs, id_col, text_col)
    id_type = numbered.schema["id"].dataType.simpleString()
    by_number = numbered.select("number", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, done = texts(batch["text"]), 0
            for some in slices(column):
                found = anchors(Words(some), window, seed_words)
                rows = pa.array(found["text"] + done)
                done += len(some)
                at = (found["place"] * window + found["before"]) * window + found["after"]
                columns = {"at": at, "seed": found["seed"], "reach": found["reach"]}
                yield pa.RecordBatch.from_pydict({"number": batch["number"].take(rows)} | {k: pa.array(v) for k, v in columns.items()})

    # Place and reach as one number, of which rows are narrower.
    seeds = by_number.mapInArrow(find, "number bigint not null, at bigint not null, seed bigint not null, reach bigint not null")

    shared = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("of_seed")).filter("of_seed > 1")
    repeated = seeds.join(shared, "seed").withColumn("sides", F.pmod("at", F.lit(window * window)))
    alike = ["seed", "sides", "reach"]
    # The member with the least number stands for its class; a second one of that number would do no harm.
    member = F.xxhash64("number", "at")
    classes = repeated.groupBy(alike).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("example"))
    known = repeated.join(classes, alike)
    # A class that holds all of its anchor's occurrences needs no closer look.
    look = (F.col("n") < F.col("of_seed")) & (F.col("example") == member)
    entry = F.struct("at", F.when(look, F.col("seed")).alias("seed"), "n", look.alias("look"))
    by_document = known.groupBy("number").agg(F.collect_set(entry).alias("anchors"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            small = [press.compress((t or "").encode()) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"number": batch["number"], "packed": pa.array(small, pa.binary())})

    compressed = by_number.mapInArrow(compress, "number bigint, packed binary")
    found = stored(compressed.join(by_document, "number"))

    def enumerate_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, listed, done = texts(_unpacked(batch["packed"])), batch["anchors"], 0
            for some in slices(column):
                words = Words(some)
                mine = listed.slice(done, len(some))
                flat = mine.flatten()
                row = np.repeat(np.arange(len(some)), np.diff(mine.offsets.to_numpy()))
                field = {name: flat.field(name).fill_null(0).to_numpy(zero_copy_only=False) for name in ("at", "seed", "n")}
                place, before, after = field["at"] // window // window, field["at"] // window % window, field["at"] % window
                pick = np.flatnonzero(flat.field("look").to_numpy(zero_copy_only=False))
                count = (before - after + 1)[pick]
                each = np.repeat(pick, count)
                step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                start = place[each] - before[each] + step
                global_start = start + words.first[row[each]]
                hashes = RunHashes(words.hashes, _WORD_BASE).of(global_start, global_start + window)
                rows = pa.array(row[each] + done)
                done += len(some)
                yield pa.RecordBatch.from_pydict({
                    "number": batch["number"].take(rows), "start": pa.array(start.astype(np.int32)),
                    # With the whole window's hash beside it, half of the anchor's is enough.
                    "seed": pa.array(field["seed"][each].astype(np.int32)), "offset": pa.array((place[each] - start).astype(np.int32)),
                    "reach": pa.array(hashes.view(np.int64)), "n": pa.array(field["n"][each]),
                })

    windows = found.mapInArrow(enumerate_windows, "number bigint, start int, seed int, offset int, reach bigint, n bigint")
    same = ["seed", "offset", "reach"]
    twice = windows.groupBy(same).agg(F.sum("n").alias("total")).filter("total > 1").select(same)
    extended = windows.filter("n = 1").join(twice, same).groupBy("number").agg(F.collect_set("start").alias("starts"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_texts, counts, digests = [], [], []
            texts_here = _unpacked(batch["packed"]).to_pylist()
            for text, listed, starts in zip(texts_here, batch["anchors"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                words = text.encode().split()
                spans = [_reach(a["at"], window) for a in listed if a["n"] > 1]
                spans += [(start, start + window) for start in starts or ()]
                gone = _covered(len(words), spans)
                kept = b" ".join([w for w, out in zip(words, gone.tolist(), strict=True) if not out])
                kept_texts.append(kept.decode())
                counts.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict({"number": batch["number"], "n_removed": pa.array(counts, pa.int64()), "kept": pa.array(kept_texts, pa.string()), "removed_sha256": pa.array(digests, pa.string())})

    compared = F.exists("anchors", lambda a: a["n"] == 1)
    plain = found.filter(~compared).withColumn("starts", F.lit(None).cast("array<int>"))
    ready = found.filter(compared).join(extended, "number", "left").unionByName(plain)
    changed = ready.mapInArrow(removed, "number bigint, n_removed bigint, kept string, removed_sha256 string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch["text"].to_pylist()]
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_pydict({"number": batch["number"], "id": batch["id"], "n_words": pa.array([len(w) for w in words], pa.int64()), "whole_sha256": pa.array(digests, pa.string())})

    every = numbered.mapInArrow(whole, f"number bigint, id {id_type}, n_words bigint, whole_sha256 string")
    return every.join(changed, "number", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("removed_sha256", "whole_sha256").alias("kept_sha256"), "kept",
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeated passages are removed."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY gram) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, w FROM (SELECT r, unnest(range(i, i + 35)) AS w FROM repeated)
), words AS (
  SELECT r, w, ws[w] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS w FROM docs)
), kept AS (
  SELECT words.r, count(*) AS n, string_agg(word, ' ' ORDER BY words.w) AS text
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.w = gone.w WHERE gone.r IS NULL GROUP BY words.r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.r = kept.r
"""
