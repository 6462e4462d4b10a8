"""Sequence packing by sums of squares.

A document becomes its token ids and one closing id; only documents longer than a sequence are cut. Pieces are then
packed by the sum-of-squares rule: with N(g) open sequences of remaining gap g, a piece goes where the sum of all
N(g)^2 becomes smallest, which may be a new sequence (of equally good places, the smallest gap).

The rule looks at one piece after the other, so pieces are dealt by hash into groups of about ``group_size``, each
packed by one task, longest pieces first. Sequences that are nearly full are final; the pieces of all others are dealt
anew among themselves and packed a second time, so that what one group could not fill another does.

Defined cases: a null text counts as empty and becomes the closing id alone. Repeated rows are documents of their own.
Columns other than id and text take no part; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.pretokens import BARE, ByPreToken, PreTokenizer
from codetally.llm.shared import cut, documents, tokenizer_text

CAPACITY = 2048
CLOSING_ID = 0
GROUP_SIZE = 8192
#: A sequence with at most this part of it empty is final after the first packing.
SLACK = 1 / 64
_PIECE = pa.struct([("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class IdWriter:
    """Token ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, content: str):
        self.tokens = PreTokenizer(content, BARE, True)
        self.known = ByPreToken(lambda pre_token: np.array(self.tokens.merge(pre_token), "<u4").tobytes())

    def ids(self, text: str) -> bytes:
        pre_tokens = self.tokens.cut(text)
        if pre_tokens is None:
            return np.array(self.tokens.library_ids(text), "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, pre_tokens))


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the packed ``ids``."""
    given = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        writer = IdWriter(given.value)
        for column in batches:
            rows = []
            for text in column.to_pylist():
                ids = writer.ids(text or "") + closing
                parts = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
                rows.append([{"length": len(p) // 4, "ids_crc32": zlib.crc32(p), "ids": p if keep_ids else None} for p in parts])
            yield pa.array(rows, pa.list_(_PIECE))

    cutting = F.arrow_udf(pieces, "array<struct<length:bigint, ids_crc32:bigint, ids:binary>>").asNondeterministic()
    listed = docs.select(F.col(id_col), cutting(F.col(text_col)).alias("parts"))
    rows = listed.select(id_col, F.posexplode("parts").alias("piece", "part"))
    kept = ["length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return rows.select(id_col, "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), *(F.col(f"part.{c}").alias(c) for c in kept))


def sum_of_squares(lengths: list[int], capacity: int) -> list[int]:
    """The sequence, numbered from 0, of each piece in the order given."""
    gaps = np.zeros(capacity + 1, np.int64)  # open sequences by remaining gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, opened = [], 0
    for length in lengths:
        fits = gaps[length:capacity]  # open sequences have a gap below the capacity
        # What the sum of squares grows by, if the piece goes to gap g: the gap loses one, the gap left gains one.
        grows = 2 * (gaps[: capacity - length] - fits) + 2
        if len(grows):
            grows[0] = 1 - 2 * fits[0]  # filled sequences are not counted
        grows = np.where(fits > 0, grows, np.iinfo(np.int64).max)
        best = int(np.argmin(grows)) if len(grows) else 0
        left = capacity - length
        if len(grows) and fits[best] and grows[best] <= (2 * gaps[left] + 1 if left else 0):
            gap = length + best
            where = open_by_gap[gap].pop()
            gaps[gap] -= 1
            left = best
        else:
            where, opened = opened, opened + 1
        if left:
            gaps[left] += 1
            open_by_gap[left].append(where)
        placed.append(where)
    return placed


def pack_group(table: pa.Table, id_col: str, capacity: int, first_number: int) -> pa.Table:
    """Add the sequence and the place in it to the pieces of one group."""
    ordered = table.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    lengths = ordered["length"].to_numpy()
    sequence = np.array(sum_of_squares(lengths.tolist(), capacity), np.int64)
    order = np.argsort(sequence, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    begins = np.searchsorted(sequence[order], sequence[order], "left")
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - before[begins]
    filled = np.bincount(sequence, lengths).astype(np.int64)[sequence]
    group = table["group"][0].as_py()
    numbers = sequence + (first_number + group * (1 << 32))
    added = ordered.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offset))
    return added.append_column("filled", pa.array(filled))


def pack(
    pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, group_size: int = GROUP_SIZE, slack: float = SLACK
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that are no longer than ``capacity``."""
    columns = pieces.columns
    # Dealt by a number fixed in the checkpoint, so that pieces equal in everything go to several groups.
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))

    def packed(rows: DataFrame, seed: int, first_number: int) -> DataFrame:
        groups = max(1, math.ceil(rows.count() / group_size))
        dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
        schema = dealt.withColumns({c: F.lit(0).cast("bigint") for c in ("sequence_id", "offset", "filled")}).schema
        return dealt.groupBy("group").applyInArrow(lambda table: pack_group(table, id_col, capacity, first_number), schema)

    first = cut(packed(pieces, 1, 0))
    final = F.col("filled") >= capacity * (1 - slack)
    second = packed(first.filter(~final).select(*columns, "row"), 2, 1 << 61)
    return first.filter(final).unionByName(second).select(*columns, "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(token_pieces(documents(spark, sf_dir).select("doc_id", "text")))
