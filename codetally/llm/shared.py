"""What several corpus operators need: cut lineage, packed text buffers, words of a buffer, vocabulary files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.lineage import scratch, shared_folder

#: Text handled at once inside a task, in bytes. Bounds the arrays built beside the text.
SLICE_BYTES = 4_000_000

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
LOWER_ASCII = bytes.maketrans(UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table does not have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def as_row(df: DataFrame) -> Column:
    """A caller's row as one struct, so that its column names meet no others."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a compressed table in the shared folder, smaller there than a checkpoint."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> pa.Array:
    """The column as texts, null as the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive rows of at most ``most`` bytes together; a longer text comes alone, whole."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield column.slice(start, end - start)
        start = end


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after the other, and where each row starts (one more entry than rows)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of ``inside`` bytes, never across rows, and each row's first word.

    The last result has one more entry than rows: row ``i`` has the words ``first[i]`` to ``first[i + 1]``.
    """
    before = np.empty(len(inside) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offsets] = False
    after = np.empty(len(inside) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    starts = np.flatnonzero(after[:-1] & ~before[:-1])
    following = after
    following[offsets] = False
    ends = np.flatnonzero(inside & ~following[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def code_point_offsets(raw: bytes) -> np.ndarray:
    """For each byte offset of a UTF-8 text, the number of code points before it."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])


def tokenizer_text(name: str) -> str:
    """The content of a public tokenizer file for the tokenizers library. Bounded by its vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


class BoundedCache(dict):
    """Results by key; emptied once it holds ``most`` keys, so that a task's memory does not follow its input."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room_for(self, more: int) -> None:
        if len(self) + more > self.most:
            self.clear()


_COMPLEMENT = bytes(range(255, -1, -1))
_LONG = 1 << 63


def whole_numbers(vector: np.ndarray, scale: int) -> list[int]:
    """``floor(scale * x)`` of finite components, exact at any size."""
    # Beyond 2^53 a double is a whole number, and so is its multiple, which a double may not hold.
    return [math.floor(x * scale) if abs(x) < 1 << 53 else int(x) * scale for x in vector.tolist()]


def descending(number: int) -> bytes:
    """Bytes that sort from the highest whole number to the lowest, of any size: a length, then the number."""
    size = (number.bit_length() + 7) // 8
    body = abs(number).to_bytes(size, "big")
    ascending = (0x8000 + size).to_bytes(2, "big") + body if number >= 0 else (0x8000 - size).to_bytes(2, "big") + body.translate(_COMPLEMENT)
    return ascending.translate(_COMPLEMENT)


def from_descending(key: bytes) -> int:
    """The number at the start of such bytes."""
    ascending = key.translate(_COMPLEMENT)
    size = int.from_bytes(ascending[:2], "big") - 0x8000
    body = ascending[2 : 2 + abs(size)]
    return int.from_bytes(body, "big") if size >= 0 else -int.from_bytes(body.translate(_COMPLEMENT), "big")


def nearest_long(number: int) -> int:
    return max(-_LONG, min(_LONG - 1, number))
