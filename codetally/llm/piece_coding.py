"""SentencePiece encoding and decoding through a table of distinct chunks.

A model escapes every space to a marker. Where no piece has a marker after another character, no merge can cross from a
word into the marker that follows it, so a text is cut there into chunks - a run of markers and the word after it - and
segmented chunk by chunk. ``Chunks`` proves that from the model itself, once. A task then keeps a table of the distinct
chunks it has met: new ones are segmented by the library, each once while the table has room, and the ids of a text are
the table's rows joined by position. A model for which the proof fails has its texts segmented whole.

Ids are exactly the library's, without begin or end ids and without sampling; decoding is the library's ``decode``.

Defined cases: a null text counts as empty and has no ids; null ids decode to the empty text. A marker character that
stands in a text is a space to the model, and is decoded as one. Texts are never cut short, however long. Rows are
coded one by one, so repeated rows and empty tables need no care. A column that already has the name of the result is
replaced, all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from codetally.llm.shared import BoundedCache, documents, slices, texts

MARKER = "▁"
#: Distinct chunks a task remembers, and the longest it remembers: at most some 40 MB.
CACHED = 150_000
LONGEST_CACHED = 64
#: Bytes of text that are cut into chunks at once.
SLICE = 1_000_000
_CHUNK = re.compile(" +[^ ]*")


def model_content(name: str = "piece_bpe_32k.model") -> bytes:
    """The content of a public model file. Bounded by its vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def _fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol buffer message."""
    found, at = {}, 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = message[at], at + 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            found[tag >> 3] = number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        found[tag >> 3] = message[at : at + size]
        at += size
    return found


def chunks_are_independent(content: bytes) -> bool:
    """Whether texts may be segmented chunk by chunk: merges only, none across a marker, texts taken as they are."""
    model = SentencePieceProcessor(model_proto=content)
    fields = _fields(content)
    training, normal = _fields(fields.get(2, b"")), _fields(fields.get(3, b""))
    merges_only = training.get(3, 1) == 2 and not training.get(24)
    as_they_are = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    # Pieces that the model looks for ahead of all merges would be found across chunks.
    fixed = _fields(fields.get(2, b"")).get(31)
    return merges_only and as_they_are and not fixed and MARKER in pieces and not any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces)


class ChunkTable(BoundedCache):
    """The ids of each chunk met, as little-endian 32-bit numbers."""

    def __init__(self, content: bytes, most: int = CACHED):
        super().__init__(most)
        self.model = SentencePieceProcessor(model_proto=content)
        # The library puts a marker before every text but the empty one.
        self.alone = np.array([self.model.piece_to_id(MARKER)], "<i4").tobytes()

    def segment(self, chunks: list[str]) -> list[bytes]:
        listed = self.model.encode([chunk[1:] for chunk in chunks], num_threads=1)
        return [np.array(ids, "<i4").tobytes() if len(chunk) > 1 else self.alone for chunk, ids in zip(chunks, listed, strict=True)]

    def ids(self, listed: list[list[str]]) -> list[bytes]:
        """The ids of each list of chunks, every distinct chunk segmented once."""
        distinct = set().union(*listed)
        table = {chunk: self[chunk] for chunk in distinct if chunk in self}
        new = [chunk for chunk in distinct if chunk not in table]
        table |= zip(new, self.segment(new), strict=True)
        short = [chunk for chunk in new if len(chunk) <= LONGEST_CACHED][: self.most]
        self.room_for(len(short))
        self.update((chunk, table[chunk]) for chunk in short)
        return [b"".join(map(table.__getitem__, chunks)) for chunks in listed]


def chunks_of(text: str) -> list[str]:
    """A text's chunks: runs of spaces with the word after them, the first with the space that the model puts there."""
    return _CHUNK.findall(" " + text.replace(MARKER, " ")) if text else []


def encode(rows: DataFrame, text_col: str = "text", model: str = "piece_bpe_32k.model", out_col: str = "ids") -> DataFrame:
    """Add ``out_col``, the ids of the text."""
    content = model_content(model)
    given = rows.sparkSession.sparkContext.broadcast((content, chunks_are_independent(content)))

    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        content, independent = given.value
        table = ChunkTable(content)
        for column in batches:
            packed = []
            for some in slices(texts(column), SLICE):
                if independent:
                    packed += table.ids([chunks_of(text) for text in some.to_pylist()])
                else:
                    packed += [np.array(ids, "<i4").tobytes() for ids in table.model.encode(some.to_pylist(), num_threads=1)]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    coding = F.arrow_udf(coded, "array<int>").asNondeterministic()
    return rows.withColumn(out_col, coding(F.col(text_col)))


def decode(rows: DataFrame, ids_col: str = "ids", model: str = "piece_bpe_32k.model", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the text the ids stand for."""
    given = rows.sparkSession.sparkContext.broadcast(model_content(model))

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = SentencePieceProcessor(model_proto=given.value)
        for column in batches:
            yield pa.array([library.decode(ids.values.to_pylist()) if ids.is_valid and len(ids) else "" for ids in column], pa.string())

    return rows.withColumn(out_col, F.arrow_udf(decoded, "string").asNondeterministic()(F.col(ids_col)))


def op11_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the text they decode to, as digests."""
    coded = decode(encode(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
