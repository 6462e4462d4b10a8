import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from codetally.llm import piece_coding as p
from codetally.llm.queries import QUERIES

CONTENT = p.model_content()
LIBRARY = SentencePieceProcessor(model_proto=CONTENT)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(table, text):
    [packed] = table.ids([p.chunks_of(text)])
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_model_is_proved():
    assert p.chunks_are_independent(CONTENT)
    # Changed settings or pieces that the proof must refuse.
    assert not p.chunks_are_independent(CONTENT.replace(b"identity\x12\x00\x18\x01 \x00", b"identity\x12\x00\x18\x01 \x01"))
    assert not p.chunks_are_independent(CONTENT.replace(b"identity\x12\x00\x18\x01 \x00", b"identity\x12\x00\x18\x00 \x00"))
    piece = "▁District".encode()
    assert not p.chunks_are_independent(CONTENT.replace(piece, "Dist▁rict".encode()))


TABLE = p.ChunkTable(CONTENT, most=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tab.é\xa0　<s>/\x00日\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_the_library_s(text):
    assert coded(TABLE, text) == LIBRARY.encode(text)


def test_every_chunk_is_found_while_the_table_is_emptied():
    rng = random.Random(3)
    table = p.ChunkTable(CONTENT, most=7)
    for _ in range(60):
        listed = [" ".join(rng.choice("abcdefgh") * rng.randint(0, 90) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        packed = table.ids([p.chunks_of(t) for t in listed])
        assert [len(b) // 4 for b in packed] == [len(LIBRARY.encode(t)) for t in listed]
        assert len(table) <= 7


@pytest.mark.parametrize("independent", [True, False])
def test_query_like_the_library(tables, documents, monkeypatch, independent):
    if not independent:
        monkeypatch.setattr(p, "chunks_are_independent", lambda content: False)
    rows = QUERIES["op11_piece_coding"](documents.sparkSession, tables(documents=documents)).collect()
    want = []
    for r in documents.collect():
        ids = LIBRARY.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids) if ids else "")))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_round_trip_with_other_columns(spark, awkward):
    docs = spark.createDataFrame([(i, t, "kept", 7) for i, t in enumerate(awkward)], "id int, text string, decoded_text string, _ids int")
    rows = p.decode(p.encode(docs)).collect()
    assert [(r.decoded_text, r._ids) for r in rows] == [("kept", 7)] * len(awkward)
    assert [r.decoded for r in rows] == [t or "" for t in awkward]


def test_null_ids_and_no_rows(spark, tables, no_documents):
    assert [r.decoded for r in p.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == ["", ""]
    assert QUERIES["op11_piece_coding"](spark, tables(documents=no_documents)).count() == 0
