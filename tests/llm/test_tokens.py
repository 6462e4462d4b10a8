import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from codetally.llm import packing, token_counts
from codetally.llm.pretokens import BARE, PreTokenizer
from codetally.llm.shared import tokenizer_text

LIBRARY = {name: Tokenizer.from_str(tokenizer_text(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def library_ids(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


def odd_texts(n):
    rng = random.Random(3)
    mixed = "aAb\u00e9\u00c0 '\n\t  .,12\u00bd\u00b2\u00aa\u00ba\xa0\x85\x1c\u200b\u0301\u3000\u01c5\u65e5!<|s"
    plain = "aAb\u00e9\u00c0 '\n\t  .,12\u00bd\u00b2\u00aa\u00ba\u00d6\u00df%$_\u00bf\u0133!<|sStT"
    for i in range(n):
        text = "".join(rng.choice(mixed if i % 3 else plain) for _ in range(rng.randint(0, 14)))
        yield text + rng.choice(["", "", "", "<|endoftext|>", "<|startoftext|>"]) + text[:3]


def test_counts_equal_the_library_s():
    content = tokenizer_text("byte_bpe_50k.json")
    counter = token_counts.TokenCounter(content, token_counts.whole_tokens(content))
    for text in odd_texts(5000):
        assert counter.count(text) == len(library_ids("byte_bpe_50k.json", text)), repr(text)


def test_ids_equal_the_library_s():
    writer = packing.IdWriter(tokenizer_text("word_bpe_49k.json"))
    for text in odd_texts(5000):
        assert np.frombuffer(writer.ids(text), "<u4").tolist() == library_ids("word_bpe_49k.json", text), repr(text)


def test_every_plain_character_is_cut_like_the_library_does():
    tokens = PreTokenizer(tokenizer_text("word_bpe_49k.json"), BARE, True)
    for c in range(32, 0x250):
        text = f"a{chr(c)}b1{chr(c)}{chr(c)} "
        if tokens.cut(text) is not None:
            assert [i for p in tokens.cut(text) for i in tokens.merge(p)] == library_ids("word_bpe_49k.json", text), hex(c)


def test_whole_tokens_are_one_token_each():
    whole = token_counts.whole_tokens(tokenizer_text("byte_bpe_50k.json"))
    assert len(whole) > 40000
    assert all(len(library_ids("byte_bpe_50k.json", t)) == 1 for t in random.Random(1).sample(sorted(whole), 500))


def test_caches_stay_bounded():
    content = tokenizer_text("byte_bpe_50k.json")
    counter = token_counts.TokenCounter(content, frozenset(["one"]))
    counter.known.most = 5
    for i in range(50):
        text = f"one w{i}x"
        assert counter.count(text) == len(library_ids("byte_bpe_50k.json", text))
        assert len(counter.known) <= 5


def test_token_count_query(tables, documents, awkward):
    from codetally.llm.queries import QUERIES

    rows = QUERIES["op6_token_counts"](documents.sparkSession, tables(documents=documents)).collect()
    assert len(rows) == len(awkward) + 2
    for row in rows:
        if row.doc_id is not None:
            text = awkward[row.doc_id] or ""
            n = len(library_ids("byte_bpe_50k.json", text))
            assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 1024)


def check_packing(rows, texts):
    """Pieces are the documents' ids, whole, and sequences have neither gaps nor overlaps nor too many tokens."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    for doc_id, found in pieces.items():
        ids = np.array([*library_ids("word_bpe_49k.json", texts[doc_id]), 0], "<u4")
        want = [(i, 2048 * i, len(part), zlib.crc32(part.tobytes())) for i, part in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
        copies = len(found) // len(want)
        assert sorted(found) == sorted(want * copies)
    return len(sequences)


def test_packing_query(tables, documents, awkward):
    from codetally.llm.queries import QUERIES

    rows = QUERIES["op9_best_fit_packing"](documents.sparkSession, tables(documents=documents)).collect()
    texts = dict(enumerate(awkward)) | {None: "no id here"}
    n = check_packing(rows, texts)
    assert {r.doc_id for r in rows} == set(texts)
    assert sum(r.doc_id == 6 for r in rows) == 2  # the repeated row
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) + 1


def test_nothing_to_pack(tables, no_documents):
    from codetally.llm.queries import QUERIES

    folder = tables(documents=no_documents)
    assert QUERIES["op9_best_fit_packing"](no_documents.sparkSession, folder).count() == 0
    assert QUERIES["op6_token_counts"](no_documents.sparkSession, folder).count() == 0


def test_each_piece_goes_where_the_sum_of_squares_is_least():
    rng = random.Random(2)
    for capacity in (5, 12):
        lengths = [rng.randint(1, capacity) for _ in range(200)]
        gaps = []
        for length, place in zip(lengths, packing.sum_of_squares(lengths, capacity), strict=True):
            def squares(bins):
                return sum(bins.count(g) ** 2 for g in set(bins) if 0 < g < capacity)

            choices = {i: squares([*gaps[:i], gaps[i] - length, *gaps[i + 1 :]]) for i in range(len(gaps)) if gaps[i] >= length}
            fresh = squares([*gaps, capacity - length])
            if place == len(gaps):
                assert all(fresh < s for s in choices.values())
                gaps.append(capacity - length)
            else:
                assert choices[place] == min([*choices.values(), fresh])
                gaps[place] -= length


@pytest.mark.parametrize("group_size", [50, 10000])
def test_packing_is_nearly_full(spark, group_size):
    rng = random.Random(4)
    lengths = [rng.randint(1, 1200) for _ in range(1500)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, group_size=group_size).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1500))
    assert len({r.sequence_id for r in rows}) <= 1.03 * sum(lengths) / 2048 + 1


def test_equal_rows_go_to_several_groups(spark, monkeypatch):
    """A third of the rows are equal in everything; no group is far beyond its size."""
    rows = [(None, None)] * 3000 + [(i, f"text {i}") for i in range(6000)]
    pieces = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"))
    packed = packing.pack(pieces, group_size=500).collect()
    assert len(packed) == 9000
    groups = {}
    for r in packed:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert max(groups.values()) <= 1000
