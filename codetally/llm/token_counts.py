"""Token counts by the whole-token shortcut.

Which strings of the vocabulary encode, alone, as exactly one token is proved beforehand, once, by encoding each of
them. While counting, a pre-token among them counts one without being merged; only the rest is merged, each different
one once per task as far as a bounded cache reaches.

Defined cases: a null text counts as empty, with no bytes and no tokens. Special strings inside a text are handled as
the library does by default. Texts are never cut short. Rows are judged one by one and all their columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.pretokens import SPACED, ByPreToken, PreTokenizer, byte_symbols
from codetally.llm.shared import documents, tokenizer_text

LIMIT = 1024


def whole_tokens(content: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the library encodes as one token."""
    tokens = PreTokenizer(content, SPACED, False)
    to_byte = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
    whole = set()
    for symbols in tokens.tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(to_byte[s] for s in symbols).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # not a string of its own
        if tokens.cut(text) == [text] and len(tokens.library_ids(text)) == 1:
            whole.add(text)
    return frozenset(whole)


class TokenCounter:
    """Counts tokens of texts; ``whole`` are pre-tokens known to be one token each."""

    def __init__(self, content: str, whole: frozenset[str]):
        self.tokens = PreTokenizer(content, SPACED, False)
        self.known = ByPreToken(lambda pre_token: len(self.tokens.merge(pre_token)))
        self.whole = whole
        self.known.update(dict.fromkeys(whole, 1))

    def count(self, text: str) -> int:
        pre_tokens = self.tokens.cut(text)
        if pre_tokens is None:
            return len(self.tokens.library_ids(text))
        if not self.known:
            self.known.update(dict.fromkeys(self.whole, 1))
        return sum(map(self.known.__getitem__, pre_tokens))


def count_tokens(
    rows: DataFrame, text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", out_col: str = "counted"
) -> DataFrame:
    """Add ``out_col``, a struct of ``n_bytes`` (UTF-8) and ``n_tokens``."""
    content = tokenizer_text(tokenizer)
    given = rows.sparkSession.sparkContext.broadcast((content, whole_tokens(content)))
    kind = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TokenCounter(*given.value)
        for column in batches:
            yield pa.array([{"n_bytes": len((t or "").encode()), "n_tokens": counter.count(t or "")} for t in column.to_pylist()], kind)

    counting = F.arrow_udf(count, "struct<n_bytes:bigint, n_tokens:bigint>").asNondeterministic()
    return rows.withColumn(out_col, counting(F.col(text_col)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select(
        "doc_id",
        F.col("counted.n_bytes").alias("n_bytes"),
        F.col("counted.n_tokens").alias("n_tokens"),
        (F.col("counted.n_tokens") > LIMIT).alias("over_limit"),
    )
