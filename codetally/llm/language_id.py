"""Language identification by unigram pieces, with the segmentation marginalised.

Each language has a probability for every piece of a fixed public vocabulary. A text's probability is the sum over all
ways to cut its words into pieces, which a forward pass over each word gives; a word's pieces never reach into the next
word, so equal words share their result. The probabilities are fitted by expectation maximisation over word counts.

The fit reads about ``sample`` texts of each language at most, drawn by hash; predictions read whole texts. Words are
runs of letters of the lower-cased text.

Words are short enough to multiply probabilities, or worked out with rescaling; words of any length teach.

Defined cases: a letter is what Unicode calls one, so number signs are none. A text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing
to learn from. Texts whose language is null teach nothing. Of equally likely languages the first by name wins. Rows are
judged one by one; a column that already has the name of the result is replaced, all others are kept.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.shared import cut, documents

SAMPLE = 600
ROUNDS = 3
MOST_LANGUAGES = 200
UNDETERMINED = "und"
LONGEST_PIECE = 16
#: Words this long are worked out on their own, with rescaling, and not kept: the chance of a shorter one, be all its
#: letters outside the vocabulary, is a number that a double holds.
LONGEST_KEPT = 30
KEPT_WORDS = 500_000
#: Probability, in any language, of a letter that is no piece of the vocabulary.
OTHER = 1e-8
#: Weight of the average over all languages in each language's probabilities.
SHARED = 1e-3
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def public_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """The vocabulary's pieces that can occur in a lower-cased word, which begins with the mark of a space."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if len(p) <= LONGEST_PIECE and p == p.lower() and _WORD.fullmatch(p.removeprefix("▁") or "a")})


class Lattice:
    """Forward and backward passes over words. ``chances`` has a row per piece, one for other letters, one of zeros."""

    def __init__(self, pieces: list[str], chances: np.ndarray):
        self.index = {piece: i for i, piece in enumerate(pieces)}
        self.chances = chances
        self.other, self.none = len(pieces), len(pieces) + 1
        self._logs: np.ndarray | None = None

    def ids(self, words: list[str], start: int, end: int) -> np.ndarray:
        missing = self.other if end - start == 1 else self.none
        get = self.index.get
        return np.array([get(w[start:end], missing) for w in words])

    def log_chances(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability, a column per language."""
        result = np.empty((len(words), self.chances.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, rows in by_length.items():
            if length >= LONGEST_KEPT:
                for i in rows:
                    result[i] = self._long(words[i])
            else:
                marked = ["▁" + words[i] for i in rows]
                result[rows] = np.log(self._forward(marked)[0][-1])
        return result

    def _forward(self, marked: list[str]) -> tuple[list[np.ndarray], dict]:
        n = len(marked[0])
        ids: dict[tuple[int, int], np.ndarray] = {}
        forward = [np.ones((len(marked), self.chances.shape[1]))]
        for end in range(1, n + 1):
            total = np.zeros_like(forward[0])
            for start in range(max(0, end - LONGEST_PIECE), end):
                at = self.ids(marked, start, end)
                if end - start == 1 or (at != self.none).any():
                    ids[start, end] = at
                    total += forward[start] * self.chances[at]
            forward.append(total)
        return forward, ids

    def _long(self, word: str) -> np.ndarray:
        marked = "▁" + word
        recent = [np.ones(self.chances.shape[1])]  # the forward values of the last positions, rescaled together
        scale = np.zeros(self.chances.shape[1])
        for end in range(1, len(marked) + 1):
            total = np.zeros_like(recent[0])
            for back in range(1, min(len(recent), LONGEST_PIECE) + 1):
                piece = marked[end - back : end]
                total += recent[-back] * self.chances[self.index.get(piece, self.other if back == 1 else self.none)]
            recent = [*recent[-LONGEST_PIECE + 1 :], total]
            recent = [value / total for value in recent]
            scale += np.log(total)
        return scale

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, in expectation, given how often each word stands in each language."""
        used = np.zeros_like(self.chances)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) < LONGEST_KEPT:
                by_length.setdefault(len(word), []).append(i)
            else:
                self._long_expected(word, counts[i], used)
        for rows in by_length.values():
            marked = ["▁" + words[i] for i in rows]
            forward, ids = self._forward(marked)
            n = len(marked[0])
            weight = counts[rows] / forward[-1]
            backward = [np.zeros_like(forward[0]) for _ in range(n)] + [np.ones_like(forward[0])]
            for (start, end), at in sorted(ids.items(), key=lambda item: -item[0][0]):
                through = self.chances[at] * backward[end]
                backward[start] += through
                np.add.at(used, at, forward[start] * through * weight)
        return used

    def logs(self) -> np.ndarray:
        if self._logs is None:
            with np.errstate(divide="ignore"):
                self._logs = np.log(self.chances)
        return self._logs

    def _long_expected(self, word: str, counts: np.ndarray, used: np.ndarray) -> None:
        """Add the expected uses in one word of any length, worked out in logarithms."""
        marked = "▁" + word
        n = len(marked)
        known: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by start: end and row of each piece
        for start in range(n):
            for end in range(start + 1, min(n, start + LONGEST_PIECE) + 1):
                at = self.index.get(marked[start:end], self.other if end == start + 1 else self.none)
                if at != self.none:
                    known[start].append((end, at))
        ahead = np.full((n + 1, len(counts)), -np.inf)
        ahead[0] = 0.0
        behind = np.full((n + 1, len(counts)), -np.inf)
        behind[n] = 0.0
        logs = self.logs()
        for start in range(n):
            for end, at in known[start]:
                ahead[end] = np.logaddexp(ahead[end], ahead[start] + logs[at])
        for start in reversed(range(n)):
            for end, at in known[start]:
                behind[start] = np.logaddexp(behind[start], behind[end] + logs[at])
        for start in range(n):
            for end, at in known[start]:
                used[at] += counts * np.exp(ahead[start] + logs[at] + behind[end] - ahead[n])


def _normalised(used: np.ndarray, n_pieces: int) -> np.ndarray:
    """Probabilities from expected uses, each language mixed with a little of the average."""
    own = used[:n_pieces] + 1e-12
    own = own / own.sum(0)
    average = (own.mean(1, keepdims=True) + 1 / n_pieces) / 2
    chances = np.zeros((n_pieces + 2, used.shape[1]))
    chances[:n_pieces] = (1 - SHARED) * own + SHARED * average
    chances[n_pieces] = OTHER
    return chances


def _sampled(labelled: DataFrame, lang_col: str, id_col: str, text_col: str, sample: int) -> tuple[list[str], DataFrame]:
    """The languages, and about ``sample`` rows of each at most."""
    sizes = labelled.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in column {lang_col}: too many for one model")
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col(lang_col) == row[0], F.lit(min(1.0, sample / row[1]))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 20)) < share * (1 << 20)
    return sorted(row[0] for row in sizes), labelled.filter(drawn)


def fit(
    labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, rounds: int = ROUNDS,
    vocabulary: str = "piece_bpe_32k.model",
) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and probabilities, from the rows with a language. Size: pieces times languages."""
    languages, drawn = _sampled(labelled.filter(F.col(lang_col).isNotNull()), lang_col, id_col, text_col, sample)
    pieces = public_pieces(vocabulary)
    n = len(languages)
    if not languages:
        return languages, pieces, np.zeros((len(pieces) + 2, 0))
    chances = _normalised(np.ones((len(pieces) + 2, n)), len(pieces))
    spark = labelled.sparkSession
    place = {language: i for i, language in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for language, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                at = place[language]
                found.update((at, word) for word in words_of(text))
            yield pa.RecordBatch.from_pydict({"language": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())})

    counted = drawn.select(lang_col, text_col).mapInArrow(count, "language bigint, word string, n bigint")
    words = cut(counted.groupBy("word", "language").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(chances)

        def expect(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(pieces, given.value)
            used = np.zeros_like(given.value)
            for batch in batches:
                counts = np.zeros((batch.num_rows, n))
                counts[np.arange(batch.num_rows), batch[1].to_numpy()] = batch[2].to_numpy()
                used += lattice.expected(batch[0].to_pylist(), counts)
            at, language = np.nonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(language), pa.array(used[at, language])], ["piece", "language", "used"])

        used = np.zeros_like(chances)
        summed = words.select("word", "language", "n").mapInArrow(expect, "piece bigint, language bigint, used double")
        # At most pieces times languages rows, whatever the input.
        for row in summed.groupBy("piece", "language").agg(F.sum("used").alias("used")).collect():
            used[row.piece, row.language] = row.used
        chances = _normalised(used, len(pieces))
    return languages, pieces, chances


class Identifier:
    """Predicts languages; log probabilities of words are kept while there is room."""

    def __init__(self, languages: list[str], pieces: list[str], chances: np.ndarray):
        self.languages = languages
        self.lattice = Lattice(pieces, chances)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.empty((1024, len(self.languages)))

    def _learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.place]
        if not fresh:
            return
        first = len(self.place)
        while first + len(fresh) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
        self.logs[first : first + len(fresh)] = self.lattice.log_chances(fresh)
        self.place.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for some in itertools.batched(texts, 200):
            listed = [words_of(t) for t in some]
            if len(self.place) > KEPT_WORDS:
                self._forget()
            self._learn(set().union(*listed))
            for words in listed:
                if not words or not self.languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                total = self.logs[at].sum(0)
                best = int(np.argmax(total))
                names.append(self.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def identify(
    rows: DataFrame, model: tuple[list[str], list[str], np.ndarray], text_col: str = "text", out_col: str = "language"
) -> DataFrame:
    """Add ``out_col``, a struct of the predicted ``lang`` and its ``score``, the posterior under equal priors."""
    given = rows.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        identifier = Identifier(*given.value)
        for column in batches:
            names, scores = identifier.predict(column.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return rows.withColumn(out_col, F.arrow_udf(predict, "struct<lang:string, score:double>").asNondeterministic()(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept out of the fit: the checksum of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    model = fit(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
