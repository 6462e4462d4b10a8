"""Pre-tokens of a text, so that each different one is merged once.

The public byte-pair tokenizers used here cut a text by a fixed pattern before merging, and equal pre-tokens merge
alike. Texts made only of characters on whose class and normal form all engines agree are cut here; any other text,
and one that holds a special token's string, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata

from tokenizers import Tokenizer

from codetally.llm.shared import BoundedCache

CACHED = 1_000_000


# Printable ASCII, common white space and Latin letters; not the capital dotted I, which lower-cases to two characters.
_PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-\u012f\u0131-\u017e]*")


def _patterns(form: str) -> tuple[re.Pattern, re.Pattern]:
    """A vocabulary file's pattern written for ASCII texts and for all plain texts."""

    def members(category: str, end: int) -> str:
        return "".join(chr(c) for c in range(33, end) if unicodedata.category(chr(c))[0] == category)

    plain = form.format(letter=members("L", 0x180), number=members("N", 0x180))
    return re.compile(form.format(letter="A-Za-z", number="0-9")), re.compile(plain)


SPACED = _patterns(r"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+")
BARE = _patterns(r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+")


def byte_symbols() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    symbols = dict(zip(kept, map(chr, kept), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(symbols[b] for b in range(256))


class PreTokenizer:
    """Cuts plain texts and merges single pre-tokens; ``lower`` says whether the tokenizer lower-cases."""

    def __init__(self, content: str, patterns: tuple[re.Pattern, re.Pattern], lower: bool):
        self.tokenizer = Tokenizer.from_str(content)
        self.patterns, self.lower = patterns, lower
        self.special = [token["content"] for token in json.loads(content)["added_tokens"]]
        self.symbols = byte_symbols()

    def cut(self, text: str) -> list[str] | None:
        """The pre-tokens, or None if the text is for the library."""
        if not _PLAIN.fullmatch(text) or "<|" in text and any(token in text for token in self.special):
            return None
        return self.patterns[not text.isascii()].findall(text.lower() if self.lower else text)

    def library_ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def merge(self, pre_token: str) -> list[int]:
        symbols = pre_token.encode().decode("latin-1").translate(self.symbols)
        return [token.id for token in self.tokenizer.model.tokenize(symbols)]


class ByPreToken(BoundedCache):
    """A value for each pre-token, worked out when first asked for and kept while there is room."""

    def __init__(self, work_out, most: int = CACHED):
        super().__init__(most)
        self.work_out = work_out

    def __missing__(self, pre_token: str):
        value = self.work_out(pre_token)
        self.room_for(1)
        self[pre_token] = value
        return value
