"""Token counts by the whole-token shortcut.

``prove_whole_tokens`` encodes every vocabulary string once, offline, and keeps
those that come out as one token.  Counting a text then means cutting it into
pre-tokens, as the tokenizer file says, and looking each up: a proven one counts
1, and only the others are merged by the library (and remembered, up to
``remember`` strings per worker).

Null or empty text: 0 tokens.  Texts of any length are whole; one map pass, no
shuffle.  Strings of the file's special tokens inside a text count one token
each, the library's default.  Rows that repeat have one count each.  An empty
table gives no rows.  Other columns, of whatever name, pass through; a column of
the name ``out`` is replaced.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import quoted, with_output

#: A word end of this vocabulary.
WORD_END = "</w>"


@functools.cache
def _load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.cache
def _rules(path: str):
    """(special tokens, pattern of pre-tokens), after checking that the file has the known kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    cut, to_bytes = spec["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or cut["type"] != "Split" or not cut["invert"] or to_bytes["type"] != "ByteLevel" or to_bytes["use_regex"]:
        raise ValueError(f"{path}: not a lower-casing word BPE")
    special = [x["content"] for x in spec["added_tokens"]]
    return special, cut["pattern"]["Regex"]


def normalised(text: str) -> str:
    """NFC and lower case of each character by itself."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (without word end) that are one pre-token and encode alone as one token."""
    tokenizer, (special, pattern) = _load(path), _rules(path)
    found = regex.compile(pattern)
    strings = {x.removesuffix(WORD_END) for x in tokenizer.get_vocab() if x.endswith(WORD_END)}
    strings = sorted(x for x in strings - set(special) if x.isascii() and found.fullmatch(x) and normalised(x) == x)
    coded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(x for x, e in zip(strings, coded, strict=True) if len(e.ids) == 1)


class _Counts(dict):
    """Tokens by pre-token; an unknown one is merged by the library's model."""

    def __init__(self, proven, tokenizer: Tokenizer, remember: int):
        super().__init__(dict.fromkeys(proven, 1))
        self.merge, self.room = tokenizer.model.tokenize, remember
        self.to_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, piece: str) -> int:
        plain = piece.isascii() and piece.isprintable()  # such characters stand for their own bytes
        n = len(self.merge(piece if plain else self.to_bytes(piece)[0][0]))
        if self.room > 0:
            self.room -= 1
            self[piece] = n
        return n


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens", remember: int = 500_000) -> DataFrame:
    """``docs`` plus ``out``, the number of tokens of each whole text."""
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    @F.pandas_udf("long")
    def count(parts: pd.Series) -> pd.Series:
        special, pattern = _rules(path)
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        pieces = regex.compile(pattern).findall
        counts = _counts(path, proven, remember)

        def one(text):
            if not text:
                return 0
            if cut is not None and cut.search(text):
                parts = cut.split(text)
                return len(parts) - 1 + sum(sum(map(counts.__getitem__, pieces(normalised(p)))) for p in parts)
            return sum(map(counts.__getitem__, pieces(normalised(text))))

        return parts.map(one, na_action=None)

    return docs.select(*with_output(docs, {out: count(F.coalesce(F.col(*quoted(text_col)).cast("string"), F.lit("")))}))


_HELD: dict[str, _Counts] = {}


def _counts(path: str, proven, remember: int) -> _Counts:
    if path not in _HELD:
        _HELD[path] = _Counts(proven.value, _load(path), remember)
    return _HELD[path]
