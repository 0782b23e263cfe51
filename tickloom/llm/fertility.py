"""Operator 4, quality rules by tokeniser fertility.

A public vocabulary with byte fallback encodes every word. Natural text of a language takes about as many
characters a token as other text of it; capitals, symbols between words, a repeated word or scraps of menus do not. For each document the
characters per token, the share of tokens that are single fallback bytes, and the entropy of its tokens are measured, and each has a band
that depends on the language, or, where that is not known, on the script of its letters.
"""

from __future__ import annotations

import math
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose ids a task keeps before it forgets them all; this bounds memory and changes no result.
KEPT_WORDS = 200_000
_SYMBOLS = b"#*$%&|<>"


class Band(NamedTuple):
    """What a document of a language or script may measure."""

    least_chars: float
    most_chars: float
    most_bytes: float
    #: Bits of token entropy for texts of 2^7, 2^8, ... 2^12 tokens, straight lines between, level beyond: longer texts use more of a language.
    least_entropy: tuple[float, ...]


#: Bands by language code, else by script. Natural text of the language lies well inside.
BANDS = {
    "en": Band(2.00, 6.0, 0.20, (5.55, 5.88, 6.15, 6.38, 6.52, 6.60)),
    "fr": Band(1.80, 6.0, 0.20, (5.45, 5.78, 6.08, 6.26, 6.38, 6.46)),
    "de": Band(2.02, 6.0, 0.20, (5.40, 5.78, 6.07, 6.28, 6.40, 6.46)),
    "es": Band(1.78, 6.0, 0.20, (5.40, 5.68, 6.05, 6.26, 6.42, 6.50)),
    "latin": Band(1.30, 7.0, 0.30, (5.00, 5.30, 5.60, 5.80, 5.90, 5.95)),
    "cyrillic": Band(1.40, 5.0, 0.12, (4.80, 5.10, 5.40, 5.60, 5.70, 5.75)),
    # the vocabulary spells these letter by letter
    "greek": Band(0.55, 2.0, 0.15, (3.50, 3.60, 3.70, 3.70, 3.70, 3.70)),
    "arabic": Band(0.55, 2.0, 0.20, (3.50, 3.60, 3.70, 3.70, 3.70, 3.70)),
    "hebrew": Band(0.55, 2.0, 0.20, (3.30, 3.40, 3.50, 3.50, 3.50, 3.50)),
    "armenian": Band(0.45, 2.0, 0.50, (3.40, 3.50, 3.60, 3.60, 3.60, 3.60)),
    "devanagari": Band(0.45, 2.0, 0.40, (3.40, 3.50, 3.60, 3.60, 3.60, 3.60)),
    "thai": Band(0.45, 2.0, 0.40, (3.60, 3.80, 4.00, 4.00, 4.00, 4.00)),
    # many signs, the rarer ones as bytes
    "han": Band(0.40, 2.0, 0.75, (4.60, 4.80, 5.00, 5.10, 5.20, 5.20)),
    "kana": Band(0.40, 2.0, 0.65, (4.50, 4.70, 4.90, 5.00, 5.10, 5.10)),
    "hangul": Band(0.35, 2.0, 0.75, (4.20, 4.40, 4.60, 4.70, 4.70, 4.70)),
    # scripts that the vocabulary hardly has are nearly all bytes: what is bytes alone is no text of any
    "other": Band(0.20, 7.0, 0.97, (3.00, 3.30, 3.60, 3.80, 4.00, 4.00)),
}
# Code points of scripts, from and up to; kana and Han together are Japanese, and go by kana.
SCRIPTS = {
    "latin": ((0x0041, 0x024F), (0x1E00, 0x1EFF)), "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x0400, 0x052F),), "armenian": ((0x0530, 0x058F),), "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)), "devanagari": ((0x0900, 0x097F),), "thai": ((0x0E00, 0x0E7F),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
_KNOTS = (7, 8, 9, 10, 11, 12)


@cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Measured(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_tokens: int
    chars_per_token: float
    byte_share: float
    entropy: float


class Meter:
    """Measures whole texts; keeps what words it has met."""

    def __init__(self, vocabulary: str, kept_words: int = KEPT_WORDS):
        self.processor, self.kept_words = _processor(vocabulary), kept_words
        size = self.processor.get_piece_size()
        self.is_byte = np.array([self.processor.is_byte(i) for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.size, self.chars = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        for word, text, ids in zip(words, texts, self.processor.encode(texts, num_threads=1), strict=True):
            at = len(self.known)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            if at == len(self.start):
                self.start, self.size, self.chars = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.chars))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[at], self.size[at], self.chars[at] = self.used, len(ids), len(text)
            self.used += len(ids)
            self.known[word] = at

    def measure(self, text: str | None) -> Measured:
        data = (text or "").encode("utf-8", "replace")
        words = data.split()
        if not words:
            return Measured(0, 0, _symbols(data), 0, 0, 0, 0.0, 0.0, 0.0)
        if len(self.known) > self.kept_words:
            self._forget()
        if new := set(words).difference(self.known):
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        size = self.size[at]
        ends, chars = np.cumsum(size), int(self.chars[at].sum())
        n = int(ends[-1])
        ids = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(n)]
        ids.sort()
        runs = np.diff(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])))
        share = runs / n
        entropy = float(-(share * np.log2(share)).sum())
        bytes_share = float(self.is_byte[ids].mean())
        return Measured(len(words), chars, _symbols(data), _dup_lines(data), _repeat_words(at), n, chars / n, bytes_share, entropy)


def _symbols(data: bytes) -> int:
    return sum(map(data.count, (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS)))))


def _dup_lines(data: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0
    with_word = [x for x in lines if x.split(None, 1)]
    return len(with_word) - len(set(with_word))


def _repeat_words(at: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(at)
    if n < 4:
        return 0
    _, small = np.unique(at, return_inverse=True)
    small = small.astype(np.int64)
    if int(small.max()) < 1 << 20:
        key = (small[:-2] << 40) | (small[1:-1] << 20) | small[2:]
    else:
        _, pairs = np.unique((small[:-1] << 31) | small[1:], return_inverse=True)
        key = (pairs[:-1].astype(np.int64) << 31) | small[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def script(text: str) -> str:
    """The script with most letters of the whole text; kana, if it has a tenth of the letters; without any letter, other."""
    counts: dict[str, int] = {}
    for char in set(text):
        if char.isalpha():
            point = ord(char)
            name = next((n for n, ranges in SCRIPTS.items() if any(a <= point <= b for a, b in ranges)), "other")
            counts[name] = counts.get(name, 0) + text.count(char)
    if 10 * counts.get("kana", 0) > sum(counts.values()):
        return "kana"
    return max(counts, key=lambda n: (counts[n], n), default="other")


def passes(found: Measured, lang: str | None, text: str | None, bands: dict[str, Band] | None = None) -> bool:
    """Whether a document's fertility lies inside the band of its language or script. No word: no. Of few tokens, at most 0.9 of the entropy they can have is asked for."""
    bands = bands or BANDS
    band = bands.get(lang or "") or bands[script(text or "")]
    inside = band.least_chars <= found.chars_per_token <= band.most_chars and found.byte_share <= band.most_bytes
    return bool(inside and found.n_words > 0 and found.entropy >= min(np.interp(math.log2(found.n_tokens), _KNOTS, band.least_entropy), 0.9 * math.log2(found.n_tokens)))


def base_failed(found: Measured) -> bool:
    return found.n_words < 50 or 100 * found.n_repeat_words > 50 * found.n_words


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def score(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The measures of each row, base_failed, and kept: false if base_failed, else whether the fertility bands hold.

    Null and empty texts have no word and fail. A null or unknown language goes by script. Repeated rows come out as often as they go in; an
    empty table gives an empty one; other columns are not looked at. Nothing is shuffled.
    """
    path = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]

    def run(batches):
        meter = Meter(path)
        for batch in batches:
            rows = []
            for doc_id, text, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                found = meter.measure(text)
                failed = base_failed(found)
                rows.append((doc_id, *found[:5], failed, not failed and passes(found, lang, text), *found[5:]))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, _SCHEMA)


def keep_good(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that score keeps, with all their columns."""
    path, names = vocabulary or default_vocabulary(), docs.columns
    at_text, at_lang = names.index(text_col), names.index(lang_col)

    def run(batches):
        meter = Meter(path)
        for batch in batches:
            kept = []
            for text, lang in zip(batch.column(at_text), batch.column(at_lang).to_pylist(), strict=True):
                text = text.as_py()
                found = meter.measure(text)
                kept.append(not base_failed(found) and passes(found, lang, text))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
