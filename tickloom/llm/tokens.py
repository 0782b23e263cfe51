"""Token ids of whole texts from a public vocabulary, word by word.

The vocabulary's own rules drop white space and never join what it parts, so a text's ids are its words' ids
in a row. They also lower the case and part letters, digits and signs from each other, so that words of ASCII and
Latin-1 letters can be lower-cased, parted and spelt in byte signs many at a time. Each task keeps the ids of words it has met; the tokenizers
library encodes the rest. Words with anything else in them go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words whose ids a task keeps before it forgets them all; this bounds memory and changes no result.
KEPT_WORDS = 600_000


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _bare_tokenizer(path: str):
    """The same model without normalising and parting: for pieces already spelt in byte signs."""
    from tokenizers import Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.normalizer, found.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
    return found


def _byte_signs() -> dict[int, int]:
    """How byte-level vocabularies spell bytes that are not printable Latin-1: as the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others) if b != 32}


_SPELLING = _byte_signs()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: By byte: its lower case, its class (0 blank, 1 letter, 2 digit, 3 sign), its spelling, and whether words with it go through the whole tokenizer:
#: apostrophes (some contractions join them with letters), what may start a special token, control signs, letters beyond Latin-1.
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_CLASS = np.array([_BLANK if b == 32 else _LETTER if b >= 128 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN for b in range(256)], dtype=np.uint8)
_SPELT = np.array([_SPELLING.get(b, b) for b in range(256)], dtype="<u4")
_OTHER = np.array([b < 32 or b == 127 or chr(b) in "'<" or b >= 0xC0 and b != 0xC3 for b in range(256)])
_LATIN = 0xC3  # with 0x80..0xBF: the letters U+00C0..U+00FF, and two signs
_TIMES, _DIVIDE, _SHARP_S = 0x97, 0xB7, 0x9F


# The rules of vocabularies whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"


@cache
def word_by_word(path: str) -> bool:
    """Whether a vocabulary has the rules that Encoder takes for granted; the ids of any other come from the library, text by text."""
    rules = json.loads(_tokenizer(path).to_str())
    parts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = parts[0] if len(parts) == 2 else {}
    bytes_ = parts[1] if len(parts) == 2 else {}
    parted = split.get("type") == "Split" and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
    spelt = bytes_.get("type") == "ByteLevel" and bytes_.get("add_prefix_space") is False and bytes_.get("use_regex") is False
    return rules["normalizer"] == NORMALIZER and parted and spelt and rules["model"].get("end_of_word_suffix") == WORD_END


def different(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts, each once; which of them the texts consist of, in a row; and how many words each text has."""
    whole = pc.ascii_trim_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    filled = pc.binary_length(whole).to_numpy() > 0
    counts = np.zeros(len(texts), dtype=np.int64)
    if not filled.any():
        return [], np.zeros(0, dtype=np.int64), counts
    words = pc.ascii_split_whitespace(whole.filter(pa.array(filled)))
    counts[filled] = pc.list_value_length(words).to_numpy()
    found = words.flatten().dictionary_encode()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary), " ")
    return joined.view(pa.binary())[0].as_py().split(), found.indices.to_numpy(), counts


class _Known:
    """Ids of things met, numbered in the order in which they were."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.flat, self.used, self.n = np.zeros(1 << 16, dtype=np.uint32), 0, 0
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def find(self, things: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, things), dtype=np.int64, count=len(things))

    def new(self) -> list[bytes]:
        """Things numbered since the last `add`."""
        return list(islice(reversed(self.number), len(self.number) - self.n))[::-1]

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of `new` things, one after the other."""
        n = self.n + len(sizes)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[self.n : n], self.start[self.n : n] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), n

    def gather(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, dtype=np.uint32)
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1])]


class Encoder:
    """ids(text): the token ids (uint32) of a whole text, without special tokens; null: none."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self.tokenizer, self.bare, self.kept_words, self.plain = _tokenizer(path), _bare_tokenizer(path), kept_words, word_by_word(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.words, self.pieces = _Known(), _Known()

    def _encode_plain(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie in data one blank apart, and the number of each word's ids."""
        data = _LOWER[data]
        after = np.flatnonzero(data[:-1] == _LATIN) + 1
        data[after] += np.where(data[after] < _SHARP_S, 32, 0).astype(np.uint8)
        kind = _CLASS[data]
        parted = np.zeros(len(data), dtype=bool)
        parted[1:] = (kind[1:] != _BLANK) & (kind[:-1] != _BLANK) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        pieces = np.add.reduceat(parted.astype(np.int64), starts) + 1
        apart = np.full(len(data) + int(parted.sum()), 32, dtype=np.uint8)
        apart[np.arange(len(data)) + np.cumsum(parted)] = data
        at = self.pieces.find(apart.tobytes().split())
        if new := self.pieces.new():
            text = _SPELT[np.frombuffer(b" ".join(new), dtype=np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("the vocabulary does not end each piece with one end-of-word token")
            self.pieces.add(ids, np.diff(ends, prepend=0))
        return self.pieces.gather(at), np.add.reduceat(self.pieces.size[at], np.cumsum(pieces) - pieces)

    def _learn(self, words: list[bytes]) -> None:
        """The ids of new words: plain ones together, others word by word."""
        data, n = np.frombuffer(b" ".join(words), dtype=np.uint8), len(words)
        starts = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
        odd = _OTHER[data]
        odd[:-1] |= (data[:-1] == _LATIN) & ((data[1:] == _TIMES) | (data[1:] == _DIVIDE))
        whole, lengths = np.logical_or.reduceat(odd, starts), np.diff(np.append(starts, len(data) + 1))
        if not whole.any():
            self.words.add(*self._encode_plain(data, starts))
            return
        sizes = np.zeros(n, dtype=np.int64)
        ids = np.zeros(0, dtype=np.uint32)
        if not whole.all():
            ids, sizes[~whole] = self._encode_plain(data[np.repeat(~whole, lengths)[: len(data)]], np.cumsum(lengths[~whole]) - lengths[~whole])
        texts = [words[i].decode("utf-8", "replace") for i in np.flatnonzero(whole).tolist()]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes[whole] = [len(x) for x in found]
        flat, of_whole = np.empty(int(sizes.sum()), dtype=np.uint32), np.repeat(whole, sizes)
        flat[~of_whole], flat[of_whole] = ids, [i for x in found for i in x]
        self.words.add(flat, sizes)

    def ids(self, text: str | None) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of several texts: a word that they share is looked up once, and new words are encoded together."""
        if not self.plain:
            whole = [(text or "").encode("utf-8", "replace").decode("utf-8", "replace") for text in texts]
            return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        if self.words.n > self.kept_words:
            self.words, self.pieces = _Known(), _Known()
        words, at, counts = different([(text or "").encode("utf-8", "replace") for text in texts])
        numbers = self.words.find(words)
        if new := self.words.new():
            self._learn(new)
        places = numbers[at]
        flat = self.words.gather(places)
        edges = np.append(0, np.cumsum(self.words.size[places]))[np.append(0, np.cumsum(counts))].tolist()
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def encoded(encoder: Encoder, texts: Iterable[str | None], characters: int = 1 << 21) -> Iterator[np.ndarray]:
    """ids of texts, one after the other, encoded in groups of about so many characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= characters:
            yield from encoder.ids_of(held)
            held, size = [], 0
    yield from encoder.ids_of(held)
