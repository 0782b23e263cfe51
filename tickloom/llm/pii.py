"""Operator 7, personal data: a character-level BiLSTM-CRF beside fixed patterns.

The patterns' matches always stand. The network reads overlapping windows on a fixed grid, each decoded by Viterbi. Then the document's tags are
put together: a character has the tag of the window in which it lies most inside. Tagged runs that keep the kind's own rules (an at sign and a
domain, four parts up to 255, 13 to 19 digits with a right check digit, 9 to 15 digits) and touch no pattern match are added. No run without a
digit or an at sign keeps them. So windows far from all of these are left out, unless a run reaches them: the spans are those that reading
every window gives.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bilstm import CLASSES, KINDS, WINDOW, Tagger, classes, trained, viterbi

# The patterns of the four kinds. Runs are taken whole, and not tried again from within, so that each is read once.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: Windows overlap by half; from each one's middle its tags are taken. So far from a trigger a window is read at first.
STEP, MARGIN = WINDOW // 2, 32
_TRIGGER = re.compile(r"[0-9@]")
_AT_ONCE = 512


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def valid(kind: str, value: str) -> bool:
    """The kind's own rules, beyond its pattern."""
    digits = _digits(value)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split(".")) if len(value) < 64 else all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain that do not overlap: read outward from each at sign, in linear time."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        last = max(at + 1, domain.end() if domain else 0)
        at = text.find("@", last)
    return found


def by_pattern(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, less those that break the kind's rules."""
    found = [Span("email", *span) for span in emails(text)]
    if re.search("[0-9]", text):
        for kind in KINDS[1:]:
            found += [Span(kind, *m.span()) for m in PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return found


def owner(at: int) -> int:
    """The window from which a character's tag is taken: window k starts at k * STEP."""
    return max(0, (at - STEP // 2) // STEP)


def _owned(k: int, length: int) -> tuple[int, int]:
    """The characters that window k gives tags to."""
    return (0 if k == 0 else k * STEP + STEP // 2), min(length, k * STEP + STEP // 2 + STEP)


def first_windows(text: str) -> set[int]:
    """The windows near a digit or an at sign."""
    found, top = set(), owner(len(text) - 1) if text else 0
    for m in _TRIGGER.finditer(text):
        low, high = owner(max(0, m.start() - MARGIN)), min(top, owner(m.start() + MARGIN))
        if high not in found or low not in found:
            found.update(range(low, high + 1))
    return found


def _plausible(kind: str, value: str) -> bool:
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", value) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value) is not None and valid(kind, value)
    if kind == "phone" and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", value) is None:
        return False
    if kind == "phone" and not re.search(r"[^0-9]", value):
        return False
    return valid(kind, value)


def _trimmed(text: str, span: Span) -> Span:
    start, end = span.start, span.end
    while start < end and text[start] in " \n\t|,.;:":
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    return Span(span.kind, start, end)


def runs(length: int, tags: dict[int, np.ndarray]) -> tuple[list[tuple[int, int, int]], set[int]]:
    """(kind, start, end) of tagged runs over the windows that were read, and the windows next to them that a run reaches."""
    found, reached, now, before = [], set(), None, None
    for k in sorted(tags):
        low, high = _owned(k, length)
        if before is not None and k != before + 1:
            if now and now[2] == _owned(before, length)[1]:
                reached.add(before + 1)
            if now:
                found.append(tuple(now))
            now = None
        row = tags[k][low - k * STEP : high - k * STEP]
        for offset in np.flatnonzero(row).tolist() if row.any() else ():
            at, tag = low + offset, int(row[offset])
            kind = (tag - 1) // 2
            if now and tag % 2 == 0 and kind == now[0] and at == now[2]:
                now[2] = at + 1
                continue
            if now:
                found.append(tuple(now))
            now = [kind, at, at + 1]
            if at == low and k and k - 1 not in tags:
                reached.add(k - 1)
        before = k
    if now:
        found.append(tuple(now))
        if now[2] == _owned(before, length)[1] < length:
            reached.add(before + 1)
    return found, reached


def with_runs(text: str, base: list[Span], found: list[tuple[int, int, int]]) -> list[Span]:
    """Base spans and the runs that keep their kind's rules and touch none of them, by kind and start."""
    spans = set(base)
    for kind, start, end in found:
        span = _trimmed(text, Span(KINDS[kind], start, end))
        if not any(span.start < b.end and b.start < span.end for b in base) and _plausible(span.kind, text[span.start : span.end]):
            spans.add(span)
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start))


def find(texts: list[str | None], net: Tagger, everywhere: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each whole text; null counts as empty. `everywhere` reads every window, which gives the same spans."""
    texts = [t or "" for t in texts]
    bases = [by_pattern(t) for t in texts]
    tags: list[dict[int, np.ndarray]] = [{} for _ in texts]
    todo = [(i, k) for i, t in enumerate(texts) for k in (range(owner(len(t) - 1) + 1) if everywhere and t else sorted(first_windows(t)))]
    while todo:
        ids = np.full((len(todo), WINDOW), CLASSES - 1, dtype=np.intp)
        for row, (i, k) in zip(ids, todo, strict=True):
            part = classes(texts[i][k * STEP : k * STEP + WINDOW])
            row[: len(part)] = part
        for at in range(0, len(todo), _AT_ONCE):
            for (i, k), row in zip(todo[at : at + _AT_ONCE], viterbi(net, net.run(ids[at : at + _AT_ONCE])), strict=True):
                tags[i][k] = row
        touched = {i for i, _ in todo}
        todo = [(i, k) for i in sorted(touched) for k in sorted(runs(len(texts[i]), tags[i])[1] - tags[i].keys())]
    out = []
    for text, base, read in zip(texts, bases, tags, strict=True):
        out.append((sorted(base, key=lambda s: (KINDS.index(s.kind), s.start)), with_runs(text, base, runs(len(text), read)[0])))
    return out


def to_string(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of touching or overlapping spans replaced by the first one's kind in brackets."""
    out, last = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= last:
            out += [text[last : span.start], f"[{span.kind.upper()}]"]
        last = max(last, span.end)
    return "".join([*out, text[last:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _in_slices(batch, size: int = 1000):
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def scan(docs: DataFrame, net: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row.

    Counts and digest are of the patterns' spans, `spans` has all. Offsets count code points, ends are exclusive. Null and empty texts have none.
    Repeated rows come out as often as they go in; an empty table gives an empty one; other columns are not looked at. Nothing is shuffled.
    """
    net = net or trained()
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        for part in (x for batch in batches for x in _in_slices(batch)):
            rows = []
            for doc_id, (base, spans) in zip(part.column(0).to_pylist(), find(part.column(1).to_pylist(), net), strict=True):
                counts = [sum(s.kind == k for s in base) for k in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(to_string(base).encode()).hexdigest(), to_string(spans)))
            types = [*[pa.int64()] * 5, pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def redacted(docs: DataFrame, net: Tagger | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with spans replaced by their kind in brackets, and the length column, if there is one, made to fit."""
    net, names = net or trained(), docs.columns
    at_text = names.index(text_col)
    at_length = names.index(length_col) if length_col in names else None

    def run(batches):
        for part in (x for batch in batches for x in _in_slices(batch)):
            texts = part.column(at_text).to_pylist()
            clean = [None if t is None else redact(t, spans) for t, (_, spans) in zip(texts, find(texts, net), strict=True)]
            columns = list(part.columns)
            columns[at_text] = pa.array(clean, part.schema.field(at_text).type)
            if at_length is not None:
                old = columns[at_length].to_pylist()
                new = [n if n is None or before == after else len(after) for n, before, after in zip(old, texts, clean, strict=True)]
                columns[at_length] = pa.array(new, part.schema.field(at_length).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
