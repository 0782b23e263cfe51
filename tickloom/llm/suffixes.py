"""Suffix arrays of one shard by induced sorting, and permuted common prefixes, in numpy.

Induction reads the array in order and puts each suffix's predecessor into its bucket. Buckets that cannot reach each
other are read together: a block of them is taken as far as no suffix of it has its predecessor inside the block,
and a bucket that reaches itself (runs of one symbol) is written in one step from the lengths of the runs.
"""

from __future__ import annotations

import numpy as np


def _append(sa: np.ndarray, heads: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray) -> None:
    """Write suffixes behind what their buckets hold, in the order given."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered)))
    held = ordered[first]
    sa[np.repeat(heads[held] - first, counts) + np.arange(len(ordered))] = suffixes[order]
    heads[held] += counts


def _induce(text: np.ndarray, wanted: np.ndarray, run: np.ndarray, sa: np.ndarray, start: np.ndarray) -> None:
    """Fill the front of each bucket with the wanted suffixes; sa holds the seeds at the ends of the buckets, -1 elsewhere.

    run[i]: how many symbols before i, without a gap, equal that at i.
    """
    heads, size, step = start[:-1].copy(), len(start) - 1, max(64, int(4 * len(text) ** 0.5))

    def before(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        found = sa[low:high]
        found = found[found > 0] - 1
        found = found[wanted[found]]
        return found, text[found]

    c = 0
    while c < size:
        last = min(size, max(c + 1, int(np.searchsorted(start, start[c] + step, side="right")) - 1))
        if last > c + 1:
            found, symbols = before(start[c], start[last])
            reach = int(symbols.min()) if len(symbols) else last
            if c < reach < last:
                last = reach
                found, symbols = before(start[c], start[last])
            if reach > c:
                if len(found):
                    _append(sa, heads, found, symbols)
                c = last
                continue
        held = sa[start[c] : heads[c]]
        more = run[held]
        total = int(more.sum())
        if total:  # suffixes of this bucket that follow from others of it: nearest ones first, each round in the order of the bucket
            which = np.repeat(np.arange(len(held)), more)
            far = np.arange(total) - np.repeat(np.cumsum(more) - more, more)
            order = np.argsort(far, kind="stable")
            sa[heads[c] : heads[c] + total] = (held[which] - 1 - far)[order]
            heads[c] += total
        found, symbols = before(start[c], start[c + 1])
        other = symbols != c
        if other.any():
            _append(sa, heads, found[other], symbols[other])
        c += 1


def _runs(text: np.ndarray) -> np.ndarray:
    """For each place, the number of equal symbols just before it."""
    at = np.arange(len(text), dtype=np.int32)
    change = np.concatenate(([True], text[1:] != text[:-1]))
    return at - np.maximum.accumulate(np.where(change, at, 0))


def _sort(text: np.ndarray, start: np.ndarray, smaller: np.ndarray, run: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from that of the seeds, leftmost-smaller suffixes: first the larger ones from bucket fronts, then the smaller from bucket ends."""
    n, size = len(text), len(start) - 1
    sa = np.full(n, -1, dtype=np.int32)
    symbols = text[seeds]
    counts = np.bincount(symbols, minlength=size)
    order = np.argsort(symbols, kind="stable")
    sa[np.repeat(start[1:] - np.cumsum(counts), counts) + np.arange(len(seeds))] = seeds[order]
    _induce(text, ~smaller, run, sa, start)
    sa[smaller[np.maximum(sa, 0)] & (sa >= 0)] = -1
    sa[0] = n - 1
    back = sa[::-1].copy()
    # read from the other end, symbols and buckets count down; the same step then fills the smaller suffixes
    mirrored = (size - 1 - text.astype(np.int64)).astype(text.dtype)
    _induce(mirrored, smaller, run, back, n - start[::-1])
    return back[::-1].copy()


def agreeing(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of symbols, at most `most`, that agree from a and from b on; all within the text."""
    out = np.zeros(len(a), dtype=np.int32)
    left = np.flatnonzero(most > 0)
    k = 0
    while len(left) > 16 or (len(left) and k < 16):
        left = left[text[a[left] + k] == text[b[left] + k]]
        k += 1
        out[left] = k
        left = left[most[left] > k]
    for i in left:  # few and long: in growing pieces
        x, y, done, piece = int(a[i]), int(b[i]), k, 64
        while done < most[i]:
            end = min(int(most[i]), done + piece)
            unlike = text[x + done : x + end] != text[y + done : y + end]
            if unlike.any():
                done += int(unlike.argmax())
                break
            done, piece = end, piece * 2
        out[i] = done
    return out


#: Texts up to this length end the recursion.
SHORT = 1 << 17


def _doubled(text: np.ndarray) -> np.ndarray:
    """The suffixes in order by ranks of prefixes that double in length: the end of the recursion."""
    n, rank, reach = len(text), text.astype(np.int64), 1
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        sa = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = np.cumsum(np.concatenate(([False], key[sa[1:]] != key[sa[:-1]])))
        if rank[sa[-1]] == n - 1:
            return sa.astype(np.int32)
        reach *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of a text of integers from 0 to symbols - 1 in order; the last is 0 and no other is."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
    # a suffix is smaller than the next one if its first change of symbol goes up
    at = np.arange(n - 1, dtype=np.int32)
    change = np.minimum.accumulate(np.where(text[1:] != text[:-1], at, n)[::-1])[::-1]
    smaller = np.append(text[change] < text[change + 1], True)
    leftmost = smaller & np.concatenate(([False], ~smaller[:-1]))
    places = np.flatnonzero(leftmost).astype(np.int32)
    run = _runs(text)
    if len(places) > 1:
        found = _sort(text, start, smaller, run, places)
        found = found[leftmost[found]]
        # names: leftmost-smaller substrings, from one such place to the next one, are equal if their symbols are
        number = np.empty(n, dtype=np.int32)
        number[places] = np.arange(len(places), dtype=np.int32)
        length = np.append(np.diff(places) + 1, 1)[number[found]]
        same = np.zeros(len(found), dtype=bool)
        alike = np.flatnonzero(length[1:] == length[:-1])
        same[alike + 1] = agreeing(text, found[alike], found[alike + 1], length[alike]) == length[alike]
        names = np.cumsum(~same, dtype=np.int32) - 1
        total = int(names[-1]) + 1
        if total == len(places):
            places = found
        else:
            reduced = np.empty(len(places), dtype=np.int32)
            reduced[number[found]] = names
            places = places[_doubled(reduced) if len(reduced) <= SHORT else suffix_array(reduced, total)]
    return _sort(text, start, smaller, run, places)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the text, how many symbols its suffix shares with the one before it in the array (the first: 0).

    Only places that do not follow from the one before are compared; the others share one symbol less than it.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, dtype=bool)
    follows[1:] = (before[1:] > 0) & (before[1:] == before[:-1] + 1) & (text[:-1] == text[before[:-1]])
    own = np.flatnonzero(~follows & (before >= 0))
    shared = np.zeros(n, dtype=np.int32)
    shared[own] = agreeing(text, own, before[own], n - np.maximum(own, before[own]))
    at = np.arange(n, dtype=np.int32)
    origin = np.maximum.accumulate(np.where(follows, 0, at))
    return np.maximum(shared[origin] - (at - origin), 0)
