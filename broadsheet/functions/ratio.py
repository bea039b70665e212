"""Ratcliff and Obershelp's ratio as difflib has it (autojunk, no junk function), for many pairs at a time.

difflib looks for the longest run of equal characters in a rectangle of two texts, then in what is before it in both and behind it in both. It begins runs
only at characters that are not popular in the second text, and lets them go on over any. Here all places where such characters meet are listed once a pair,
and all rectangles of many pairs are split in the same step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np

#: Places where characters meet that are held at a time, and of a pair; a pair with more is compared by difflib itself, which holds fewer of them.
HELD = 1_000_000
MOST_OF_PAIR = 4_000_000
#: Bits of a place in a text.
BITS = 20
ONE = 1 << (2 * BITS)
#: Characters that extensions go on by together, before each goes on by itself.
STEPS = 12
#: Texts from this length on have popular characters: more than a hundredth of the text, and one.
POPULAR_FROM = 200


class Alphabet:
    """Numbers for the characters of some texts, from 0 on as they come."""

    def __init__(self):
        self.number = np.full(0x110000, -1, np.int32)
        self.size = 0

    def numbers(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.number[codes]
        if len(found) and found.min() < 0:
            new = np.unique(codes[found < 0])
            self.number[new] = np.arange(self.size, self.size + len(new))
            self.size += len(new)
            found = self.number[codes]
        return found


class Text:
    """A text's characters as numbers; as the second of a pair, their places by character, without the popular ones. Pairs are of texts of one alphabet."""

    def __init__(self, text: str, alphabet: Alphabet):
        self.text = text
        self.codes = alphabet.numbers(text)
        self._second = None

    def second(self):
        """(how many places each character has, where these begin, places); the last character stands for all that the text does not have."""
        if self._second is None:
            n = len(self.codes)
            counts = np.append(np.bincount(self.codes), 0)
            begin = np.cumsum(counts) - counts
            # Sorting is faster for 16 bits.
            order = np.argsort(self.codes.astype(np.uint16) if len(counts) < 1 << 16 else self.codes, kind="stable").astype(np.int32)
            self._second = np.where(counts <= n // 100 + 1, counts, 0) if n >= POPULAR_FROM else counts, begin, order
        return self._second


def _met(a: Text, b: Text):
    """(places in a that meet any, how many each meets, where these begin in b's places)."""
    counts, begin, _ = b.second()
    codes = np.minimum(a.codes, len(counts) - 1)
    met = counts[codes]
    where = np.flatnonzero(met)
    return where, met[where], begin[codes[where]]


def _runs(i: np.ndarray, j: np.ndarray, on: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How many places in a row, up to this one, meet diagonally in their pair; on: whether the one before does."""
    run = np.ones(len(i), np.int64)
    some = np.flatnonzero(on)
    if len(some):
        x = i[some].astype(np.int64)
        diagonal = (np.searchsorted(np.cumsum(held), some, side="right") << (BITS + 1)) + j[some] - x + (1 << BITS)
        order = np.lexsort((x, diagonal))
        x, diagonal = x[order], diagonal[order]
        new = np.ones(len(x), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (x[1:] != x[:-1] + 1)
        first = np.flatnonzero(new)
        # The first of a run has none before it, so it is not among these.
        run[some[order]] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) + 2
    return run


def _further(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many characters from x in a and y in b on are equal, by step 1 or -1, at most `most`."""
    out = np.zeros(len(x), np.int64)
    left = np.flatnonzero(most > 0)
    for k in range(STEPS):
        if not len(left):
            return out
        left = left[a[x[left] + k * step] == b[y[left] + k * step]]
        out[left] += 1
        left = left[most[left] > k + 1]
    for r in left:
        done, limit, size = STEPS, int(most[r]), 32
        while done < limit:
            n = min(size, limit - done)
            p, q = int(x[r]) + done * step, int(y[r]) + done * step
            s, t = (a[p : p + n], b[q : q + n]) if step > 0 else (a[p - n + 1 : p + 1][::-1], b[q - n + 1 : q + 1][::-1])
            unlike = s != t
            if unlike.any():
                done += int(unlike.argmax())
                break
            done += n
            size *= 2
        out[r] = done
    return out


def _matched(group: list[tuple[Text, Text, tuple]]) -> np.ndarray:
    """How many characters each pair's two texts have in common."""
    n = len(group)
    sizes = np.array([[len(a.codes), len(b.codes)] for a, b, _ in group], np.int64)
    begin_a, begin_b = (np.concatenate([[0], np.cumsum(sizes[:, k])[:-1]]) for k in (0, 1))
    a, b = np.concatenate([x.codes for x, _, _ in group]), np.concatenate([y.codes for _, y, _ in group])
    held = np.array([met[1].sum() for _, _, met in group], np.int64)
    of = np.flatnonzero(held)
    none = np.flatnonzero(held == 0)
    # A rectangle where nothing meets has a match at its corner, if any.
    total = np.zeros(n, np.int64)
    total[none] = _further(a, b, begin_a[none], begin_b[none], sizes[none].min(1), 1)
    if not len(of):
        return total
    # Where characters meet: by pair, then by place in the first text, then in the second.
    lists, marked = [], np.zeros(len(a), bool)
    for k in of:
        where, counts, begin = group[k][2]
        marked[where + begin_a[k]] = True
        before = np.cumsum(counts) - counts
        j = group[k][1].second()[2][np.repeat(begin - before, counts) + np.arange(held[k])]
        lists.append((np.repeat(where.astype(np.int32), counts), j))
    i, j = (np.concatenate([x[side] for x in lists]) for side in (0, 1))
    del lists
    at_a, at_b = i + np.repeat(begin_a[of] - 1, held[of]), j + np.repeat(begin_b[of] - 1, held[of])
    on = (i > 0) & (j > 0) & marked[at_a] & (a[at_a] == b[at_b])
    run = _runs(i, j, on, held[of])
    # The longest run first, then the first place in the first text, then in the second: the largest of these numbers.
    key = (run << (2 * BITS)) - ((i.astype(np.int64) << BITS) | j)
    del at_a, at_b, on, run
    held = held[of]
    lo_a, hi_a, lo_b, hi_b = np.zeros(len(of), np.int64), sizes[of, 0], np.zeros(len(of), np.int64), sizes[of, 1]
    while len(of):
        starts = np.cumsum(held) - held
        best = np.maximum.reduceat(key, starts)
        size = (best + ONE - 1) >> (2 * BITS)
        place = (size << (2 * BITS)) - best
        at_a, at_b = (place >> BITS) - size + 1, (place & (1 << BITS) - 1) - size + 1
        x, y = begin_a[of], begin_b[of]
        back = _further(a, b, x + at_a - 1, y + at_b - 1, np.minimum(at_a - lo_a, at_b - lo_b), -1)
        at_a, at_b, size = at_a - back, at_b - back, size + back
        size = size + _further(a, b, x + at_a + size, y + at_b + size, np.minimum(hi_a - at_a, hi_b - at_b) - size, 1)
        end_a, end_b = at_a + size, at_b + size
        total += np.bincount(of, size, n).astype(np.int64)
        low = (i < np.repeat(at_a.astype(np.int32), held)) & (j < np.repeat(at_b.astype(np.int32), held))
        high = (i >= np.repeat(end_a.astype(np.int32), held)) & (j >= np.repeat(end_b.astype(np.int32), held))
        # What is before and behind each match, in turn.
        m = 2 * len(of)
        parts = np.empty((5, m), np.int64)
        parts[0, ::2], parts[0, 1::2] = lo_a, end_a
        parts[1, ::2], parts[1, 1::2] = at_a, hi_a
        parts[2, ::2], parts[2, 1::2] = lo_b, end_b
        parts[3, ::2], parts[3, 1::2] = at_b, hi_b
        parts[4, ::2], parts[4, 1::2] = of, of
        held = np.empty(m, np.int64)
        held[::2], held[1::2] = np.add.reduceat(low, starts, dtype=np.int64), np.add.reduceat(high, starts, dtype=np.int64)
        bare = np.flatnonzero((held == 0) & (parts[1] > parts[0]) & (parts[3] > parts[2]))
        p = parts[:, bare]
        total += np.bincount(p[4], _further(a, b, begin_a[p[4]] + p[0], begin_b[p[4]] + p[2], np.minimum(p[1] - p[0], p[3] - p[2]), 1), n).astype(np.int64)
        lo_a, hi_a, lo_b, hi_b, of = parts[:, held > 0]
        held = held[held > 0]
        stay = np.flatnonzero(low | high)
        i, j, key = i[stay], j[stay], key[stay]
        # Runs that begin before their rectangle are cut.
        some = np.flatnonzero(key > ONE)
        if len(some):
            rect = np.searchsorted(np.cumsum(held), some, side="right")
            run = (key[some] + ONE - 1) >> (2 * BITS)
            x, y = i[some].astype(np.int64), j[some].astype(np.int64)
            key[some] = (np.minimum(run, np.minimum(x - lo_a[rect], y - lo_b[rect]) + 1) << (2 * BITS)) - ((x << BITS) | y)
    return total


def ratios(pairs: Iterable[tuple[Text, Text]]) -> Iterator[float]:
    """The ratio of each pair, in order; 0 if either text is empty."""
    group: list[tuple[Text, Text, tuple]] = []
    waiting: list[float | None] = []
    held = 0

    def done() -> Iterator[float]:
        nonlocal held
        found = iter(_matched(group)) if group else iter(())
        lengths = iter([len(a.codes) + len(b.codes) for a, b, _ in group])
        yield from [2.0 * int(next(found)) / next(lengths) if w is None else w for w in waiting]
        group.clear()
        waiting.clear()
        held = 0

    for a, b in pairs:
        if not len(a.codes) or not len(b.codes):
            waiting.append(0.0)
            continue
        met = _met(a, b)
        n = int(met[1].sum())
        if n > MOST_OF_PAIR or max(len(a.codes), len(b.codes)) >= 1 << BITS:
            waiting.append(SequenceMatcher(None, a.text, b.text).ratio())
            continue
        if held and held + n > HELD:
            yield from done()
        group.append((a, b, met))
        waiting.append(None)
        held += n + len(a.codes) + len(b.codes)
    yield from done()
