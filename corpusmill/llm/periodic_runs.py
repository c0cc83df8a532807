"""Periodic runs of words by harmonic grid probing.

A run of period p is a stretch whose words p apart are the same, ``REPEATS`` periods long
at least, that no neighbouring word extends, and that has no smaller period.  Words p
apart are then equal at REPEATS - 1 periods' worth of neighbouring places, so at ``PROBES``
neighbouring points of the grid 0, p, 2p, ...  Probing all grids costs n/1 + n/2 + n/3 + ...
comparisons; one comparison of arrays probes many grids.  What passes, and is not ruled out by
sums of hashed words over its first periods, is extended both ways by comparing chunks of
arrays that double in size.

Periods are tried in rising order.  A grid point that lies, with two periods after it,
inside a run found before is skipped: a run of period p shares fewer than p + q words with
one of a smaller period q, so its own first grid point is never skipped.  The same bound
tells a multiple of a smaller period, since it lies inside that run.

Each document is a row of one narrow pass: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from typing import Any, NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from corpusmill.llm.common import as_bytes, text_pass

#: Periods that a run lasts at least, and words.
REPEATS = 4
LEAST = 6
#: Neighbouring grid points that every run has.
PROBES = REPEATS - 1
#: Grid points probed at once.
POINTS = 1 << 13
#: Words of the first chunk that an extension compares, and of the largest.
CHUNK = 32
LARGEST_CHUNK = 1 << 16


class Run(NamedTuple):
    """``length`` words from ``start`` on that repeat after ``period`` words."""

    start: int
    length: int
    period: int


def _equal_upto(x: np.ndarray, at: int, p: int) -> int:
    """The first place from ``at`` on whose word differs from the one p further on."""
    size, end = CHUNK, len(x) - p
    while at < end:
        to = min(at + size, end)
        differ = x[at:to] != x[at + p : to + p]
        if differ.any():
            return at + int(differ.argmax())
        at, size = to, min(2 * size, LARGEST_CHUNK)
    return end


def _equal_from(x: np.ndarray, at: int, p: int) -> int:
    """The first of the places up to ``at`` that all have the word p further on."""
    size = CHUNK
    while at > 0:
        to = max(at - size, 0)
        differ = x[to:at] != x[to + p : at + p]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, size = to, min(2 * size, LARGEST_CHUNK)
    return 0


def _probed(x: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of grid points that pass ``PROBES`` probes in a row, of periods from ``low`` to under ``high``, in order."""
    p = np.arange(low, high)
    points = (len(x) - 1) // p
    period = np.repeat(p, points)
    place = (np.arange(len(period)) - np.repeat(np.cumsum(points) - points, points)) * period
    same = x[place] == x[place + period]
    passed = same[: len(same) - PROBES + 1].copy()
    for i in range(1, PROBES):
        passed &= same[i : len(same) - PROBES + 1 + i]
    at = np.flatnonzero(passed)
    at = at[period[at] == period[at + PROBES - 1]]
    return period[at], place[at]


class _Stretches:
    """Tells by sums of hashed words where stretches can't be equal; equal ones always pass."""

    def __init__(self, x: np.ndarray) -> None:
        powers = np.full(len(x) + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers)
        terms = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((terms ^ (terms >> np.uint64(32))) * self.powers[:-1])))

    def may_equal(self, at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` on may be those from ``at + shift`` on."""
        here = self.sums[at + length] - self.sums[at]
        return here * self.powers[shift] == self.sums[at + shift + length] - self.sums[at + shift]


def runs(words: np.ndarray) -> list[Run]:
    """All runs of the numbered words, by start, then by period.

    The time follows n log n and the lengths of stretches of ``REPEATS`` - 1 periods or more.
    """
    n, found = len(words), []
    #: For each place the furthest end of a run that covers it, else 0.
    reach = np.zeros(n + 1, np.int64)
    stretches = None
    low = 1
    while REPEATS * low <= n:
        # As many grids at once as have ``POINTS`` points together.
        high = min(low + max(1, POINTS * low // n), n // REPEATS + 1, 2 * low + POINTS // n)
        period, place = _probed(words, low, high)
        keep = reach[place] < place + 2 * period
        period, place = period[keep], place[keep]
        if len(place):
            # The first two periods after a run's first grid point are the same as the two after the next one.
            stretches = stretches or _Stretches(words)
            keep = stretches.may_equal(place, period, (PROBES - 1) * period)
            period, place = period[keep], place[keep]
        last = (0, 0)
        for p, g in zip(period.tolist(), place.tolist(), strict=True):
            if last[0] == p and g < last[1] or reach[g] >= g + 2 * p:
                continue
            to = _equal_upto(words, g, p)
            last = (p, to)
            if to - g <= (PROBES - 1) * p:
                continue
            start = _equal_from(words, g, p)
            length = to + p - start
            if length >= max(LEAST, REPEATS * p) and reach[start] < start + length:
                found.append(Run(start, length, p))
                np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
        low = high
    return sorted(found, key=lambda r: (r.start, r.period))


def planted(words: list, doc_id: int | None) -> list:
    """``words``, of which for one id in ten the end repeats itself, as the id's checksum says; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def numbered(words: list) -> np.ndarray:
    """A number for each distinct word."""
    numbers: dict = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))


def collapsed(words: list, found: list[Run]) -> list:
    """``words`` without those that a run contains after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    for r in found:
        depth[r.start + r.period] += 1
        depth[r.start + r.length] -= 1
    dropped = np.cumsum(depth[:-1]) > 0
    return [w for w, d in zip(words, dropped.tolist(), strict=True) if not d] if found else words


def longest(found: list[Run]) -> Run | None:
    """The run of most periods; of equals the one that starts first, then of the smallest period."""
    return max(found, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, of the run of most periods start, length, period and exponent_milli (null without runs), runs_sha256, collapsed_sha256, collapsed_text.

    Whole texts are read.  ``collapsed_text`` is the text's kept words joined by a space.
    A null or empty text has no words, no runs and an empty
    collapsed text.  ``plant`` first lets the words of one id in ten repeat; a null id
    changes nothing.  Repeated rows give repeated results; an empty table gives none.
    """

    def work(batches: Iterator[Any]) -> Iterator[dict]:
        names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed_text")
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = planted(text.split(), doc_id) if plant else text.split()
                found = runs(numbered(words))
                best = longest(found)
                left = b" ".join(collapsed(words, found))
                line = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
                best_of = (*best, 1000 * best.length // best.period) if best else (None,) * 4
                values = (len(found), *best_of, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), left.decode())
                for name, value in zip(names, values, strict=True):
                    out[name].append(value)
            yield {"doc_id": batch.column(0), **out}

    ddl = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, collapsed_text string"
    return text_pass(docs, ddl, work)
