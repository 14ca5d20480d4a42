"""Periodic runs of words: Main-Lorentz over interned word ids.

A text's words are cut in halves again and again, at the multiples of powers of
two.  At each midpoint m a Z-function gives, for every period p, how far the
words from m on equal those from m + p on, and another one the same backwards
from m - 1 and m - p - 1.  A run of four or more periods has two of them on one
side of the midpoint of the smallest part that holds it, so a Z-value of p or
more is where a run may cross.  It is extended to both sides, equal intervals
are joined, and the smallest period stays.

Z-values are read off hashes of prefixes by bisection, for all midpoints and
periods of a level at once.  Every run is then compared word for word; if that
fails anywhere, the hashes are drawn anew.  A hash can only make a Z-value too
large, so no run is missed.  Rows are worked on where they lie: nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, spans_of, text_buffer, tidy, word_bounds

#: A run has so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Pairs of midpoint and period that are looked at at once.
PAIRS = 1 << 20

_BASE = 0x9E3779B97F4A7C15


def interned(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Id of each word (equal words, equal ids), its start and end byte, and the
    words before each document (n + 1 entries)."""
    starts, ends, first = word_bounds(raw, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.int64), starts, ends, first
    # Bytes outside words go, so the words lie side by side as Arrow has them.
    edges = np.zeros(len(raw) + 1, np.int8)
    edges[starts] += 1
    np.subtract.at(edges, ends, 1)
    packed = raw[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=lengths[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(packed))])
    return np.asarray(words.dictionary_encode().indices).astype(np.int64), starts, ends, first


class _Hashes:
    """Hashes of stretches of words, as prefix sums of id * base^i modulo 2^64."""

    def __init__(self, ids: np.ndarray, seed: int):
        n = len(ids)
        self.up = np.full(n + 1, (_BASE + 2 * seed) | 1, np.uint64)
        self.up[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1 + seed)) * self.up[:n], out=self.sums[1:])

    def equal(self, a: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``a`` on are those from ``a + p`` on."""
        s = self.sums
        return (s[a + size] - s[a]) * self.up[p] == s[a + p + size] - s[a + p]

    def ahead(self, a: np.ndarray, p: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The most words, ``room`` at most, for which ``equal`` holds."""
        return self._most(lambda size, i: self.equal(a[i], p[i], size), room)

    def back(self, a: np.ndarray, p: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The same for the words before ``a`` and before ``a + p``."""
        return self._most(lambda size, i: self.equal(a[i] - size, p[i], size), room)

    @staticmethod
    def _most(fits, room: np.ndarray) -> np.ndarray:
        """The largest size up to ``room`` that fits: doubled until it doesn't, then
        bisected, each pair as far as it goes."""
        low, high = np.zeros(len(room), np.int64), room.astype(np.int64, copy=True)
        size = 1
        alive = np.flatnonzero(high > 0)
        while len(alive):
            probe = np.minimum(size, high[alive])
            ok = fits(probe, alive)
            low[alive[ok]] = probe[ok]
            high[alive[~ok]] = probe[~ok] - 1
            alive = alive[ok & (low[alive] < high[alive])]
            size *= 2
        alive = np.flatnonzero(low < high)
        while len(alive):
            probe = (low[alive] + high[alive] + 1) // 2
            ok = fits(probe, alive)
            low[alive[ok]] = probe[ok]
            high[alive[~ok]] = probe[~ok] - 1
            alive = alive[low[alive] < high[alive]]
        return low


def _midpoints(first: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Midpoints of all parts of 2 * half words, and their document."""
    n = np.diff(first)
    count = np.maximum(0, (n - 1 + half) // (2 * half))
    doc = np.repeat(np.arange(len(n)), count)
    before = np.cumsum(count) - count
    return first[doc] + half * (2 * (np.arange(len(doc)) - before[doc]) + 1), doc


def _crossing(ids, first, hashes) -> np.ndarray:
    """Rows (start, end, period) of stretches with a period that cross a midpoint
    and can't be extended, LEAST_PERIODS of it at least; some more than once."""
    out = [np.zeros((0, 3), np.int64)]
    longest = int(np.diff(first).max(initial=0))
    half = 4
    while half < longest:
        mids, docs = _midpoints(first, half)
        periods = np.arange(1, half // 2 + 1)
        step = max(1, PAIRS // len(periods))
        for at in range(0, len(mids), step):
            m, d = mids[at : at + step, None], docs[at : at + step, None]
            low, high = first[d], first[d + 1]
            for right in (True, False):
                # Two periods to one side, the first words alike: else z is 0.
                if right:
                    i, j = np.nonzero((m + 2 * periods <= high) & (ids[m] == ids[np.minimum(m + periods, len(ids) - 1)]))
                else:
                    i, j = np.nonzero((m - 2 * periods >= low) & (ids[m - 1] == ids[np.maximum(m - 1 - periods, 0)]))
                p, mid, lo, hi = periods[j], m[i, 0], low[i, 0], high[i, 0]
                # a and a + p: the two midpoints of the comparison.
                a = mid if right else mid - p
                z = hashes.ahead(a, p, hi - a - p) if right else hashes.back(a, p, a - lo)
                go = z >= p
                a, p, lo, hi, z = a[go], p[go], lo[go], hi[go], z[go]
                other = hashes.back(a, p, a - lo) if right else hashes.ahead(a, p, hi - a - p)
                start, end = (a - other, a + p + z) if right else (a - z, a + p + other)
                go = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
                out.append(np.stack([start[go], end[go], p[go]], axis=1))
        half *= 2
    return np.concatenate(out)


def _confirmed(ids: np.ndarray, runs: np.ndarray) -> bool:
    """Whether all runs (start, end, period) are periodic word for word."""
    for at in range(0, len(runs), 4096):
        start, end, p = runs[at : at + 4096].T
        room = end - start - p
        for a in range(0, len(room)):
            s, e, q = start[a], end[a], p[a]
            if not np.array_equal(ids[s : e - q], ids[s + q : e]):
                return False
    return True


def runs_of(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period; starts and ends
    count over all documents, whose words are ``ids`` from ``first[d]`` to
    ``first[d + 1]``.  A run is a stretch of max(LEAST_WORDS, LEAST_PERIODS times its
    smallest period) words or more that its neighbours don't extend."""
    seed = 0
    while True:
        runs = _crossing(ids, first, _Hashes(ids, seed))
        if len(runs):
            runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
            fresh = np.ones(len(runs), bool)
            fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
            runs = runs[fresh]
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        if _confirmed(ids, runs):
            return runs
        seed += 1


def planted(n: np.ndarray, h: np.ndarray) -> np.ndarray | None:
    """For each word of each document the word of it that stands there: where the
    document's draw h is divisible by 10, the words from g % n on repeat the first p
    of them (g = h // 10, p = 1 + (n - g % n) // (3 + g % 8)).  Numbers count within
    the document; None where nothing changes."""
    hit = np.flatnonzero((h % 10 == 0) & (n > 0))
    if len(hit) == 0:
        return None
    before = np.cumsum(n) - n
    out = np.arange(int(n.sum())) - np.repeat(before, n)
    for d in hit:
        g = int(h[d]) // 10
        a = g % int(n[d])
        p = 1 + (int(n[d]) - a) // (3 + g % 8)
        own = out[before[d] + a : before[d] + n[d]]
        own[:] = a + (own - a) % p
    return out


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> list[memoryview]:
    """For each of len(counts) documents its words, ``counts`` of them in turn, with
    one blank between two."""
    size = ends - starts + 1
    place = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=place[1:])
    source = np.arange(int(place[-1])) + np.repeat(starts - place[:-1], size)
    out = raw[np.minimum(source, max(len(raw) - 1, 0))] if len(raw) else np.zeros(0, np.uint8)
    out[place[1:] - 1] = 32
    held, upto = memoryview(np.ascontiguousarray(out)), np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=upto[1:])
    bounds = place[upto]
    return [held[bounds[i] : max(bounds[i], bounds[i + 1] - 1)] for i in range(len(counts))]


def _span(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray | None, collapsed: bool) -> list[tuple]:
    """What ``periodic`` returns for some documents, ids apart."""
    ids, starts, ends, first = interned(raw, offsets)
    n = np.diff(first)
    moved = planted(n, draws) if draws is not None else None
    if moved is not None:
        moved = moved + np.repeat(first[:-1], n)
        ids, starts, ends = ids[moved], starts[moved], ends[moved]
    runs = runs_of(ids, first)
    doc = np.searchsorted(first, runs[:, 0], side="right") - 1
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(dropped, runs[:, 1], 1)
    kept = np.cumsum(dropped[:-1]) == 0
    sums = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(kept, out=sums[1:])
    texts = joined_words(raw, starts[kept], ends[kept], np.diff(sums[first]))
    bounds = np.searchsorted(doc, np.arange(len(n) + 1))
    out = []
    for d in range(len(n)):
        own = runs[bounds[d] : bounds[d + 1]] - [first[d], first[d], 0]
        best, shown = (None,) * 4, hashlib.sha256()
        if len(own):
            s, size, p = own[:, 0], own[:, 1] - own[:, 0], own[:, 2]
            shown.update("".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), size.tolist(), p.tolist(), strict=True)).encode())
            top = 0
            for i in range(1, len(own)):  # exact ratios; rows go by start, then period
                if int(size[i]) * int(p[top]) > int(size[top]) * int(p[i]):
                    top = i
            best = (int(s[top]), int(size[top]), int(p[top]), 1000 * int(size[top]) // int(p[top]))
        text = bytes(texts[d]).decode("utf-8", "replace") if collapsed else None
        out.append((len(own), *best, shown.hexdigest(), hashlib.sha256(texts[d]).hexdigest(), text))
    return out


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic(docs: DataFrame, plant: bool = False, collapsed: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) for each row of ``docs`` (doc_id, text), with ``collapsed`` also
    the text without its repetitions.

    Words are those of ``WORD_PATTERN``, numbered from 0.  The run shown is that of
    the greatest length / period, then the smallest start, then the smallest period;
    without a run it is four nulls.  A word goes if a run holds it behind its first
    period; the words kept are joined by one blank.  ``plant`` first makes one of ten
    documents periodic by the crc32 of its decimal id (``planted``; a null id counts
    as the empty text).  Null and empty texts have no word; repeated rows and ids
    are rows of their own; an empty table gives none; other columns are passed over.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")[1:]] + ["collapsed"]

    def run(batches):
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            keys = b.column(0).to_pylist()
            draws = np.array([zlib.crc32(b"" if k is None else str(k).encode()) for k in keys], np.int64) if plant else None
            for x, y in spans_of(offsets):
                rows = _span(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], draws[x:y] if plant else None, collapsed)
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.string()] * 3
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), *arrays][: 9 if collapsed else 8], ["doc_id", *names][: 9 if collapsed else 8])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(tidy(run), SCHEMA + (", collapsed string" if collapsed else ""))
