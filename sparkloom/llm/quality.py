"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 .. K-1 share one weight vector over hashed text features; K-1 ordered
thresholds turn the score s into tail probabilities P(grade > k) = sigmoid(s -
t_k), which give the expected grade and the probability that a selection uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans_of, text_buffer, tidy, word_bounds, word_hashes, written
from .near_dedup import lowered

DIMENSIONS = 1 << 20
#: Features of the text's shape: 6 measures in 12 steps each.
SHAPES, STEPS = 6, 12
#: Labelled rows that a fit reads at most, taken in the order of a hash of doc_id.
MAX_LABELLED = 20_000
MIN_DOCUMENTS = 5
#: Standard errors that a term's mean grade must be off the overall mean to get a weight.
SIGNIFICANT = 4.0
#: Besides whole words, their first so many bytes are terms.
PREFIXES = (4, 6)

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "!#$%&*+<=>@\\^_{|}~"]] = True


def _steps(share: np.ndarray) -> np.ndarray:
    """0 for nothing, else a step for each doubling of a share up to 1."""
    return np.where(share <= 0, 0, np.clip(STEPS - 1 + np.floor(np.log2(np.maximum(share, 1e-9))), 1, STEPS - 1)).astype(np.int64)


def features(column: pa.Array):
    """For each span of documents: their distinct feature numbers one document
    after another, and the features before each (n + 1 entries)."""
    raw, offsets = text_buffer(column)
    for a, b in spans_of(offsets, 1 << 20):
        part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = b - a
        starts, ends, first = word_bounds(lowered(part), own, _APART)
        h = word_hashes(lowered(part), starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        kinds = np.bincount(np.unique(doc * DIMENSIONS + (h >> np.uint64(24)).astype(np.int64) % DIMENSIONS) // DIMENSIONS, minlength=n)
        terms, of = [h], [doc]
        for k, size in enumerate(PREFIXES):
            long = ends - starts > size
            terms.append(word_hashes(lowered(part), starts[long], starts[long] + size) ^ np.uint64(k + 1 << 58))
            of.append(doc[long])
        slot = (np.concatenate(terms) >> np.uint64(24)).astype(np.int64) % DIMENSIONS
        key = np.unique(np.concatenate(of) * (DIMENSIONS + SHAPES * STEPS) + slot)
        words = np.maximum(np.diff(first), 1)

        def total(mask, own=own):
            c = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=c[1:])
            return c[own[1:]] - c[own[:-1]]

        size = np.maximum(np.diff(own), 1)
        upper, sign = total((part >= 65) & (part <= 90)), total(_SIGNS[part])
        same = np.zeros(n, np.int64)
        if len(h) > 1:
            np.add.at(same, doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], 1)
        digit, ascii_letters = total((part >= 48) & (part <= 57)), total((part >= 97) & (part <= 122))
        measures = [upper / np.maximum(upper + ascii_letters, 1), sign / size, same / words, 1 - np.minimum(kinds / words, 1), digit / size, 1 / words]
        shape = np.stack([DIMENSIONS + k * STEPS + _steps(m) for k, m in enumerate(measures)], axis=1)
        key = np.concatenate([key, (np.arange(n)[:, None] * (DIMENSIONS + SHAPES * STEPS) + shape).ravel()])
        key.sort()
        yield key % (DIMENSIONS + SHAPES * STEPS), np.searchsorted(key, np.arange(n + 1) * (DIMENSIONS + SHAPES * STEPS))


@dataclass
class OrdinalModel:
    """Shared weights and ascending thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, slots: np.ndarray, before: np.ndarray) -> np.ndarray:
        """P(grade > k) of each document, a column for each threshold."""
        sums = np.zeros(len(slots) + 1)
        np.cumsum(self.weights[slots], out=sums[1:])
        score = sums[before[1:]] - sums[before[:-1]]
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(slots: np.ndarray, before: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 120, rate: float = 0.1, penalty: float = 3e-3) -> OrdinalModel:
    """Penalised maximum likelihood by full-batch Adam.  Slots of fewer than
    MIN_DOCUMENTS documents, or
    whose grades look like those of all documents, keep weight 0.  Thresholds stay ordered as the first
    plus positive steps.  Without rows: every grade is as likely as another."""
    size = DIMENSIONS + SHAPES * STEPS
    even = np.log((np.arange(1, n_grades)) / (n_grades - np.arange(1, n_grades)))
    n = len(grades)
    if n == 0:
        return OrdinalModel(np.zeros(size, np.float32), even)
    # In parts, so that no temporary array is as long as all slots.
    parts = [(a, min(a + 1000, n)) for a in range(0, n, 1000)]
    seen, got = np.zeros(size), np.zeros((n_grades - 1, size))
    for a, b in parts:
        own, width = slots[before[a] : before[b]], np.diff(before[a : b + 1])
        seen += np.bincount(own, minlength=size)
        for k in range(n_grades - 1):
            got[k] += np.bincount(own, weights=np.repeat((grades[a:b] > k).astype(float), width), minlength=size)
    use = np.zeros(size, bool)
    for k in range(n_grades - 1):
        mean = (grades > k).mean()
        use |= np.abs(got[k] - seen * mean) >= SIGNIFICANT * np.sqrt(np.maximum(seen * mean * (1 - mean), 1e-12))
    use &= seen >= MIN_DOCUMENTS
    del seen, got
    names = np.flatnonzero(use)
    number = (np.cumsum(use) - 1).astype(np.int32)
    # Used features of each part: their numbers, and how many each document has.
    pieces = []
    for a, b in parts:
        own = slots[before[a] : before[b]]
        ok = use[own]
        upto = np.concatenate([[0], np.cumsum(ok)])
        pieces.append((a, b, number[own[ok]], np.diff(upto[before[a : b + 1] - before[a]])))
    del use, number
    counts = np.bincount(grades, minlength=n_grades) + 0.5
    tail = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
    t = -np.log(tail / (1 - tail))
    x = np.concatenate([np.zeros(len(names)), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(names)
    upper = np.append(np.arange(n_grades - 1), n_grades - 1)
    for step in range(1, rounds + 1):
        w, gaps = x[:k], np.exp(x[k + 1 :])
        t = x[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.concatenate([np.bincount(np.repeat(np.arange(b - a), width), weights=w[cols], minlength=b - a) for a, b, cols, width in pieces])
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40)))
        over = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        d = over * (1 - over)
        row = np.arange(n)
        like = np.maximum(over[row, grades] - over[row, grades + 1], 1e-12)
        low, high = d[row, grades] / like, d[row, grades + 1] / like  # by the lower and the upper cut
        ds = (low - high) / n
        dt = np.zeros(n_grades + 1)
        np.add.at(dt, grades, -low / n)
        np.add.at(dt, upper[grades] + 1, high / n)
        dt = dt[1:n_grades]
        back = np.cumsum(dt[::-1])[::-1]
        by_slot = np.zeros(k)
        for a, b, cols, width in pieces:
            by_slot += np.bincount(cols, weights=np.repeat(ds[a:b], width), minlength=k)
        g = np.concatenate([by_slot - penalty * w / 10, [back[0]], back[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[names] = x[:k]
    return OrdinalModel(weights, x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))]))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of ``labels`` (doc_id, quality, toxic): 2 good and not
    toxic, 1 one of the two, 0 neither.  Null labels or ids don't count; of
    repeated labels the lowest grade does."""
    grade = (F.col("quality") > 0).cast("int") + (F.col("toxic") <= 0).cast("int")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fitted(docs: DataFrame, grades: DataFrame, n_grades: int = 3, max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """A model of ``grades`` (doc_id, grade) from at most ``max_labelled`` of
    them, the first by a hash of doc_id: the broadcast and what reaches the
    driver are bounded by that parameter.  Rows of a repeated id are all
    labelled alike; if that makes more rows than ``max_labelled``, the first by
    the same hash and their features stay.  Null ids have no label; without
    labelled rows every grade is as likely as another."""
    some = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "grade", "text").mapInArrow(tidy(_listed), "doc_id long, grade int, slots binary"), "labelled")
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(max_labelled).toArrow().sort_by([("doc_id", "ascending"), ("slots", "ascending")])
    slots = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("slots")]
    before = np.cumsum([0, *map(len, slots)])
    flat = np.concatenate(slots) if slots else np.zeros(0, np.int32)
    grade = np.asarray(rows.column("grade"), np.int64)
    del rows, slots
    return fit(flat, before, grade, n_grades)


def _listed(batches):
    for b in batches:
        out = []
        for slots, before in features(b.column(2)):
            out += [slots[i:j].astype("<i4").tobytes() for i, j in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "grade", "slots"])


def scored(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_grade, p_top) of each row of ``docs`` (doc_id, text):
    the mean grade and the probability of the highest.  Null text is empty,
    repeated rows come back as often as they are given, equal texts have equal
    values, an empty table gives none."""

    def run(batches):
        for b in batches:
            tails = [model.tails(s, at) for s, at in features(b.column(1))]
            tails = np.concatenate(tails) if tails else np.zeros((0, len(model.thresholds)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, -1]))], ["doc_id", "expected_grade", "p_top"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, expected_grade double, p_top double")


def selected(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text, any others), all columns, whose probability of
    the highest grade is ``least`` or more; null text is empty, equal texts stay or
    go alike, a very long text is one row like any other."""

    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            tails = [model.tails(s, x)[:, -1] for s, x in features(b.column(at).cast(pa.string()))]
            yield b.filter(pa.array(np.concatenate(tails) >= least)) if tails else b

    return docs.mapInArrow(tidy(run), docs.schema)
