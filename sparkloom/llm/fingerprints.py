"""Document fingerprints: SimHash of weighted two-word terms, 128 bits.

Each distinct term of a text votes on every bit with the square root of its
count; fingerprints within a Hamming radius are found through permuted block
tables: of radius + 2 blocks any pair within the radius agrees on two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, parallelism, quantile_bounds, shingle_hashes, spans_of, text_buffer, tidy, word_bounds, word_hashes

BITS = 128
TERM_WORDS = 2


def simhash(column: pa.Array) -> np.ndarray:
    """16 bytes for each text of an Arrow column.  A text of one word has that
    word as its term; one without words, or null, has all bits 0."""
    raw, offsets = text_buffer(column)
    out = [np.zeros((0, BITS // 8), np.uint8)]
    for a, b in spans_of(offsets, 1 << 18):
        part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, own)
        terms, before = shingle_hashes(word_hashes(part, starts, ends), first, TERM_WORDS)
        n = b - a
        bits = np.zeros((n, BITS), np.float32)
        if len(terms):
            doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(before))
            key, count = np.unique((doc << np.uint64(44)) | (terms >> np.uint64(20)), return_counts=True)
            doc, term = (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)
            weight = np.sqrt(count).astype(np.float32)
            heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            for half in range(2):
                h = mixed(term ^ np.uint64(0x5851F42D4C957F2D * half & (1 << 63) - 1))
                votes = np.unpackbits(h.view(np.uint8)).reshape(-1, 64).astype(np.float32)
                votes -= 0.5
                votes *= weight[:, None]
                bits[doc[heads], 64 * half : 64 * half + 64] = np.add.reduceat(votes, heads, axis=0)
        out.append(np.packbits(bits > 0, axis=1))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of rows of two fingerprint arrays."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs`` (doc_id, text): 32 hex
    digits."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes().hex() for x in simhash(b.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fingerprint string")


# ------------------------------------------------------------------ edited texts


def _chain(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) dealt out by ranges of doc_id in descending order,
    each range followed by a row (tail) of the next range's first document.  The
    split points are ids of the table, so the largest id of every range is known
    without another pass."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    top = docs.agg(F.max("doc_id")).first()[0]
    bounds = [b for b in quantile_bounds(docs, "doc_id", parallelism(spark)) if b < top] if top is not None else []
    ends = np.asarray([*bounds, top if top is not None else 0], np.int64)
    n = len(ends)

    @F.pandas_udf("array<int>")
    def places(ids):
        import pandas as pd

        null = ids.isna().to_numpy()
        own = ids.fillna(0).to_numpy(np.int64)
        at = np.where(null, 0, np.searchsorted(ends[:-1], own, side="left"))
        last = (ends[at] == own) & ~null
        return pd.Series([[a, (a + 1) % n] if x else [a] for a, x in zip(at.tolist(), last.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("tail", "place"))
    return dealt.repartitionById(n, F.col("place")).sortWithinPartitions("place", "tail", F.col("doc_id").desc_nulls_last(), "text"), n


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of each row of ``docs`` (doc_id, text).

    The edited text keeps all but the last floor(n_chars / 2) code points and
    goes on with as many, or all, of the first of the next document by descending
    doc_id; null ids come last, equal ids by text, and after the last comes the
    first.  Null text: empty.  near_*: share of equal bits.
    """

    def rows(batches) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

    def run(batches):
        place, first, waiting, size = None, None, [], 0

        def flush(following):
            texts = [t for _, t in waiting]
            nexts = [*texts[1:], following]
            edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts, strict=True)]
            own = simhash(pa.array([*texts, following], pa.large_string()))
            other = simhash(pa.array(edited, pa.large_string()))
            near_edited, near_next = likeness(own[:-1], other), likeness(own[:-1], own[1:])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in waiting], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([x.tobytes().hex() for x in own[:-1]], pa.string()), pa.array([x.tobytes().hex() for x in other], pa.string()), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for doc_id, text, tail, at in rows(batches):
            if waiting and (at != place or tail or size > 1 << 20):
                # A range without a tail is the only one: its last row goes on with its first.
                yield flush(text if at == place else first)
                waiting, size = [], 0
            if at != place:
                place, first = at, text
            if not tail:
                waiting.append((doc_id, text))
                size += len(text)
        if waiting:
            yield flush(first)

    chained, _ = _chain(docs)
    return chained.mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


# ----------------------------------------------------------------- radius search


def _tables(classes: DataFrame, radius: int) -> DataFrame:
    """A row for each block table: a key of the two blocks that lead in it."""
    blocks = radius + 2
    cut = [round(32 * i / blocks) for i in range(blocks + 1)]
    part = [F.substring("fingerprint", cut[i] + 1, cut[i + 1] - cut[i]) for i in range(blocks)]
    keys = F.array(*[F.xxhash64(F.lit(k), part[i], part[j]) for k, (i, j) in enumerate(combinations(range(blocks), 2))])
    return classes.withColumn("key", F.explode(keys))


def distance(a: str, b: str):
    """Hamming distance of two columns of 32 hex digits."""
    words = [F.bit_count(F.conv(F.substring(a, k, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, k, 8), 16, 10).cast("long"))) for k in (1, 9, 17, 25)]
    return sum(words[1:], words[0])


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(fingerprint, near, distance): all pairs of a distinct fingerprint of
    ``queries`` and one of ``prints`` (column fingerprint) at most ``radius``
    bits apart, itself included.  Copies stay one row; join their ids on
    fingerprint."""
    if not 0 <= radius <= 14:
        raise ValueError("a radius of 0 to 14 bits")
    ask = _tables(queries.select("fingerprint").dropna().distinct(), radius)
    have = _tables(prints.select("fingerprint").dropna().distinct(), radius).withColumnRenamed("fingerprint", "near")
    pairs = ask.join(have, "key").withColumn("distance", distance("fingerprint", "near")).where(F.col("distance") <= radius)
    return pairs.select("fingerprint", "near", "distance").distinct()
