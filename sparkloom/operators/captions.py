"""Scores of captions against several references each, over a whole set.

CIDEr weighs n-grams by the captions whose references hold them, so it takes two
passes: document frequencies over the set, then weighted cosines.  Captions lie in
blocks.  A block sends each of its n-grams once, as a hash, with its number of
captions that hold it; ranges of hashes are summed and sent back in the order in
which they came.  Nothing but the number of captions is one value.  ROUGE-L needs
one caption at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The longest n-grams, width of the length penalty, scale of CIDEr,
#: weight of recall in ROUGE-L.
GRAMS, SIGMA, SCALE, BETA = 4, 6.0, 10.0, 1.2

#: A block has so many captions at least, where there are as many: an n-gram that one
#: of so many holds is frequent, and a block sends it once.
FREQUENT = 100
#: Captions of a block at most; some 100 KB of memory each while it is counted.
BLOCK = 8192


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes, then all second ones, and so on: the high
    bytes of small numbers are zeros in a row, which a shuffle's compression takes away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    """The numbers that ``packed`` had."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all words of ``texts`` in order: words between blanks, null has
    none; 64 bits of hash."""
    lists = pc.split_pattern_regex(texts.fill_null(""), pattern=r"[ \t\n\x0b\f\r]+")
    at, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    there = pc.not_equal(words, "")
    coded = words.filter(there).dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return at.filter(there).to_numpy(zero_copy_only=False).astype(np.int64), hashes[coded.indices.to_numpy(zero_copy_only=False)]


def hashed_grams(at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n, hash) of all n-grams of 1 to GRAMS words of the texts ``at``."""
    out, g = [], np.zeros(len(words), np.uint64)
    for n in range(1, GRAMS + 1):
        m = max(0, len(words) - n + 1)
        g = g[:m] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 : n - 1 + m]
        g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        g = g ^ (g >> np.uint64(31))
        within = at[:m] == at[n - 1 : n - 1 + m]
        out.append((at[:m][within], np.full(within.sum(), n, np.int8), g[within]))
    return tuple(np.concatenate(x) for x in zip(*out))


class Counted:
    """N-grams of a block of captions: ``grams``, their sorted hashes, ``n``, their
    numbers of words, and (text, place in grams, count) of each text's.  Candidates are
    the first texts, then come all references; ``owner`` is a text's caption."""

    def __init__(self, captions: pa.Table):
        refs = captions["_refs"].combine_chunks()
        said = captions["_said"].combine_chunks()
        self.captions = len(said)
        self.owner = np.concatenate([np.arange(len(said)), pc.list_parent_indices(refs).to_numpy(zero_copy_only=False)]).astype(np.int64)
        at, n, grams = hashed_grams(*hashed_words(pa.concat_arrays([said, pc.list_flatten(refs)])))
        self.grams, place = np.unique(grams, return_inverse=True)
        self.n = np.zeros(len(self.grams), np.int8)
        self.n[place] = n
        self.size = max(1, len(self.grams))
        self.pairs, self.count = np.unique(at * self.size + place, return_counts=True)
        self.text, self.place = np.divmod(self.pairs, self.size)

    def held(self) -> np.ndarray:
        """The number of captions whose references hold each n-gram."""
        ref = self.text >= self.captions
        both = np.unique(self.owner[self.text[ref]] * self.size + self.place[ref])
        return np.bincount(both % self.size, minlength=len(self.grams))

    def buckets(self, number: int) -> np.ndarray:
        """Where each of ``number`` ranges of hashes begins and the last one ends."""
        bucket = ((self.grams >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
        return np.searchsorted(bucket, np.arange(number + 1, dtype=np.uint64))

    def scores(self, held: np.ndarray, total: int) -> np.ndarray:
        """CIDEr of each caption; ``held`` over the set, of ``total`` captions."""
        square = (np.log(total) - np.log(np.maximum(held, 1))) ** 2
        mean = lambda x, cells: np.bincount(cells, x, GRAMS * len(self.owner)).reshape(-1, GRAMS)
        cell, c = self.text * GRAMS + self.n[self.place] - 1, self.count.astype(np.float64)
        norm, number = mean(c * c * square[self.place], cell), mean(c, cell)
        ref = self.text >= self.captions
        # Candidates' pairs are the first ones.
        mine, own = self.pairs[~ref], self.owner[self.text[ref]] * self.size + self.place[ref]
        found = np.minimum(np.searchsorted(mine, own), max(0, len(mine) - 1))
        same = mine[found] == own if len(mine) else np.zeros(len(own), bool)
        mine, c, place = c[~ref][found[same]], c[ref][same], self.place[ref][same]
        dot = mean(np.minimum(mine, c) * c * square[place], cell[ref][same])
        of = self.owner[self.captions :]
        size = np.sqrt(norm[of]) * np.sqrt(norm[self.captions :])
        cosines = np.divide(dot[self.captions :], size, out=np.zeros_like(size), where=size > 0).sum(axis=1)
        delta = number[of, 1] - number[self.captions :, 1]
        score = np.bincount(of, cosines / GRAMS * np.exp(-(delta**2) / (2 * SIGMA**2)), self.captions)
        return SCALE * score / np.maximum(1, np.bincount(of, minlength=self.captions))


def _sent(captions: pa.Table) -> pa.Table:
    """(_block, _bucket, _grams, _held) of a block: differences of sorted hashes, and
    the number of the block's captions that hold each."""
    counted = Counted(captions)
    held, cuts = counted.held(), counted.buckets(captions["_blocks"][0].as_py())
    full = [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
    grams = [packed(np.diff(counted.grams[x:y], prepend=np.uint64(0))) for _, x, y in full]
    block = pa.array([captions["_block"][0].as_py()] * len(full), pa.int64())
    return pa.table({"_block": block, "_bucket": pa.array([b for b, _, _ in full], pa.int64()), "_grams": pa.array(grams, pa.binary()), "_held": pa.array([packed(held[x:y]) for _, x, y in full], pa.binary())})


def _summed(sent: pa.Table) -> pa.Table:
    """(_block, _bucket, _held) of a range of hashes: as ``_sent``, over all blocks."""
    grams = [np.cumsum(unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in sent["_grams"]]
    _, place = np.unique(np.concatenate(grams), return_inverse=True)
    held = np.bincount(place, np.concatenate([unpacked(x.as_py(), np.int64) for x in sent["_held"]])).astype(np.int64)[place]
    parts = np.split(held, np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"_block": sent["_block"], "_bucket": sent["_bucket"], "_held": pa.array([packed(x) for x in parts], pa.binary())})


def in_blocks(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the number of its keys, the number of blocks and the key's block, as
    ``cider`` deals it: rows of captions still to be put together may be repartitioned
    by ``_block``, so that they need no second shuffle."""
    # As many blocks as cores keep busy, of BLOCK captions at most.
    share = f"greatest({max(1, FREQUENT)}, least({BLOCK}, _total div {2 * df.sparkSession.sparkContext.defaultParallelism}))"
    total = df.agg(F.count_distinct(F.struct(key)).alias("_total")).withColumn("_blocks", F.expr(f"cast(ceil(_total / {share}) as bigint)"))
    return df.crossJoin(F.broadcast(total)).withColumn("_block", F.pmod(F.xxhash64(key), "_blocks"))


def _scores(df: DataFrame, key: str, candidate: str, references: str, keep: list[str], rouge: bool = False) -> DataFrame:
    """(key, keep, cider) and (if ``rouge``) rouge of each row."""
    df = df if "_block" in df.columns else in_blocks(df, key)
    refs = F.coalesce(F.col(references).cast("array<string>"), F.array().cast("array<string>"))
    texts = df.select("_block", "_blocks", "_total", F.col(key).alias("_key"), refs.alias("_refs"), F.col(candidate).cast("string").alias("_said"), *keep)
    sent = texts.groupBy("_block").applyInArrow(_sent, "_block long, _bucket long, _grams binary, _held binary")
    summed = sent.groupBy("_bucket").applyInArrow(_summed, "_block long, _bucket long, _held binary")

    def scored(captions: pa.Table, held: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py(), np.int64) for x in held.sort_by("_bucket")["_held"]]
        score = Counted(captions).scores(np.concatenate([np.zeros(0, np.int64), *parts]), captions["_total"][0].as_py())
        out = captions.select(["_key", *keep]).append_column("cider", pa.array(score, pa.float64()))
        if rouge:
            out = out.append_column("rouge", pa.array([rouge_score(a.as_py(), b.as_py()) for a, b in zip(captions["_said"], captions["_refs"])], pa.float64()))
        return out

    schema = T.StructType([T.StructField(c, texts.schema[c].dataType) for c in ("_key", *keep)] + [T.StructField(c, T.DoubleType()) for c in (["cider", "rouge"] if rouge else ["cider"])])
    return texts.groupBy("_block").cogroup(summed.groupBy("_block")).applyInArrow(scored, schema).withColumnRenamed("_key", key)


def cider(df: DataFrame, key: str, candidate: str, references: str) -> DataFrame:
    """(key, cider) of each row of ``df``: ``candidate`` a text, ``references`` an array
    of texts; ``key`` is another one in every row and not null.

    The mean over n of 1 to 4 and over the references of the cosine of n-gram counts
    times log(captions) - log(captions whose references hold the n-gram), candidate
    counts clipped to the reference's in the product, times a Gaussian of the
    difference in the number of two-grams, times ten.  A caption without references,
    or without n-grams, has 0, as has every one of a set of one.  Null texts are
    empty; words are parted by blanks.  N-grams are known by 64 bits of hash.

    An n-gram of a block, common or not, is some six bytes of shuffle on its way to
    its frequency and about one on the way back.
    """
    return _scores(df, key, candidate, references, [])


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole  # a bit is 0 where a prefix's length grows
    for w in b:
        hit = free & places.get(w, 0)
        free = ((free + hit) | (free - hit)) & whole
    return len(a) - free.bit_count()


def rouge_score(said: str | None, references) -> float:
    """ROUGE-L of a text: best precision and best recall over the references, recall
    weighing BETA; words between single blanks.  0 without references."""
    a = (said or "").split(" ")
    shared = [(common_words(a, b), len(b)) for b in ((r or "").split(" ") for r in (references if references is not None else []))]
    p, r = max((n / len(a) for n, _ in shared), default=0.0), max((n / m for n, m in shared), default=0.0)
    return (1 + BETA**2) * p * r / (r + BETA**2 * p) if p and r else 0.0


@F.pandas_udf(T.DoubleType())
def caption_rouge(candidate, references):
    """``rouge_score`` of two columns."""
    return candidate.combine(references, rouge_score).astype(float)


def caption_scores(df: DataFrame, key: str, candidate: str, references: str, by: list[str] | None = None) -> DataFrame:
    """(by, captions, rouge_l, cider) of a caption set, in hundredths: means over the
    captions of each group, n-gram frequencies over the whole set."""
    by = by or []
    both = _scores(df, key, candidate, references, by, rouge=True)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("captions"), (100 * F.avg("rouge")).alias("rouge_l"), (100 * F.avg("cider")).alias("cider"))
