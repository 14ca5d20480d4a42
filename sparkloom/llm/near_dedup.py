"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form one class (a 128-bit set hash).  Classes
that share a band of their MinHash signature are candidates.  A star round
compares each class with one leader of its buckets only, so a large group of
near copies costs one comparison for each class; the last round compares all
pairs that this left in different components, in blocks within a task, and
passes on forests of what survives, never the pairs.  Both compare signatures
batch by batch, dropping a pair once the posterior probability that it is a link
falls below the miss probability, and confirm survivors on the full shingle sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEYS, components_of, dropped, id_bitmap, joined, mixed, row_keys, shingle_hashes, spans_of, text_buffer, tidy, with_possible, without_rows, word_bounds, word_hashes, written

#: 32 bands of 4 rows: a pair of similarity 0.8 shares no band with probability 4.6e-8.
BANDS, ROWS = 32, 4
MISS = 1e-6
BATCH = 16
BLOCK = 512


def _odd(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower-cases the bytes A-Z."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def shingle_sets(column: pa.Array, width: int, lower: bool = True):
    """For each span of documents: the sorted distinct shingle hashes of all its
    documents one after another, and their number for each document."""
    raw, offsets = text_buffer(column)
    for a, b in spans_of(offsets, 1 << 19):
        part = raw[offsets[a] : offsets[b]]
        own = offsets[a : b + 1] - offsets[a]
        if lower:
            part = lowered(part)
        starts, ends, first = word_bounds(part, own)
        hashes, before = shingle_hashes(word_hashes(part, starts, ends), first, width)
        sets = [np.unique(hashes[i:j]) if j > i else hashes[:0] for i, j in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        yield sets


def set_hash(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of the mixed members of each non-empty set."""
    return np.add.reduceat(mixed(flat), at), np.add.reduceat(mixed(flat ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)


def signed(docs: DataFrame, width: int, lower: bool, bands: int, rows: int) -> DataFrame:
    """(z, id, x1, x2, n_shingles, h1, h2, keys, sig) of each row: its
    ``row_keys``, the size and hash of its set, the keys of its bands and its
    signature; both are empty where the set is."""
    n_hashes = bands * rows
    times, plus = _odd(11, n_hashes), _odd(23, n_hashes)
    salt = _odd(37, bands)

    def run(batches):
        for b in batches:
            done = 0
            for sets in shingle_sets(b.column(4), width, lower):
                n = np.asarray([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                sig, key = np.empty((n_hashes, len(full)), np.uint32), np.zeros((len(full), bands), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.cumsum(n[full]) - n[full]
                    x, y = set_hash(flat, at)
                    h1[full], h2[full] = x.view(np.int64), y.view(np.int64)
                    work = np.empty_like(flat)
                    for k in range(n_hashes):
                        np.multiply(flat, times[k], out=work)
                        np.add(work, plus[k], out=work)
                        sig[k] = np.minimum.reduceat(work, at) >> np.uint64(32)
                    key += salt
                    for r in range(rows):
                        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + sig[r::rows].T.astype(np.uint64)[:, :bands])
                upto = np.concatenate([[0], np.cumsum(n > 0)])
                keys = pa.ListArray.from_arrays(pa.array((upto * bands).astype(np.int32)), pa.array(key.ravel().view(np.int64)))
                sigs = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer((upto * 2 * n_hashes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sig.T.astype("<u2")))])
                own = [b.column(k).slice(done, len(sets)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(h1), pa.array(h2), keys, sigs], [*ROW_KEYS, "n_shingles", "h1", "h2", "keys", "sig"])
                done += len(sets)

    rows_of = [k.alias(name) for k, name in zip(row_keys(docs), ROW_KEYS, strict=True)]
    return docs.select(*rows_of, F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "z boolean, id long, x1 long, x2 long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary")


def least_matches(n_hashes: int, percent: int, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) after each batch: with a
    uniform prior, P(similarity >= t | m of k match) is P(Binomial(k+1, t) <= m)."""
    t, out = percent / 100, []
    for k in range(batch, n_hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append((k, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch rules out."""
    alive, matches, last = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for upto, least in rule:
        matches = matches + (left[alive, last:upto] == right[alive, last:upto]).sum(axis=1, dtype=np.int32)
        go = matches >= least
        alive, matches, last = alive[go], matches[go], upto
        if not len(alive):
            break
    return alive


def _rows_of(column: pa.Array, n_hashes: int) -> np.ndarray:
    raw, _ = text_buffer(column)
    return raw.view("<u2").reshape(-1, n_hashes)


def _likely(edges: DataFrame, sigs: DataFrame, rule, n_hashes: int) -> DataFrame:
    """The edges (a, b) that survive."""

    def run(batches):
        for x in batches:
            if x.num_rows:
                left, right = _rows_of(x.column(2), n_hashes), _rows_of(x.column(3), n_hashes)
                go = surviving(left, right, rule)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(go)), x.column(1).take(pa.array(go))], ["a", "b"])

    right = edges.join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
    both = right.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, reps: DataFrame, width: int, lower: bool) -> DataFrame:
    """(cid, members): the sorted shingle hashes of the classes in ``nodes``
    (cid).  Only texts that the bitmap of their ids lets through are hashed."""
    involved = written(nodes.join(reps.select("cid", "h1", "h2", *ROW_KEYS), "cid"), "involved")
    bitmap = id_bitmap(involved, *ROW_KEYS)

    def run(batches):
        for b in batches:
            for sets in shingle_sets(b.column(0), width, lower):
                sets = [s for s in sets if len(s)]
                if sets:
                    n = np.asarray([len(s) for s in sets])
                    h1, h2 = set_hash(np.concatenate(sets), np.cumsum(n) - n)
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["h1", "h2", "members"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = with_possible(texts, row_keys(texts), bitmap, "_maybe").where("_maybe").select("text")
    sets = texts.mapInArrow(tidy(run), "h1 long, h2 long, members binary").dropDuplicates(["h1", "h2"])
    out = written(sets.join(involved.select("cid", "h1", "h2"), ["h1", "h2"]).select("cid", "members"), "sets", "none")
    dropped(docs.sparkSession, involved)
    return out


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(p) > len(q):
        p, q = q, p
    if 100 * len(p) < percent * len(q):
        return False
    at = np.searchsorted(q, p)
    common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def _confirmed(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, percent: int, lower: bool) -> DataFrame:
    """Edges (u, v) of ``pairs`` (a, b) whose full shingle sets reach the
    similarity."""
    nodes = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = _sets(docs, nodes, reps, width, lower)

    def compare(batches):
        for x in batches:
            keep = [i for i, (p, q) in enumerate(zip(x.column(2), x.column(3), strict=True)) if linked(np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8"), percent)]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([x.column(0).take(take), x.column(1).take(take)], ["u", "v"])

    joined = pairs.select("a", "b").join(sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b").join(sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a")
    out = written(joined.select("a", "b", "ma", "mb").mapInArrow(tidy(compare), "u long, v long"), "links")
    dropped(docs.sparkSession, sets)
    return out


class _Forest:
    """Union-find over the few thousand nodes that one task compares."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y] if y in self.up else y
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _stars(rows: DataFrame) -> DataFrame:
    """One pair (a, b) for each class b that shares a bucket: the leader that it
    shares most buckets with.  A bucket's leader is the class that shares buckets
    with most others, so the original of a group of edited copies leads although
    the copies may not be alike enough.  ``rows`` has (key, cid, n): n classes in
    the bucket; a class has no more rows than bands."""
    mine = rows.groupBy("cid").agg(F.sum("n").alias("degree"), F.collect_list("key").alias("keys")).select("cid", "degree", F.explode("keys").alias("key"))
    mine = written(mine, "mine")
    lead = mine.groupBy("key").agg(F.max(F.struct("degree", F.negative("cid").alias("c"))).alias("top"))
    lead = written(lead.select("key", F.negative("top.c").alias("a"), F.col("top.degree").alias("weight")), "lead")
    leads = mine.join(lead, "key").where("cid <> a").groupBy("cid").agg(F.collect_list(F.struct("weight", F.negative("a").alias("c"))).alias("leads"))
    most = F.array_max(F.transform("leads", lambda x: F.struct(F.size(F.filter("leads", lambda y: y["c"] == x["c"])), x["weight"], x["c"].alias("c"))))
    return leads.select(F.negative(most["c"]).alias("a"), F.col("cid").alias("b"))


def _dealt(rows: DataFrame, by: str, block: int) -> DataFrame:
    """``rows`` (``by``, cid, rows: how many have the same ``by``) with group, s, i,
    j: a group of more than ``block`` rows is dealt out as pairs of blocks (i, j),
    so that no task holds it whole; s is a row's own block."""
    mine = rows.withColumn("nb", F.expr(f"cast(ceil(rows / {block}) as int)")).withColumn("s", F.expr("cast(pmod(xxhash64(cid), nb) as int)"))
    mine = mine.withColumn("t", F.explode(F.expr("sequence(0, nb - 1)")))
    mine = mine.withColumn("i", F.least("s", "t")).withColumn("j", F.greatest("s", "t")).drop("t", "nb", "rows")
    return mine.withColumn("group", F.xxhash64(by, "i", "j"))


def _whole_groups(batches):
    """Tables that hold all rows of their groups; rows come sorted by the first
    column."""
    held = None
    for x in batches:
        x = pa.Table.from_batches([x])
        if held is not None:
            x = pa.concat_tables([held, x])
        if not x.num_rows:
            continue
        g = np.asarray(x.column(0).combine_chunks())
        cut = int(np.flatnonzero(g[1:] != g[:-1])[-1] + 1) if (g[1:] != g[:-1]).any() else 0
        held = x.slice(cut)
        if cut:
            yield x.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _likely_groups(rows: DataFrame, sigs: DataFrame, rule, n_hashes: int) -> DataFrame:
    """(node, component): groups of classes that are connected by surviving pairs
    of one bucket and different components.  A task returns a forest of its
    pairs, which grows with the classes and not with the pairs; ``rows`` has
    (key, cid, comp)."""
    ends = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("key", "rows")
    mine = _dealt(rows.join(written(ends, "ends"), "key"), "key", BLOCK).join(sigs.select("cid", "sig"), "cid")

    def run(batches):
        for x in _whole_groups(batches):
            g, cid, comp, s, i, j = (np.asarray(x.column(k).combine_chunks()) for k in range(6))
            sig = _rows_of(x.column(6).combine_chunks(), n_hashes)
            forest, found = _Forest(), []
            for d in range(1, len(g)):
                left = np.flatnonzero(g[d:] == g[:-d])
                if not len(left):
                    break
                right = left + d
                go = (comp[left] != comp[right]) & (cid[left] != cid[right]) & ((i[left] == j[left]) | (s[left] != s[right]))
                left, right = left[go], right[go]
                go = surviving(sig[left], sig[right], rule)
                found += [(a, b) for a, b in zip(cid[left[go]].tolist(), cid[right[go]].tolist(), strict=True) if forest.join(a, b)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

    mine = mine.select("group", "cid", "comp", "s", "i", "j", "sig")
    return components_of(mine.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(joined(run)), "u long, v long"), is_joined=True)


def _group_links(docs: DataFrame, groups: DataFrame, stars: DataFrame, reps: DataFrame, rule, n_hashes: int, width: int, percent: int, lower: bool) -> DataFrame:
    """Links (u, v) between different components within the likely groups: all
    pairs of a group are compared by signature in blocks and confirmed on the
    full sets in the same task, which returns a forest of its links."""
    sets = _sets(docs, groups.select("cid"), reps, width, lower)
    sizes = written(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    comp = stars.select(F.col("node").alias("cid"), F.col("component").alias("comp"))
    mine = _dealt(groups.join(sizes, "grp").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "grp", BLOCK // 2)
    mine = mine.join(reps.select("cid", "sig"), "cid").join(sets, "cid").select("group", "cid", "comp", "s", "i", "j", "sig", "members")

    def run(batches):
        for x in _whole_groups(batches):
            g, cid, comp, s, i, j = (np.asarray(x.column(k).combine_chunks()) for k in range(6))
            sig = _rows_of(x.column(6).combine_chunks(), n_hashes)
            members = x.column(7).combine_chunks()
            heads = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]).tolist()
            forest, found = _Forest(), []
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                own = [np.frombuffer(members[k].as_buffer(), "<u8") for k in range(a, b)]
                for p in range(a, b - 1):
                    q = np.arange(p + 1, b)
                    q = q[(comp[q] != comp[p]) & (cid[q] != cid[p]) & ((i[q] == j[q]) | (s[q] != s[p]))]
                    if not len(q):
                        continue
                    q = q[surviving(np.broadcast_to(sig[p], (len(q), n_hashes)), sig[q], rule)]
                    for r in q.tolist():
                        if forest.root(int(comp[p])) != forest.root(int(comp[r])) and linked(own[p - a], own[r - a], percent):
                            forest.join(int(comp[p]), int(comp[r]))
                            found.append((int(cid[p]), int(cid[r])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

    return written(mine.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(run), "u long, v long"), "links")


def _members(docs: DataFrame, width: int, percent: int, lower: bool, bands: int, rows: int, miss: float) -> DataFrame:
    """(z, id, x1, x2, n_shingles, first) of each row of ``docs``: its ``row_keys``,
    the size of its set and the smallest row keys (null ids last) that links
    reach; null where the set is empty."""
    spark = docs.sparkSession
    n_hashes = bands * rows
    rule = least_matches(n_hashes, percent, miss)
    sig = written(signed(docs, width, lower, bands, rows), "signed", "none")
    reps = sig.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct(*ROW_KEYS, "keys", "sig")).alias("r")).select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "r.*")
    reps = written(reps, "reps", "none")

    index = reps.select("cid", F.explode("keys").alias("key"))
    many = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "many")
    shared = written(index.join(many, "key").select("key", "cid", "n"), "shared")
    links = _confirmed(docs, written(_likely(_stars(shared), reps, rule, n_hashes), "likely"), reps, width, percent, lower)
    stars = written(components_of(links), "components")
    comps = written(shared.join(stars, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("component", "cid").alias("comp")), "comps")
    groups = written(_likely_groups(comps, reps, rule, n_hashes).select(F.col("node").alias("cid"), F.col("component").alias("grp")), "groups")
    final = stars
    if not groups.isEmpty():
        more = _group_links(docs, groups, stars, reps, rule, n_hashes, width, percent, lower)
        final = written(components_of(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "components")

    named = reps.select("cid", "h1", "h2", F.struct(*ROW_KEYS).alias("r")).join(final, F.col("cid") == F.col("node"), "left").select("h1", "h2", "r", F.coalesce("component", "cid").alias("comp"))
    lowest = written(named.groupBy("comp").agg(F.min("r").alias("first")), "lowest")
    by_class = written(named.join(lowest, "comp").select("h1", "h2", "first"), "by_class")
    for x in (many, shared, reps, comps):
        dropped(spark, x)
    full = sig.where("n_shingles > 0").select(*ROW_KEYS, "n_shingles", "h1", "h2").join(by_class, ["h1", "h2"]).select(*ROW_KEYS, "n_shingles", "first")
    return full.unionByName(sig.where("n_shingles = 0").select(*ROW_KEYS, "n_shingles"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id,
    text; other columns are not looked at).

    Links: 100 * |intersection| >= percent * |union| of the distinct
    ``width``-word shingles of the text, A-Z lower-cased if ``lower``; a shorter
    text has its whole word sequence as one shingle.  Null and empty texts have
    no shingle and no link: their component is their own doc_id.  component_id
    is the smallest doc_id that links reach.  Repeated rows come back as often as
    they are given, kept or not alike.  A null doc_id is never smaller than
    another; a component of such rows alone has a null id.  Ties don't arise: the
    links are exact; a very long text is one row like any other; an empty table
    gives none.
    """
    own = F.when(~F.col("z"), F.col("id"))
    first = F.when(F.col("first").isNull(), own).when(~F.col("first.z"), F.col("first.id"))
    return _members(docs, width, percent, lower, bands, rows, miss).select(own.alias("doc_id"), "n_shingles", first.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """``docs`` (doc_id, text, any others), all columns, with one row of each
    near-duplicate group: that of the smallest doc_id (null ids last), of rows
    with that id the one of the smallest text hash, of rows equal in both any one.
    Rows without words have no group and all stay."""
    rows_of = written(_members(docs, width, percent, lower, bands, rows, miss).where("first is not null"), "members")
    first = F.struct(*ROW_KEYS) == F.col("first")
    repeated = rows_of.where(first).groupBy(*ROW_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ROW_KEYS)
    gone = rows_of.where(~first).select(*ROW_KEYS).distinct()
    return without_rows(docs, written(gone, "gone"), written(repeated, "repeated"))
