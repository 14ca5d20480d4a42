"""Mixing sources to target weights: capped water-filling, then seeded sampling.

Every source's target is min(cap, level * weight), with one level for all: what
clamping sources at their cap and sharing the excess by weight, again and again
until none is above, comes to.  A source of target t and size s gives each of
its documents floor(t / s) whole times; the rest of t goes to the documents that
come first by a seeded hash, each counted when at least half of it fits, so the
taken size is within half a document of the target.

DataFrame functions only.  A source is split into hash buckets: sums are taken
for each (source, bucket) first and the running sum only orders documents within
a bucket, so a hot source never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_name, word_count, written

#: Hex digits of the hash that name a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3


def seeded(seed: str, key: Column) -> Column:
    """A hash whose order is a seeded shuffle: md5 of seed, colon and key."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def water_filling(sources: DataFrame, total: Column) -> DataFrame:
    """``sources`` (weight, cap; any others) with ``target``; ``total`` is what
    they share.  If the caps don't reach it, every source gets its cap.  Runs
    over one row for each source."""
    ratio = F.col("cap") / F.col("weight")
    upto = W.orderBy(F.col("_ratio").asc(), F.col("_name").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = sources.withColumn("_ratio", ratio).withColumn("_name", F.col("source")).withColumn("_total", total)
    out = out.withColumn("_caps", F.sum("cap").over(upto)).withColumn("_weights", F.sum("weight").over(every) - F.sum("weight").over(upto))
    # The level if just the sources up to this one are clamped, and whether it clamps them.
    before = F.col("_caps") - F.col("cap")
    left = F.col("_weights") + F.col("weight")
    out = out.withColumn("_clamped", (F.col("_total") - before) / left >= F.col("_ratio"))
    fixed = F.coalesce(F.sum(F.when(F.col("_clamped"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_clamped"), F.col("weight"))).over(every)
    out = out.withColumn("target", F.when(F.col("_clamped"), F.col("cap")).otherwise(F.col("weight") * ((F.col("_total") - fixed) / open_weight)))
    return out.drop("_ratio", "_name", "_total", "_caps", "_weights", "_clamped")


def mixture(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) for each row of
    ``docs`` (doc_id, source, text).

    Sources, by code point and null last, weigh ``weights`` in turn.  They share
    ``share`` times the size of everything; none gets more than ``epochs`` times
    its own.  ``size`` is the number of words unless given; null text has size
    0.  ``times`` is how often the mix repeats the row, ``taken`` that times its
    size.  Rows of size 0 and sources of size 0 are taken floor(target / size) or
    0 times.  Repeated rows and ids are rows of their own; ties by hash go by
    size, then text.  An empty table gives none.
    """
    size = word_count(F.col("text").cast("string")) if size is None else size
    narrow = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), seeded(seed, F.col("doc_id")).alias("h"), F.xxhash64("text").alias("tie"))
    narrow = written(narrow.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)).withColumn("key", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))), "sizes")
    buckets = written(narrow.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size")), "buckets")

    sources = buckets.groupBy("key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    rank = F.row_number().over(W.orderBy("key")) - 1
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(share))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))).withColumn("all", total)
    sources = water_filling(sources.withColumn("cap", F.col("source_size") * float(epochs)), F.col("all"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select("key", "source_size", "target", "whole", "rest")

    # One row for each (source, bucket): what its earlier buckets hold.
    ahead = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    plan = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("source", "bucket_size").join(sources, "key")
    run = W.partitionBy("key", "bucket").orderBy("h", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = narrow.withColumn("upto", F.sum("size").over(run)).join(plan, ["key", "bucket"])
    more = 2 * (F.col("ahead") + F.col("upto")) - F.col("size") <= 2 * F.col("rest")
    times = F.col("whole") + F.when(more & (F.col("rest") > 0), 1).otherwise(0)
    return out.withColumn("times", times.cast("long")).select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "tie")


def mixed_documents(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, source, text, any others), all
    columns, each as often as the mixture takes it.  Rows that are equal in id,
    source and text share the sum of their counts as evenly as whole numbers allow,
    so the words that come out are those that the mixture takes; null ids and
    sources are values like others; an empty table gives none, and a very long
    text is one row like any other."""
    key, source, tie, times, rows, copy, salt, number, before = (fresh_name(docs, x) for x in ("_id", "_source", "_tie", "_times", "_rows", "_copy", "_salt", "_number", "_before"))
    plan = mixture(docs, weights, **options).groupBy("doc_id", "source", "tie").agg(F.sum("times").alias(times), F.count(F.lit(1)).alias(rows)).where(F.col(times) > 0)
    plan = written(plan.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("tie").alias(tie), times, rows), "plan")
    joined = docs.join(plan, docs["doc_id"].eqNullSafe(plan[key]) & docs["source"].cast("string").eqNullSafe(plan[source]) & (F.xxhash64(docs["text"]) == plan[tie]))
    once = joined.where(F.col(rows) == 1).select(*[docs[c] for c in docs.columns], F.col(times).alias(times))
    if not plan.where(F.col(rows) > 1).isEmpty():
        # Equal rows are numbered within random parts of their group, then over these.
        many = written(joined.where(F.col(rows) > 1).withColumn(salt, F.floor(F.rand(7) * 64)), "repeated")
        same = [key, source, tie]
        other = {c: fresh_name(docs, "_of" + c) for c in [*same, salt]}
        counts = many.groupBy(*same, salt).agg(F.count(F.lit(1)).alias("_n"))
        ahead = counts.select(*[F.col(c).alias(n) for c, n in other.items()], F.coalesce(F.sum("_n").over(W.partitionBy(*same).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
        many = many.withColumn(number, F.row_number().over(W.partitionBy(*same, salt).orderBy(tie)))
        many = many.join(ahead, [F.col(c).eqNullSafe(F.col(n)) for c, n in other.items()])
        share = F.floor(F.col(times) / F.col(rows)) + F.when(F.col(number) + F.col(before) <= F.col(times) % F.col(rows), 1).otherwise(0)
        once = once.unionByName(many.select(*[F.col(f"`{c}`") for c in docs.columns], share.cast("long").alias(times)).where(F.col(times) > 0))
    return once.withColumn(copy, F.explode(F.expr(f"sequence(1L, {times})"))).select(*[F.col(f"`{c}`") for c in docs.columns])
