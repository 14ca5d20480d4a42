"""Positional operators over a batch: rows are identified by a position column.

A batch is any DataFrame with a unique long position; no operator renumbers rows
through a global sort, each computes the new position from the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only the named columns."""
    return df.select(*keys)


def pop(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest)."""
    return df.select(*keys), df.drop(*keys)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def pick(df: DataFrame, wanted: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows at the positions of ``wanted`` (index, at): position ``at`` goes
    to ``index``; a position may come up more than once."""
    return df.withColumnRenamed(pos, "_at").join(wanted.select(F.col("index").alias(pos), F.col("at").alias("_at")), "_at").drop("_at")


def slice_rows(df: DataFrame, start: int, stop: int, step: int = 1, pos: str = "pos") -> DataFrame:
    """Positions start, start + step, ... below stop."""
    p = F.col(pos)
    return df.where((p >= start) & (p < stop) & ((p - start) % step == 0))


def reorder(df: DataFrame, permutation: DataFrame, pos: str = "pos") -> DataFrame:
    """Row ``old`` of ``permutation`` (old, new) moves to position ``new``."""
    return df.withColumnRenamed(pos, "old").join(permutation, "old").drop("old").withColumnRenamed("new", pos)


def reverse_permutation(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("new").alias("old"), F.col("old").alias("new"))


def repeat(df: DataFrame, n: int, interleave: bool = True, pos: str = "pos", total: Column | None = None) -> DataFrame:
    """Every row n times; interleaved copies follow each other, tiled ones follow
    the whole batch, for which ``total`` is its number of rows."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.col(pos) * n + F.col("copy") if interleave else F.col("copy") * total + F.col(pos)
    return out.withColumn(pos, at.cast("long"))


def repeat_by(df: DataFrame, count: Column, pos: str = "pos") -> DataFrame:
    """Row i as often as its own ``count``; none for 0 and below."""
    return df.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))))


def pad_to_multiple(df: DataFrame, divisor: int, total: int, pos: str = "pos") -> DataFrame:
    """Rows from the start again, as many as a multiple of ``divisor`` lacks."""
    lack = -total % divisor
    if not lack or not total:
        return df
    rounds = -(-lack // total)
    more = df.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(pos, (F.col("_round") * total + F.col(pos)).cast("long"))
    return df.unionByName(more.where(F.col(pos) < total + lack).drop("_round"))


def unpad(df: DataFrame, total: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) < total)


def pad_edge(df: DataFrame, n: int, total: int, first: bool = False, pos: str = "pos") -> DataFrame:
    """n copies of the first or the last row after the end."""
    edge = df.where(F.col(pos) == (0 if first else total - 1)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df.unionByName(edge.withColumn(pos, (F.lit(total) + F.col("_k")).cast("long")).drop("_k"))


def chunk(df: DataFrame, parts: int, total: int, pos: str = "pos") -> DataFrame:
    """``chunk``: consecutive parts of ceil(total / parts) rows, the last shorter."""
    return df.withColumn("chunk", F.floor(F.col(pos) / -(-total // parts)).cast("long"))


def fold(df: DataFrame, width: int, value: str, pos: str = "pos") -> DataFrame:
    """``width`` consecutive rows as one row with an array."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return df.groupBy(F.floor(F.col(pos) / width).cast("long").alias(pos)).agg(F.transform(rows, lambda x: x["v"]).alias(value))


def unfold(df: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """The inverse of ``fold`` for arrays of one length."""
    return df.select("*", F.posexplode(value).alias("_i", "_v")).withColumn(pos, (F.col(pos) * F.size(value) + F.col("_i")).cast("long")).drop(value, "_i").withColumnRenamed("_v", value)


def unfold_columns(df: DataFrame, parts: int, value: str, pos: str = "pos") -> DataFrame:
    """Arrays cut into ``parts`` equal pieces, a row each; other columns repeat."""
    width = F.floor(F.size(value) / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(F.col(value), i * width + 1, width))
    out = df.select("*", F.posexplode(pieces).alias("_i", "_piece"))
    return out.withColumn(pos, (F.col(pos) * parts + F.col("_i")).cast("long")).drop(value, "_i").withColumnRenamed("_piece", value)


def positional_union(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Columns of both batches by position; columns that both have must agree,
    else the query fails."""
    common = [c for c in right.columns if c in left.columns and c != pos]
    other = right.select(pos, *[F.col(c).alias(f"_r_{c}") if c in common else F.col(c) for c in right.columns if c != pos])
    out = left.join(other, pos)
    for c in common:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")))).drop(f"_r_{c}")
    return out


def concat(parts: list[DataFrame], sizes: list[int], pos: str = "pos") -> DataFrame:
    """Batches one after another, positions going on."""
    out, base = None, 0
    for df, n in zip(parts, sizes, strict=True):
        df = df.withColumn(pos, (F.col(pos) + base).cast("long"))
        out, base = df if out is None else out.unionByName(df, allowMissingColumns=True), base + n
    return out


def shuffled_rank(df: DataFrame, seed: int, pos: str = "pos", bits: int = 12) -> DataFrame:
    """``rank`` of each row, from 0, in the order of a seeded hash, and ``total``.  No
    global sort: rows are ranked within ranges of the hash, and the ranges' counts, a
    table of at most 2^bits rows, say where each begins."""
    from pyspark.sql import Window as W

    h = F.xxhash64(F.lit(seed), F.col(pos))
    rows = df.withColumns({"_h": h, "_b": F.shiftright(h, 64 - bits)})
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_start"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("total"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h", pos)))
    return ranked.join(F.broadcast(starts), "_b").withColumn("rank", F.col("_start") + F.col("_r") - 1).drop("_h", "_b", "_r", "_start")


def _text_range(df: DataFrame, column: str, buckets: int = 256) -> Column:
    """The number of a text's range, in the texts' order.  All texts begin with what the
    first and the last one share; the seven bytes behind it are a number, whose quantiles
    bound the ranges."""
    low, high = (x.encode() if x is not None else b"" for x in df.agg(F.min(column), F.max(column)).first())
    shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    behind = F.substring(F.col(column).cast("binary"), shared + 1, 7)
    number = F.conv(F.rpad(F.hex(behind), 14, "0"), 16, 10).cast("long")
    bounds = df.select(F.percentile_approx(number, [i / buckets for i in range(1, buckets)], 8 * buckets)).first()[0]
    return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds or [0]))]), lambda b: b <= number))


def mask_first_rank(df: DataFrame, mask: str, pos: str = "pos", buckets: int = 4096) -> DataFrame:
    """``rank`` of each row, from 0, with the rows of a true ``mask`` first and each
    kind by ``pos`` (a number or a text, unique), and ``total``; a null mask is false.  No
    global sort: rows are ranked within ranges of ``pos``, even ones of numbers if their
    values are, and the counts of at most ``buckets`` ranges say where each begins."""
    from pyspark.sql import Window as W

    on = F.coalesce(F.col(mask), F.lit(False))
    if dict(df.dtypes)[pos] == "string":
        rows = df.withColumns({"_on": on, "_b": _text_range(df, pos)})
    else:
        ends = df.agg(F.min(pos).cast("double").alias("_lo"), F.max(pos).cast("double").alias("_hi"))
        place = F.floor((F.col(pos).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * buckets)
        rows = df.join(F.broadcast(ends)).withColumns({"_on": on, "_b": place}).drop("_lo", "_hi")
    counts = rows.groupBy("_b").agg(F.count_if("_on").alias("_t"), F.count_if(~F.col("_on")).alias("_f"))
    upto, every = W.orderBy("_b"), W.partitionBy(F.lit(0))
    starts = counts.select("_b", (F.sum("_t").over(upto) - F.col("_t")).alias("_t0"), (F.sum("_f").over(upto) - F.col("_f") + F.sum("_t").over(every)).alias("_f0"), (F.sum("_t").over(every) + F.sum("_f").over(every)).alias("total"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_b", "_on").orderBy(pos)))
    return ranked.join(F.broadcast(starts), "_b").withColumn("rank", F.when(F.col("_on"), F.col("_t0")).otherwise(F.col("_f0")) + F.col("_r") - 1).drop("_on", "_b", "_t0", "_f0", "_r")


def mini_batches(df: DataFrame, size: int, seed: int, pos: str = "pos") -> DataFrame:
    """``mini_batch``: a seeded shuffle cut into batches of ``size`` rows, the last with
    the rest.  Another epoch is another seed."""
    return shuffled_rank(df, seed, pos).withColumn("mini_batch", F.floor(F.col("rank") / size)).drop("rank", "total")


def ratio_split(df: DataFrame, ratio: float, seed: int, pos: str = "pos") -> DataFrame:
    """``split``: the first floor(ratio * N) rows of a seeded shuffle are train, others test."""
    return shuffled_rank(df, seed, pos).withColumn("split", F.when(F.col("rank") < F.floor(F.lit(ratio) * F.col("total")), "train").otherwise("test")).drop("rank", "total")


def rank_shard(df: DataFrame, rank: int, world: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) % world == rank)


def weighted_resample(df: DataFrame, weight: Column, draws: int, seed: int, pos: str = "pos", bits: int = 12) -> DataFrame:
    """``draws`` rows with replacement, row i with probability in proportion to
    its weight: systematic draws over the running weight in the order of a seeded hash.
    Running weights are whole numbers within ranges of the hash, and the ranges' sums, at
    most 2^bits of them, say where each begins, so no task sees all rows and the draws add
    up.  Null and negative weights count as 0; without any weight nothing is drawn."""
    from pyspark.sql import Window as W

    h = F.xxhash64(F.lit(seed), F.col(pos))
    rows = df.withColumns({"_v": F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)), "_h": h, "_b": F.shiftright(h, 64 - bits)})
    top = rows.agg(F.max("_v").alias("_top"))
    rows = rows.join(F.broadcast(top)).withColumn("_w", F.when(F.col("_top") > 0, F.round(F.col("_v") / F.col("_top") * 1e12)).otherwise(0).cast("decimal(13,0)")).drop("_v", "_top")
    sums = rows.groupBy("_b").agg(F.sum("_w").alias("_s"))
    starts = sums.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_start"), F.sum("_s").over(W.partitionBy(F.lit(0))).alias("_all"))
    upto = F.sum("_w").over(W.partitionBy("_b").orderBy("_h", pos).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).join(F.broadcast(starts), "_b")
    # floor(2 * weight * draws + all) / (2 * all): draws up to a place, rounded.
    number = lambda x: F.expr(f"CAST(({x} * {2 * draws} + _all) DIV (2 * _all) AS LONG)")
    rows = rows.where("_all > 0").withColumn("_copies", number("(_start + _upto)") - number("(_start + _upto - _w)"))
    return repeat_by(rows, F.col("_copies")).drop("_b", "_h", "_w", "_upto", "_start", "_all", "_copies", "copy")


def resample_weights(df: DataFrame, batch: str, score: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """``weight`` of each row of a global batch: pow: |score|^power; max_min: 1 for the
    best and worst scores, else 0; max_random: 0.4 for the best, else 0.1; all plus 1e-8."""
    best = df.groupBy(batch).agg(F.max(score).alias("_max"), F.min(score).alias("_min"))
    is_max, is_min = F.col(score) == F.col("_max"), F.col(score) == F.col("_min")
    kinds = {"pow": F.pow(F.abs(F.col(score)), F.lit(power)), "max_min": (is_max | is_min).cast("double"), "max_random": F.when(is_max, 0.4).otherwise(0.1)}
    if method not in kinds:
        raise ValueError(f"no such weights: {method}")
    return df.join(best, batch).withColumn("weight", F.greatest(kinds[method] + 1e-8, F.lit(1e-8))).drop("_max", "_min")


def multinomial_resample(df: DataFrame, batch: str, weight: str, seed: int, pos: str = "pos") -> DataFrame:
    """As many rows of each global batch as it has, drawn independently with
    replacement by weight; repeated rows.  Draws are made over positions and weights of one
    batch, which its size bounds; whole rows are only joined."""
    import numpy as np
    import pandas as pd

    def one(pdf):
        pdf = pdf.sort_values(pos)
        w = pdf[weight].to_numpy(dtype="float64")
        times = np.random.RandomState(seed).multinomial(len(w), w / w.sum())
        return pd.DataFrame({batch: pdf[batch], pos: pdf[pos], "_times": times})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    times = df.select(batch, pos, weight).groupBy(batch).applyInPandas(one, f"{batch} {kinds[batch]}, {pos} {kinds[pos]}, _times long").where("_times > 0")
    return df.join(times, [batch, pos]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_copy", "_times")
