"""Metrics of rollouts and validation: suites, votes, bootstraps, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suite(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """mean, max and min of each column."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    return df.groupBy(*(by or [])).agg(*out)


def explained_variance(returns: Column, values: Column) -> Column:
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def majority(df: DataFrame, by: list[str], vote: str, value: str, pos: str) -> DataFrame:
    """The value at the first row of the most frequent vote; of equally frequent
    ones the vote that is seen first."""
    votes = df.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("c"), F.min(pos).alias("p"), F.min_by(value, pos).alias("v"))
    return votes.groupBy(*by).agg(F.max_by("v", F.struct("c", F.negative("p"))).alias("majority"))


def validation(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """Mean and population std of a prompt's responses, then means over prompts,
    by source and number of responses."""
    each = df.groupBy(source, prompt).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("best"), F.min(value).alias("worst"))
    return each.groupBy(source, "n").agg(F.count(F.lit(1)).alias("prompts"), F.avg("mean").alias("mean_at_n"), F.avg("std").alias("std_at_n"), F.avg("best").alias("best_at_n"), F.avg("worst").alias("worst_at_n"))


def validation_at(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """(source, metric, value): mean@n and std@n of each prompt's n responses, and
    best@k and worst@k, mean and std, for k = 2, 4, ... below n, and n; then means over
    prompts.  best and worst are the exact expectations over k draws with
    replacement, which 1000 seeded draws (``bootstrap``) estimate; ``majority_at`` gives maj@k."""
    from pyspark.sql import Window as W

    w = W.partitionBy(source, prompt)
    ranked = df.where(F.col(value).isNotNull()).select(source, prompt, F.col(value).cast("double").alias("x"), F.row_number().over(w.orderBy(value)).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    each = ranked.groupBy(source, prompt, "n").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    plain = F.array(F.struct(F.concat(F.lit("mean@"), "n").alias("metric"), F.col("mean").alias("v")), F.struct(F.concat(F.lit("std@"), "n").alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("v")))
    ks = F.when(F.col("n") > 1, F.expr("concat(filter(transform(sequence(1, 30), i -> shiftleft(1L, i)), k -> k < n), array(n))"))
    at = ranked.withColumn("k", F.explode(ks))
    upto = lambda r: F.pow(r / F.col("n"), F.col("k").cast("double"))
    parts = {"best": upto(F.col("r")) - upto(F.col("r") - 1), "worst": upto(F.col("n") - F.col("r") + 1) - upto(F.col("n") - F.col("r"))}
    at = at.groupBy(source, prompt, "k").agg(*[F.sum(F.col("x") ** p * share).alias(f"{c}{p}") for c, share in parts.items() for p in (1, 2)])
    tops = [F.struct(F.concat(F.lit(f"{c}@"), "k", F.lit(f"/{kind}")).alias("metric"), v.alias("v")) for c in parts for kind, v in (("mean", F.col(f"{c}1")), ("std", F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}2") - F.col(f"{c}1") ** 2))))]
    both = each.select(source, F.explode(plain).alias("m")).unionByName(at.select(source, F.explode(F.array(*tops)).alias("m")))
    return both.select(source, "m.*").where("v is not null").groupBy(source, "metric").agg(F.avg("v").alias("value"))


def schedule(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def bootstrap(df: DataFrame, by: list[str], value: str, k: int, draws: int = 1000, seed: int = 42, pos: str | None = None) -> DataFrame:
    """Mean and std over ``draws`` samples of k values with replacement of their
    max and min, seeded alike for every group; the groups are a prompt's
    responses, which are few.  Draws count by ``pos``, or else by size of the value."""
    import numpy as np
    import pandas as pd

    def one(pdf):
        x = pdf.sort_values(pos or value)[value].to_numpy()
        rng = np.random.RandomState(seed)
        picks = x[rng.randint(0, len(x), size=(draws, k))]
        best, worst = picks.max(axis=1), picks.min(axis=1)
        return pd.DataFrame([[*pdf[by].iloc[0], best.mean(), best.std(), worst.mean(), worst.std()]], columns=[*by, "best_mean", "best_std", "worst_mean", "worst_std"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", best_mean double, best_std double, worst_mean double, worst_std double"
    return df.groupBy(*by).applyInPandas(one, schema)


def majority_at(df: DataFrame, by: list[str], value: str, vote: str, pos: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by, k, maj_mean, maj_std) for k = 2, 4, ... below n, and n: over ``draws`` seeded
    samples of k of a group's n responses with replacement, the value at the first of the
    most frequent votes, of equally frequent ones that drawn first.  Groups of one response
    have no row; a null vote is a vote of its own.  Groups are a prompt's responses, which are few."""
    import numpy as np
    import pandas as pd

    names = [*by, "k", "maj_mean", "maj_std"]

    def one(pdf):
        pdf = pdf.sort_values(pos)
        x, code = pdf[value].to_numpy(dtype="float64"), pd.factorize(pdf[vote], use_na_sentinel=False)[0]
        out = []
        for k in schedule(len(x)):
            picks = np.random.RandomState(seed).randint(0, len(x), size=(draws, k))
            hits = code[picks][:, :, None] == np.arange(code.max() + 1)
            count, first = hits.sum(axis=1), hits.argmax(axis=1)
            best = np.where(count > 0, count * (k + 1) - first, -1).argmax(axis=1)
            got = x[picks[np.arange(draws), first[np.arange(draws), best]]]
            out.append([*pdf[by].iloc[0], k, got.mean(), got.std()])
        return pd.DataFrame(out, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", k long, maj_mean double, maj_std double"
    return df.select(*by, value, vote, pos).groupBy(*by).applyInPandas(one, schema)


def best_of(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The expectation that such a bootstrap estimates, exactly: the r-th smallest
    of n is the maximum of k draws with probability (r/n)^k - ((r-1)/n)^k."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by)
    r, n = F.row_number().over(w.orderBy(value)), F.count(F.lit(1)).over(w)
    share = F.pow(r / n, F.lit(float(k))) - F.pow((r - 1) / n, F.lit(float(k)))
    return df.withColumn("_x", F.col(value) * share).groupBy(*by).agg(F.sum("_x").alias("best_of"))


def latencies(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and linearly interpolated 50th and 95th percentiles."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))


def nearest_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles."""
    ranks = [F.expr(f"percentile_disc({q}) within group (order by {value})").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *ranks)
