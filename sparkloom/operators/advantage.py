"""Advantage estimators: grouped statistics broadcast back to rows.

Scores come one row a response (uid, pos, score); token-wise estimators take
arrays of rewards, values and masks.  ``register`` adds an estimator by name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-6
_ESTIMATORS: dict[str, Callable] = {}


def register(name: str):
    """Decorator; one name for two different functions is an error."""

    def add(fn):
        if _ESTIMATORS.get(name, fn) is not fn:
            raise ValueError(f"estimator {name} is registered already")
        _ESTIMATORS[name] = fn
        return fn

    return add


def estimator(name: str) -> Callable:
    if name not in _ESTIMATORS:
        raise ValueError(f"no estimator {name}: {sorted(_ESTIMATORS)}")
    return _ESTIMATORS[name]


def _over(uid):
    return W.partitionBy(uid)


@register("grpo")
def grpo(df: DataFrame, uid: str = "uid", score: str = "score", normalise: bool = True) -> DataFrame:
    """(score - mean) / (std + 1e-6) within a prompt, the unbiased std; a single
    response has mean 0 and std 1."""
    n = F.count(F.lit(1)).over(_over(uid))
    mean = F.when(n == 1, 0.0).otherwise(F.avg(score).over(_over(uid)))
    std = F.when(n == 1, 1.0).otherwise(F.stddev_samp(score).over(_over(uid)))
    centred = F.col(score) - mean
    return df.withColumn("advantage", centred / (std + EPS) if normalise else centred)


@register("grpo_passk")
def grpo_passk(df: DataFrame, uid: str = "uid", score: str = "score", pos: str = "pos", normalise: bool = True) -> DataFrame:
    """Only the best response of a prompt gets its lead over the second; the first
    by position wins ties.  A prompt with one response is an error."""
    order = _over(uid).orderBy(F.col(score).desc(), F.col(pos))
    n = F.count(F.lit(1)).over(_over(uid))
    lead = F.col(score) - F.lead(score).over(order)
    lead = lead / (F.stddev_samp(score).over(_over(uid)) + EPS) if normalise else lead
    best = F.when(F.row_number().over(order) == 1, lead).otherwise(0.0)
    return df.withColumn("advantage", F.when(n < 2, F.raise_error(F.lit("pass@k needs two responses of each prompt"))).otherwise(best))


@register("rloo")
def rloo(df: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """score less the mean of the others; a single response is left as it is."""
    n = F.count(F.lit(1)).over(_over(uid))
    mean = F.avg(score).over(_over(uid))
    return df.withColumn("advantage", F.when(n > 1, (F.col(score) - mean) * n / (n - 1)).otherwise(F.col(score)))


@register("opo")
def opo(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """score less the length-weighted mean; 0 is taken off a single response."""
    n = F.count(F.lit(1)).over(_over(uid))
    base = F.sum(F.col(score) * F.col(length)).over(_over(uid)) / F.sum(length).over(_over(uid))
    return df.withColumn("advantage", F.col(score) - F.when(n == 1, 0.0).otherwise(base))


@register("reinforce_pp_baseline")
def reinforce_pp_baseline(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """score less the group mean, whitened over all tokens: a response counts as
    often as it has tokens."""
    n = F.count(F.lit(1)).over(_over(uid))
    centred = df.withColumn("_c", F.col(score) - F.when(n == 1, 0.0).otherwise(F.avg(score).over(_over(uid))))
    # Centred scores lie around 0, so their sums of squares lose nothing: one pass.
    sums = centred.agg(F.sum(length).alias("_tokens"), F.sum(F.col("_c") * F.col(length)).alias("_s"), F.sum(F.col("_c") * F.col("_c") * F.col(length)).alias("_q"))
    mean = F.col("_s") / (F.col("_tokens") + 1e-8)
    spread = F.greatest(F.col("_q") - 2 * mean * F.col("_s") + mean * mean * F.col("_tokens"), F.lit(0.0))
    stats = sums.select(mean.alias("_mean"), (spread / (F.col("_tokens") + 1e-8) * F.col("_tokens") / (F.col("_tokens") - 1)).alias("_var"))
    both = centred.join(F.broadcast(stats))  # one row
    return both.withColumn("advantage", (F.col("_c") - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_c", "_mean", "_var")


def whiten(df: DataFrame, values: str, mask: str, out: str = "whitened") -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) of all masked tokens of the batch, applied
    to every token; fewer than two masked tokens are an error."""
    pairs = F.arrays_zip(F.col(values).alias("x"), F.col(mask).alias("m"))

    def total(f):
        return F.sum(F.aggregate(F.transform(pairs, lambda p: f(p["x"], p["m"])), F.lit(0.0), lambda a, x: a + x))

    s = df.agg(total(lambda x, m: x * m).alias("sx"), total(lambda x, m: m.cast("double")).alias("_n"))
    s = s.select((F.col("sx") / (F.col("_n") + 1e-8)).alias("_mean"), F.when(F.col("_n") < 2, F.raise_error(F.lit("whitening needs two tokens"))).otherwise(F.col("_n")).alias("_n"))
    both = df.join(F.broadcast(s))
    var = both.agg((F.sum(F.aggregate(F.transform(pairs, lambda p: (p["x"] - F.col("_mean")) ** 2 * p["m"]), F.lit(0.0), lambda a, x: a + x)) / (F.first("_n") + 1e-8) * F.first("_n") / (F.first("_n") - 1)).alias("_var"))
    return both.join(F.broadcast(var)).withColumn(out, F.expr(f"transform({values}, x -> (x - _mean) / sqrt(_var + 1e-8))")).drop("_mean", "_n", "_var")


def _right(column) -> tuple[np.ndarray, list[int]]:
    """Arrays of a column as rows of a matrix that end together, and their
    lengths; null arrays are empty."""
    rows = [np.zeros(0) if x is None else np.asarray(x, np.float64) for x in column]
    n = [len(x) for x in rows]
    out = np.zeros((len(rows), max(n, default=0)))
    for i, x in enumerate(rows):
        if n[i]:
            out[i, -n[i] :] = x
    return out, n


def _left(matrix: np.ndarray, n: list[int]) -> list[np.ndarray]:
    width = matrix.shape[1]
    return [row[width - k :] for row, k in zip(matrix, n, strict=True)]


def suffix_returns(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Discounted sums of the masked rewards from each token to the end; a masked
    token resets what it passes on, as its own return is masked too.  One pass
    from the last token for all rows of an Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(rewards: pd.Series, mask: pd.Series) -> pd.Series:
        (r, n), (m, _) = _right(rewards), _right(mask)
        held = np.zeros(len(r))
        for k in range(r.shape[1] - 1, -1, -1):
            r[:, k] += gamma * held
            held = r[:, k] * m[:, k]
        return pd.Series(_left(r, n), dtype=object)

    return run(rewards, mask)


def remax_returns(rewards: str, mask: str) -> Column:
    """Suffix sums of reward * mask."""

    @F.pandas_udf("array<double>")
    def run(rewards: pd.Series, mask: pd.Series) -> pd.Series:
        (r, n), (m, _) = _right(rewards), _right(mask)
        return pd.Series(_left(np.cumsum((r * m)[:, ::-1], axis=1)[:, ::-1], n), dtype=object)

    return run(F.col(rewards), F.col(mask))


def gae(rewards: str, values: str, mask: str, gamma: float, lam: float) -> Column:
    """struct(advantages, returns) before whitening, in one pass from the last
    token for all rows of an Arrow batch: observation tokens (mask 0) pass value,
    advantage and return on unchanged."""

    @F.pandas_udf("advantages array<double>, returns array<double>")
    def run(rewards: pd.Series, values: pd.Series, mask: pd.Series) -> pd.DataFrame:
        (r, n), (v, _), (m, _) = _right(rewards), _right(values), _right(mask)
        adv, carry, ret, after, seen = (np.zeros(len(r)) for _ in range(5))
        seen += 1
        a, g = np.zeros_like(r), np.zeros_like(r)
        for k in range(r.shape[1] - 1, -1, -1):
            on = m[:, k] == 1
            carry = np.where(seen == 1, after, carry)
            step = np.where(on, gamma, 1.0)
            adv = (r[:, k] + step * carry - v[:, k]) * m[:, k] + step * np.where(on, lam, 1.0) * adv
            ret = step * ret + m[:, k] * r[:, k]
            after, seen = v[:, k], m[:, k]
            a[:, k], g[:, k] = adv, ret
        return pd.DataFrame({"advantages": pd.Series(_left(a, n), dtype=object), "returns": pd.Series(_left(g, n), dtype=object)})

    return run(F.col(rewards), F.col(values), F.col(mask))


def soft_mean_baseline(df: DataFrame, score: str = "score", beta: float = 1.0) -> DataFrame:
    """score less log(mean(exp(beta * score))) / beta over the whole batch; the
    plain mean for beta 0."""
    top = df.agg(F.max(score).alias("_top"))
    if beta == 0:
        base = df.agg(F.avg(score).alias("_base"))
    else:
        base = df.join(F.broadcast(top)).agg((F.log(F.avg(F.exp(beta * (F.col(score) - F.col("_top"))))) / beta + F.first("_top")).alias("_base"))
    return df.join(F.broadcast(base)).withColumn("advantage", F.col(score) - F.col("_base")).drop("_base")


def chosen_mask(df: DataFrame, score: str = "score", pos: str = "pos") -> DataFrame:
    """Rows in consecutive pairs; the higher score is chosen, the first wins ties."""
    order = W.partitionBy(F.floor(F.col(pos) / 2)).orderBy(F.col(score).desc(), F.col(pos))
    return df.withColumn("chosen", F.row_number().over(order) == 1)


def multi_source_rloo(df: DataFrame, uid: str, sources: dict[str, float]) -> DataFrame:
    """Weighted sum of leave-one-out advantages of several reward columns."""
    n = F.count(F.lit(1)).over(_over(uid))
    total = F.lit(0.0)
    for column, weight in sources.items():
        total = total + weight * F.when(n > 1, F.col(column) - (F.sum(column).over(_over(uid)) - F.col(column)) / (n - 1)).otherwise(F.col(column))
    return df.withColumn("advantage", total)


def until_first_eos(ids: Column, eos: list[int]) -> Column:
    """1 up to and including the first end token, then 0."""
    first = F.aggregate(F.transform(ids, lambda x, i: F.when(x.isin(eos), i)), F.lit(None).cast("int"), lambda a, x: F.least(a, x))
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i <= first), 1).otherwise(0))


def position_ids(mask: str) -> Column:
    """Running sum of the mask less one, at least 0."""

    @F.pandas_udf("array<long>")
    def run(mask: pd.Series) -> pd.Series:
        return pd.Series([np.maximum(np.cumsum(np.asarray(x if x is not None else [], np.int64)) - 1, 0) for x in mask], dtype=object)

    return run(F.col(mask))


def kl_controller(kls: list[float], start: float, target: float, horizon: float, n: int) -> list[float]:
    """Adaptive coefficient after each step: times 1 + clip(kl / target - 1, +-0.2) * n / horizon."""
    out = []
    for kl in kls:
        start *= 1 + min(max(kl / target - 1, -0.2), 0.2) * n / horizon
        out.append(start)
    return out


def kl_coefficients(steps: DataFrame, start: float, target: float, horizon: float, n: int, order: str = "step") -> DataFrame:
    """The same over (step, kl) rows: a running product of positive factors as the
    exponent of a running sum of logarithms."""
    factor = 1 + F.greatest(F.least(F.col("kl") / target - 1, F.lit(0.2)), F.lit(-0.2)) * n / horizon
    return steps.withColumn("coefficient", start * F.exp(F.sum(F.log(factor)).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))))
