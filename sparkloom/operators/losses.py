"""Masked reductions, losses and token-array helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked_sum(x: str, m: str) -> Column:
    return F.expr(f"aggregate(zip_with({x}, {m}, (a, b) -> cast(a as double) * b), 0D, (s, v) -> s + v)")


def mask_size(m: str) -> Column:
    return F.expr(f"aggregate({m}, 0D, (s, v) -> s + v)")


def masked_mean(x: str, m: str) -> Column:
    return masked_sum(x, m) / (mask_size(m) + 1e-8)


def masked_var(x: str, m: str) -> Column:
    """Unbiased variance of the masked tokens of one row."""
    n = f"aggregate({m}, 0D, (s, v) -> s + v)"
    mean = f"(aggregate(zip_with({x}, {m}, (a, b) -> cast(a as double) * b), 0D, (s, v) -> s + v) / ({n} + 1e-8D))"
    return F.expr(f"transform(array({mean}), mu -> aggregate(zip_with({x}, {m}, (a, b) -> (a - mu) * (a - mu) * b), 0D, (s, v) -> s + v))[0] / ({n} + 1e-8D) * {n} / ({n} - 1)")


def loss_aggregate(row_sum: Column, row_mask: Column, mode: str, width: int | None = None) -> Column:
    """An aggregate over rows of (sum of masked losses, sum of mask)."""
    if mode == "token-mean":
        return F.sum(row_sum) / (F.sum(row_mask) + 1e-8)
    if mode == "seq-mean-token-sum":
        return F.avg(row_sum)
    if mode == "seq-mean-token-mean":
        return F.avg(row_sum / row_mask)
    if mode == "seq-mean-token-sum-norm":
        return F.sum(row_sum) / width
    raise ValueError(f"no loss mode {mode}")


def ppo_terms(log_ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> dict[str, Column]:
    """Clipped policy loss of one token with a lower bound for negative
    advantages, and its indicators."""
    d = F.greatest(F.least(log_ratio, F.lit(20.0)), F.lit(-20.0))
    ratio = F.exp(d)
    plain = -advantage * ratio
    clipped = -advantage * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    base = F.greatest(plain, clipped)
    bound = -advantage * c
    return {
        "loss": F.when(advantage < 0, F.least(base, bound)).otherwise(base),
        "clipped": (clipped > plain).cast("double"),
        "clipped_low": ((base > bound) & (advantage < 0)).cast("double"),
        "kl": -d,
    }


def value_loss(value: Column, old: Column, returns: Column, clip: float) -> Column:
    """Half the larger squared error of the value and of the value kept near the
    old one."""
    near = F.greatest(F.least(value, old + clip), old - clip)
    return 0.5 * F.greatest((value - returns) ** 2, (near - returns) ** 2)


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        r = F.greatest(F.least(ref - logp, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(r) - r - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"no KL penalty {kind}")


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to most - buffer tokens, then down in proportion to the excess."""
    return F.least(-(length - (most - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def entropy(logits: str) -> Column:
    """Entropy of softmax(logits)."""
    return F.expr(f"transform(array(array_max({logits})), t -> transform(array(aggregate({logits}, 0D, (s, x) -> s + exp(x - t))), z -> ln(z) + t - aggregate({logits}, 0D, (s, x) -> s + exp(x - t) / z * x))[0])[0]")


def padded(ids: Column, size: int, pad: int, side: str = "right", truncate: str = "error") -> Column:
    """An array of exactly ``size``: padded on a side, or cut: left keeps the end,
    right the start, middle both ends."""
    n = F.size(ids)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - n, F.lit(0)))
    full = F.concat(fill, ids) if side == "left" else F.concat(ids, fill)
    if truncate == "left":
        cut = F.slice(ids, F.greatest(n - size + 1, F.lit(1)), size)
    elif truncate == "right":
        cut = F.slice(ids, 1, size)
    elif truncate == "middle":
        head = size // 2
        cut = F.concat(F.slice(ids, 1, head), F.slice(ids, F.greatest(n - (size - head) + 1, F.lit(1)), size - head))
    else:
        cut = F.when(n > size, F.raise_error(F.lit("sequence too long"))).otherwise(ids)
    return F.when(n > size, cut).otherwise(full)


def without_left_padding(ids: Column, mask: Column) -> Column:
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(n > 0, F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)).otherwise(F.slice(ids, 1, 0))


def sft_loss_mask(mask: Column, prompt: Column, response: Column) -> Column:
    """The attention mask without the prompt's tokens but its last, and without
    the last token of the response."""
    return F.transform(mask, lambda x, i: F.when(((prompt > 1) & (i < prompt - 1)) | (i == F.least(prompt + response, F.size(mask)) - 1), 0).otherwise(x))


def reward_on_last(mask: Column, reward: Column) -> Column:
    """The scalar reward on the last valid token, 0 elsewhere."""
    last = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int")) - 1
    return F.transform(mask, lambda x, i: F.when(i == last, reward).otherwise(0.0))
