"""Balanced partitions of lengths and micro-batches under a token budget.

These run over the lengths of one global batch, which its size bounds.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _State:
    """k disjoint sets (sum, size, [(index, length), ...]), largest first; in a heap the
    widest spread comes first, and of equally wide ones that of the larger first set."""

    def __init__(self, sets):
        self.sets = sorted(sets, reverse=True)
        self.rank = (self.sets[0][0] - self.sets[-1][0], self.sets[0])

    def __lt__(self, other):
        return self.rank > other.rank

    def with_other(self, other):
        pairs = zip(self.sets, reversed(other.sets), strict=True)
        return _State([(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in pairs])


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k sets of indices with close sums by largest differencing: states of k
    sets are merged, the two of widest spread first, largest set with smallest.
    Sets of one sum go by their size and members."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    alone = [(lengths[i], 1, [(i, lengths[i])]) for i in order]
    if equal:
        if len(lengths) % k:
            raise ValueError("equal sizes need a multiple of k lengths")
        heap = [_State(alone[a : a + k]) for a in range(0, len(alone), k)]
    else:
        heap = [_State([s] + [(0, 0, [])] * (k - 1)) for s in alone]
    heapq.heapify(heap)
    while len(heap) > 1:
        widest = heapq.heappop(heap)
        heapq.heapreplace(heap, widest.with_other(heap[0]))
    return [sorted(i for i, _ in s[2]) for s in heap[0].sets] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each length to the set of least sum, in order; with ``equal`` sets of fewer
    members come first, so that sizes never differ by more than one."""
    if equal and len(lengths) % k:
        raise ValueError("equal sizes need a multiple of k lengths")
    sets, sums = [[] for _ in range(k)], [0] * k
    for i, n in enumerate(lengths):
        j = min(range(k), key=lambda j: (len(sets[j]) if equal else 0, sums[j], j))
        sets[j].append(i)
        sums[j] += n
    return sets


def balanced(df: DataFrame, batch: str, pos: str, length: str, k: int, method: str = "differencing", equal: bool = False) -> DataFrame:
    """``part`` of each row of a global batch: one task a batch, lengths only."""
    import pandas as pd

    split = {"differencing": differencing, "greedy": greedy}[method]

    def one(pdf):
        pdf = pdf.sort_values(pos).reset_index(drop=True)
        part = [0] * len(pdf)
        for p, rows in enumerate(split(pdf[length].astype("int64").tolist(), k, equal)):
            for i in rows:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], pos: pdf[pos], length: pdf[length].astype("int64"), "part": part})

    return df.select(F.col(batch).cast("long"), F.col(pos).cast("long"), F.col(length).cast("long")).groupBy(batch).applyInPandas(one, f"{batch} long, {pos} long, {length} long, part long")


def imbalance(parts: DataFrame, batch: str, length: str) -> DataFrame:
    """Least, largest and mean sum over a batch's parts."""
    sums = parts.groupBy(batch, "part").agg(F.sum(length).alias("s"))
    return sums.groupBy(batch).agg(F.min("s").alias("least"), F.max("s").alias("largest"), F.avg("s").alias("mean"))


def micro_batches(df: DataFrame, batch: str, pos: str, length: str, budget: int) -> DataFrame:
    """Rows dealt into min(N, ceil(total / budget)) balanced micro-batches."""
    import pandas as pd

    def one(pdf):
        pdf = pdf.sort_values(pos).reset_index(drop=True)
        lengths = pdf[length].astype("int64").tolist()
        k = max(1, min(len(lengths), -(-sum(lengths) // budget)))
        part = [0] * len(pdf)
        for p, rows in enumerate(differencing(lengths, k)):
            for i in rows:
                part[i] = p
        return pd.DataFrame({batch: pdf[batch], pos: pdf[pos], length: lengths, "part": part})

    return df.select(F.col(batch).cast("long"), F.col(pos).cast("long"), F.col(length).cast("long")).groupBy(batch).applyInPandas(one, f"{batch} long, {pos} long, {length} long, part long")
