"""Evaluation reports: grouped accuracies, pivots, all-correct families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, hit: str, levels: list[str]) -> DataFrame:
    """(level, name, n, accuracy) over all rows and over each level's values, in
    one pass of grouping sets; null values of a level are left out."""
    sets = [F.struct(F.lit("Overall").alias("level"), F.lit("all").alias("name"))]
    sets += [F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for c in levels]
    long = df.select(F.col(hit).cast("double").alias("hit"), F.inline(F.array(*sets)))
    return long.where("name is not null").groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))


def rolled_up(df: DataFrame, hit: str, levels: list[str]) -> DataFrame:
    """Means of scores that are not negative, with subtotals for every prefix of
    the levels."""
    return df.where(F.col(hit) >= 0).rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("score"))


def pivoted(df: DataFrame, row: str, column: str, values: list[str], score: str) -> DataFrame:
    """Rows by columns of mean scores, 0 where there is none, and the row's
    average over the columns."""
    out = df.groupBy(row).pivot(column, values).agg(F.avg(score)).fillna(0.0, subset=values)
    return out.withColumn("average", sum((F.col(f"`{v}`") for v in values), F.lit(0.0)) / len(values))


def all_correct(df: DataFrame, score: str, figure: list[str], question: list[str]) -> DataFrame:
    """One row: the share of rows that are right, and of figures and questions
    all of whose rows are."""
    rows = df.agg(F.avg(F.col(score).cast("double")).alias("answer_accuracy"))
    each = [df.groupBy(*keys).agg(F.every(F.col(score).cast("boolean")).cast("double").alias("ok")).agg(F.avg("ok").alias(name)) for keys, name in ((figure, "figure_accuracy"), (question, "question_accuracy"))]
    return rows.join(F.broadcast(each[0])).join(F.broadcast(each[1]))  # one row each


def yes_no_f1(df: DataFrame, truth: Column, said: Column, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and accuracy of yes against no; 0 without a
    denominator."""
    g = df.groupBy(*by).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count(F.lit(1)).alias("n"))

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    g = g.withColumn("precision", p).withColumn("recall", r)
    return g.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", (F.col("n") - F.col("fp") - F.col("fn")) / F.col("n"))


def paired_score(df: DataFrame, category: str, pair: str, score: str) -> DataFrame:
    """100 * (share of rows right + share of pairs all right) by category."""
    pairs = df.groupBy(category, pair).agg(F.sum(F.col(score).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"), F.every(F.col(score).cast("boolean")).cast("double").alias("both"))
    return pairs.groupBy(category).agg((100 * (F.sum("s") / F.sum("n") + F.avg("both"))).alias("score"))


def macro_micro(df: DataFrame, task: str, score: str) -> DataFrame:
    """One row: the mean over tasks of their means, and the mean over rows."""
    g = df.groupBy(task).agg(F.avg(score).alias("m"), F.sum(score).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.avg("m").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def cycles(df: DataFrame, cycle: str, category: str, score: str) -> DataFrame:
    """Accuracy by category averaged over cycles."""
    return df.groupBy(cycle, category).agg(F.avg(score).alias("a")).groupBy(category).agg(F.avg("a").alias("accuracy"), F.count(F.lit(1)).alias("cycles"))


def preference(df: DataFrame, by: list[str], score: Column, reversed_pair: Column) -> DataFrame:
    """Reversed pairs count negated: mean reward and win rate, ties half."""
    s = F.when(reversed_pair, -score).otherwise(score)
    return df.groupBy(*by).agg(F.avg(s).alias("reward"), F.avg(F.when(s > 0, 1.0).when(s == 0, 0.5).otherwise(0.0)).alias("win_rate"))


def at_thresholds(df: DataFrame, by: list[str], iou: str, thresholds: list[float]) -> DataFrame:
    """Share of rows whose IoU reaches each threshold."""
    out = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return out.groupBy(*by, "threshold").agg(F.avg((F.col(iou) >= F.col("threshold")).cast("double")).alias("accuracy"))


def leaderboard(df: DataFrame, model: str, dataset: str, datasets: list[str], score: str) -> DataFrame:
    """Models by data sets, null where a result is missing."""
    return df.groupBy(model).pivot(dataset, datasets).agg(F.first(score))


def missing(models: DataFrame, datasets: DataFrame, results: DataFrame, model: str, dataset: str) -> DataFrame:
    """Pairs without a result; the two name lists are the axes of a report."""
    every = models.select(model).distinct().crossJoin(datasets.select(dataset).distinct())
    return every.join(results.select(model, dataset), [model, dataset], "left_anti")


def rescaled(df: DataFrame, by: str, score: str) -> DataFrame:
    """Scores between a group's least and largest as 0 to 100."""
    g = df.groupBy(by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return df.join(g, by).withColumn("rescaled", F.when(F.col("_hi") > F.col("_lo"), 100 * (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(100.0)).drop("_lo", "_hi")


def shared_scale(df: DataFrame, by: str, score: str, log: bool = False) -> DataFrame:
    """``scaled``: every group's scores as 0 to 100 of a range that is as wide for all,
    the widest group's and a quarter more (of logarithms 0.5 % more), around the group's
    middle; a range that would reach 100 ends there.  ``log`` needs positive scores."""
    value = F.log(score) if log else F.col(score).cast("double")
    g = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    widest = g.agg((F.max(F.col("_hi") - F.col("_lo")) * (1.005 if log else 1.25)).alias("_wide"))
    rows = df.join(g, by).crossJoin(F.broadcast(widest))  # one row
    top = (F.col("_lo") + F.col("_hi")) / 2 + F.col("_wide") / 2
    start = F.when(top < 100, top - F.col("_wide")).otherwise(100 - F.col("_wide"))
    return rows.withColumn("scaled", (value - start) / F.col("_wide") * 100).drop("_lo", "_hi", "_wide")


def weighted_pages(df: DataFrame, page: list[str], attribute: str, distance: str, length: str) -> DataFrame:
    """Length-weighted mean distance of each page and attribute, then the mean
    over pages."""
    g = df.groupBy(*page, attribute).agg((F.sum(F.col(distance) * F.col(length)) / F.sum(length)).alias("d"))
    return g.groupBy(attribute).agg(F.avg("d").alias("distance"), F.count(F.lit(1)).alias("pages"))


def rotations(tables: list[DataFrame], key: str, names: list[str]) -> DataFrame:
    """One row over the keys that all tables (key, one hit column each) have: the
    mean of each, of all, and the shares of keys hit or missed by every one."""
    both = tables[0]
    for t in tables[1:]:
        both = both.join(t, key)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    mean = lambda c: F.avg(c.cast("double"))
    return both.agg(*[mean(F.col(n)).alias(n) for n in names], mean(total / len(names)).alias("average"), mean((total == len(names)).cast("int")).alias("hit_all"), mean((total == 0).cast("int")).alias("miss_all"))


def split_report(df: DataFrame, split: str, area: str, task: str, hit: str) -> DataFrame:
    """(split, kind, name, value): accuracy of each split and of ALL: overall, by task, and
    by area the mean of its tasks' accuracies, null where a task has no row in the split."""
    base = df.groupBy(F.col(split).alias("split"), F.col(area).alias("area"), F.col(task).alias("task")).agg(F.sum(F.col(hit).cast("double")).alias("s"), F.count(hit).alias("n"))
    base = base.withColumn("split", F.explode(F.array("split", F.lit("ALL"))))
    mean = F.sum("s") / F.sum("n")
    tasks = base.groupBy("split", "task").agg(mean.alias("value"))
    of = base.select("area", "task").distinct()
    areas = tasks.join(of, "task").groupBy("split", "area").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("c")).join(of.groupBy("area").agg(F.count(F.lit(1)).alias("all")), "area")
    line = lambda kind, name, value: ["split", F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.alias("value")]
    overall = base.groupBy("split").agg(mean.alias("value")).select(*line("overall", F.lit("Overall"), F.col("value")))
    return overall.unionByName(tasks.select(*line("task", F.col("task"), F.col("value")))).unionByName(areas.select(*line("area", F.col("area"), F.when(F.col("c") == F.col("all"), F.col("v")))))


def caption_bleu(df: DataFrame, candidate: str, references: str, by: list[str] | None = None) -> DataFrame:
    """bleu_1 to bleu_4 of a caption set: n-gram matches, clipped by the most of one
    reference, and lengths (the reference nearest in length, the shorter of two) are summed
    over all captions first."""
    from ..functions.similarity import caption_counts

    c = df.select(*(by or []), caption_counts(candidate, references).alias("c"))
    sums = c.groupBy(*(by or [])).agg(*[F.sum(F.col("c")[i]).cast("double").alias(f"c{i}") for i in range(10)])
    # What keeps the quotients from 0.
    tiny, small = 1e-15, 1e-9
    ratio = (F.col("c8") + tiny) / (F.col("c9") + small)
    short = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    product, out = F.lit(1.0), []
    for n in range(4):
        product = product * (F.col(f"c{n}") + tiny) / (F.col(f"c{n + 4}") + small)
        out.append((F.pow(product, F.lit(1 / (n + 1))) * short).alias(f"bleu_{n + 1}"))
    return sums.select(*(by or []), *out)
