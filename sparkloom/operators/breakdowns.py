"""Further evaluation breakdowns: steps, blocks, votes, failures, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_mastery(df: DataFrame, steps: list[str], whole: str) -> DataFrame:
    """One row of shares over problems with sub-steps and the whole: insufficient
    knowledge, inadequate generalisation, complete mastery and rote memory
    (loose and strict); rote memory is a share of mastery and rote together."""
    right = [F.col(s).cast("boolean") for s in steps]
    any_right, all_right = right[0], right[0]
    for r in right[1:]:
        any_right, all_right = any_right | r, all_right & r
    m = F.col(whole).cast("boolean")
    n = F.count(F.lit(1))

    def rote(wrong, mastered):
        both = F.count_if(m & wrong) + F.count_if(m & mastered)
        return F.when(both > 0, F.count_if(m & wrong) / both).otherwise(0.0)

    return df.agg(
        (F.count_if(~all_right & ~m) / n).alias("insufficient"), (F.count_if(all_right & ~m) / n).alias("inadequate"),
        (F.count_if(m & any_right) / n).alias("mastery_loose"), (F.count_if(m & all_right) / n).alias("mastery_strict"),
        rote(~any_right, any_right).alias("rote_loose"), rote(~all_right, all_right).alias("rote_strict"),
    )


def positional_groups(df: DataFrame, pos: str, score: str, total: int, groups: int = 5) -> DataFrame:
    """Mean score times 100 of consecutive groups, the last with the rest, and
    ``spread``, the population std between the groups (a window over ``groups`` rows)."""
    from pyspark.sql import Window as W

    width = max(1, total // groups)
    means = df.groupBy(F.least(F.floor(F.col(pos) / width), F.lit(groups - 1)).alias("part")).agg((100 * F.avg(score)).alias("score"))
    return means.withColumn("spread", F.stddev_pop("score").over(W.partitionBy(F.lit(0))))


def paired_blocks(df: DataFrame, block: str, question: str, image: str, score: str) -> DataFrame:
    """2 by 2 blocks of questions and images: accuracy of cells, of questions
    right on both images, of images right on both questions, of whole blocks."""
    cells = df.groupBy(block).pivot("cell", ["00", "01", "10", "11"]).agg(F.max(F.col(score).cast("int"))) if "cell" in df.columns else None
    if cells is None:
        return paired_blocks(df.withColumn("cell", F.concat(F.col(question).cast("string"), F.col(image).cast("string"))), block, question, image, score)
    cells = cells.dropna()
    a, b, c, d = (F.col(f"`{k}`") for k in ("00", "01", "10", "11"))
    return cells.agg(F.avg((a + b + c + d) / 4).alias("acc"), F.avg((a * b + c * d) / 2).alias("q_acc"), F.avg((a * c + b * d) / 2).alias("i_acc"), F.avg((a * b * c * d).cast("double")).alias("g_acc"))


def most_frequent(df: DataFrame, by: str, letter: str) -> DataFrame:
    """All letters of the highest count, joined in order."""
    g = df.groupBy(by, letter).agg(F.count(F.lit(1)).alias("c"))
    top = g.groupBy(by).agg(F.max("c").alias("top"))
    rows = g.join(top, by).where("c = top")
    return rows.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set(letter)), "").alias("letters"))


def smoothed_accuracy(right: Column, scored: Column) -> Column:
    """(right + 1e-9) / (scored + 1e-9) over rows; null scores are left out."""
    return (F.count_if(right & scored) + 1e-9) / (F.count_if(scored) + 1e-9)


def failures(df: DataFrame, by: list[str], text: str, marks: list[str]) -> DataFrame:
    """Rows that hold a failure mark, and their share."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.contains(F.col(text), F.lit(m))
    return df.groupBy(*by).agg(F.count_if(hit).alias("failed"), F.avg(hit.cast("double")).alias("share"))


def last_writer(df: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Results of several ranks as one: the highest rank wins a key."""
    return df.groupBy(key).agg(F.max_by(value, rank).alias(value))


def asymmetric_f1(df: DataFrame, by: list[str], score: str, answerable: Column, answered: Column) -> DataFrame:
    """Recall over answerable golds, precision over answered predictions."""
    g = df.groupBy(*by).agg(F.sum(F.when(answerable, F.col(score)).otherwise(0)).alias("_r"), F.count_if(answerable).alias("_n"), F.sum(F.when(answered & answerable, F.col(score)).otherwise(0)).alias("_p"), F.count_if(answered).alias("_m"), F.avg(score).alias("accuracy"))
    r, p = F.when(F.col("_n") > 0, F.col("_r") / F.col("_n")).otherwise(0.0), F.when(F.col("_m") > 0, F.col("_p") / F.col("_m")).otherwise(0.0)
    g = g.withColumn("recall", r).withColumn("precision", p)
    return g.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)).drop("_r", "_n", "_p", "_m")


def preference_accuracy(df: DataFrame, uid: str, score: str, accuracy: str) -> DataFrame:
    """How often the order of scores agrees with that of accuracies within a
    prompt, pairs weighted by the accuracy difference; 0.5 where all accuracies
    are equal, then the mean over prompts.  With accuracies 0 and 1 the weights
    count pairs of a right and a wrong response: a running count by score order
    replaces the pairs, so a prompt of many responses stays linear."""
    w = W.partitionBy(uid).orderBy(score)
    right = F.col(accuracy).cast("double")
    below = F.coalesce(F.sum(1 - right).over(w.rangeBetween(W.unboundedPreceding, -1)), F.lit(0.0)) if dict(df.dtypes)[score] in ("bigint", "int") else F.sum(1 - right).over(w) - F.sum(1 - right).over(W.partitionBy(uid, score))
    g = df.withColumn("_below", below).groupBy(uid).agg(F.sum(F.when(right > 0, F.col("_below")).otherwise(0.0)).alias("_good"), F.sum(right).alias("_r"), F.sum(1 - right).alias("_w"))
    each = F.when(F.col("_r") * F.col("_w") > 0, F.col("_good") / (F.col("_r") * F.col("_w"))).otherwise(0.5)
    return g.agg(F.avg(each).alias("accuracy"))


def view_consistency(df: DataFrame, key: str, score: str, views: int) -> DataFrame:
    """Share of keys that are right in all of ``views`` views, and of rows."""
    g = df.groupBy(key).agg(F.sum(F.col(score).cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.avg((F.col("s") == views).cast("double")).alias("consistent"), (F.sum("s") / F.sum("n")).alias("accuracy"))


def clue_recovery(df: DataFrame, by: str, long_score: str, clue_score: str) -> DataFrame:
    """min(mean long, mean clue) / mean clue, 0 without clue score."""
    g = df.groupBy(by).agg(F.avg(long_score).alias("l"), F.avg(clue_score).alias("c"))
    return g.select(by, F.when(F.col("c") > 0, F.least("l", "c") / F.col("c")).otherwise(0.0).alias("recovery"))


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return tokens / (seconds * devices)
