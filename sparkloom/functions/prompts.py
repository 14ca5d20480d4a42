"""Prompts filled from columns, frames of videos, rounded arrays, words to count in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text of a four-choice question.
FOUR_CHOICES = "Answer the following multiple choice question. The last line of your response should be of the following format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before answering.\n\n{question}\n\nA) {A}\nB) {B}\nC) {C}\nD) {D}"
# The question to a judge which option an answer means.
OPTION_JUDGE = (
    "You are an AI assistant who will help me to match an answer with several options of a single-choice question. You are provided with a question, several options, and an answer, and you need to find which option is most similar to the answer. "
    "If the meaning of all options are significantly different from the answer, output Z. Your should output a single uppercase character in A, B, C, D (if they are valid options), and Z. \n"
    "Example 1: \nQuestion: What is the main object in image?\nOptions: A. teddy bear B. rabbit C. cat D. dog\nAnswer: a cute teddy bear\nYour output: A\n"
    "Example 2: \nQuestion: What is the main object in image?\nOptions: A. teddy bear B. rabbit C. cat D. dog\nAnswer: Spider\nYour output: Z\n"
    "Example 3: \nQuestion: {question}?\nOptions: {options}\nAnswer: {answer}\nYour output: "
)
# Fixed value: what precedes sampled frames.
FRAMES = "A total of {count} frames are sampled. Their corresponding timestamps are:\n\n{timestamps}\n\n"


def filled(template: str, **values: Column | str) -> Column:
    """A template with {name} in place of each value: a column, or the name of one.  Null
    counts as empty; a name without a value, or a value without a name, is an error."""
    parts = re.split(r"\{([A-Za-z_]+)\}", template)
    names = set(parts[1::2])
    if names != set(values):
        raise ValueError(f"the template has {sorted(names)}, given are {sorted(values)}")
    column = lambda v: F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit(""))
    return F.concat(*[column(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def option_lines(options: Column, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """An array of options as "A. first B. second ..."."""
    marks = F.array(*[F.lit(x) for x in letters])
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.get(marks, i), F.lit(". "), o)), " ")


def clue_frames(clues: Column, count: Column, fps: Column) -> Column:
    """Frames of an array of (start, end) seconds: all of them if there are no more than
    ``count``, else shared by the clues' lengths, one for each at least, from the middles
    of equal parts.  Seconds become frames by rounding halves to even."""
    spans = F.transform(clues, lambda c: F.struct(F.rint(c["start"] * fps).cast("long").alias("a"), F.rint(c["end"] * fps).cast("long").alias("b")))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    none = F.array().cast("array<bigint>")

    def every(x):
        return F.when(x["b"] > x["a"], F.sequence(x["a"], x["b"] - 1)).otherwise(none)

    def some(x):
        share = F.greatest(F.floor(count * ((x["b"] - x["a"]) / total)).cast("long"), F.lit(1).cast("long"))
        part = (x["b"] - x["a"]) / share
        return F.transform(F.sequence(F.lit(0).cast("long"), share - 1), lambda k: (x["a"] + part / 2 + part * k).cast("long"))

    return F.when(count >= total, F.flatten(F.transform(spans, every))).otherwise(F.flatten(F.transform(spans, some)))


def frame_times(frames: Column, fps: Column) -> Column:
    """The sentence with the times of frames, in seconds of one to four digits, halves of
    a digit to even."""
    seconds = F.transform(frames, lambda x: F.regexp_replace(F.bround(x / fps, 4).cast("decimal(24,4)").cast("string"), r"(\.\d+?)0+$", "$1"))
    return filled(FRAMES, count=F.size(frames), timestamps=F.array_join(seconds, ", "))


def rounded_floats(digits: int):
    """A function of an array of doubles: each to ``digits`` by its binary value, halves
    that a double holds exactly to even; null elements stay."""

    def one(values):
        return None if values is None else [None if v is None else round(float(v), digits) for v in values]

    return F.pandas_udf(lambda column: column.map(one, na_action="ignore"), T.ArrayType(T.DoubleType()))


def letter_counts(df: DataFrame, key: str, seed: str = "count", least: int = 3, most: int = 5) -> DataFrame:
    """(key, prompt, answer) for each row: how many of a letter are in a word of letters
    joined by hyphens, and the answer letter by letter.  Length, letter, how often it
    comes (once at least), the other letters and their order are draws of the key's md5:
    the same again for the same key and seed."""

    def draw(what, n):
        h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), what).cast("binary"))
        return F.conv(F.substring(h, 1, 12), 16, 10).cast("long") % n

    letter = lambda code: F.char(97 + code)
    df = df.select(key, (draw(F.lit("n"), most - least + 1) + least).alias("n"), draw(F.lit("t"), 26).alias("t"))
    df = df.withColumn("k", draw(F.lit("k"), F.col("n")) + 1)

    def at(i):
        place = F.concat(F.lit("o"), i.cast("string"))
        other = (F.col("t") + 1 + draw(F.concat(F.lit("x"), i.cast("string")), 25)) % 26
        return F.struct(draw(place, 1 << 40).alias("order"), i.alias("i"), letter(F.when(i <= F.col("k"), F.col("t")).otherwise(other)).alias("c"))

    df = df.withColumn("letters", F.transform(F.array_sort(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), at)), lambda x: x["c"])).withColumn("target", letter(F.col("t")))
    word = F.array_join("letters", "-")
    steps = F.transform("letters", lambda c: F.concat(c, F.when(c == F.col("target"), " = ").otherwise(" != "), F.col("target"), F.lit(".")))
    answer = F.concat(F.array_join(steps, "\n"), F.lit("\n\\boxed{"), F.col("k").cast("string"), F.lit("} "), F.col("target"), F.lit(" in "), word, F.lit("."))
    return df.select(key, F.concat(F.lit("How many "), F.col("target"), F.lit(" are there in word "), word, F.lit("?")).alias("prompt"), answer.alias("answer"))
