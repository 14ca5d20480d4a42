"""Scores of evaluation tasks by the source of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import maths_match
from .text import last_boxed

# Sources of maths and of letter tasks, and the pattern of a letter answer.
MATHS_SOURCES = ["Maxwell-Jia/AIME_2024", "opencompass/cnmo2024_en", "opencompass/cnmo2024_zh"]
LETTER_SOURCES = ["Idavidrein/gpqa"]
LETTER = r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?"


def letter_score(text: Column, gold: Column) -> Column:
    """1.0 where the first "Answer: X" names the gold letter as it stands, else 0.0."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), LETTER, 1)
    return F.coalesce((found == gold).cast("double"), F.lit(0.0))


def maths_score(text: Column, gold: Column) -> Column:
    """1.0 where what the last box holds equals the gold answer as an expression, else the
    whole text does, else 0.0."""
    said = F.coalesce(last_boxed(text), text)
    return F.coalesce(maths_match(said, gold).cast("double"), F.lit(0.0))


def task_score(source: Column, text: Column, gold: Column) -> Column:
    """The score of each row by its source; another source fails the query."""
    unknown = F.raise_error(F.concat(F.lit("no task of "), F.coalesce(source, F.lit("null")))).cast("double")
    return F.when(source.isin(MATHS_SOURCES), maths_score(text, gold)).when(source.isin(LETTER_SOURCES), letter_score(text, gold)).otherwise(unknown)
