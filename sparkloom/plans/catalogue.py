"""The query catalogue: one entry for each operator, with its SQL twin.

Roles of the tables: lineitem rows are responses (order: prompt, line number:
position, discount: score, quantity: length), events are rewards and traces,
embeddings are per-token arrays, conversations are messages, documents and
labels are questions with truths, benchmark items are gold answers.  Doubles are
rounded to six digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_answers, catalogue_batch, catalogue_checks, catalogue_columns, catalogue_mixed, catalogue_more, catalogue_puzzles, catalogue_reports, catalogue_scores, catalogue_sources, catalogue_texts

_PARTS = (catalogue_batch, catalogue_scores, catalogue_reports, catalogue_more, catalogue_answers, catalogue_checks, catalogue_texts, catalogue_sources, catalogue_columns, catalogue_mixed, catalogue_puzzles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-relative advantages of events as rewards, by event type."""
    return queries()["flagship_advantages"](spark, sf_dir)


def queries() -> dict:
    out = {}
    for part in _PARTS:
        out |= {name: fn for name, (fn, _) in part.QUERIES.items()}
    return out


def oracles() -> dict[str, str]:
    out = {}
    for part in _PARTS:
        out |= {name: sql for name, (_, sql) in part.QUERIES.items() if sql}
    return out
