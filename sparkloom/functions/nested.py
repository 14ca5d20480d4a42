"""JSON within texts, and nested JSON as flat or ordered.

Recursion has no built-in form, so these are Arrow-batched UDFs over strings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dumped(x) -> str:
    return json.dumps(x, ensure_ascii=False)


def objects_in(text: str | None) -> list[str]:
    """The JSON objects that stand in a text, one after the other; an object within
    another is part of it, and a brace that opens none is passed over."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while text and (at := text.find("{", at)) >= 0:
        try:
            found, at = decoder.raw_decode(text, at)
            out.append(_dumped(found))
        except ValueError:
            at += 1
    return out


def flat_pairs(text: str | None) -> list[tuple[str, str | None]]:
    """(path, value) of all leaves of a JSON text in their order: keys are joined by
    dots, list items have their list's path.  No JSON: no pairs."""
    out = []

    def walk(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for v in value:
                walk(v, path)
        else:
            out.append((path, value if value is None or isinstance(value, str) else _dumped(value)))

    try:
        walk(json.loads(text or ""), "")
    except ValueError:
        return []
    return out


def ordered(text: str | None) -> str | None:
    """A JSON text with the keys of every object in order; other texts stay."""
    try:
        return json.dumps(json.loads(text or ""), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return text


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(texts):
    return texts.map(objects_in, na_action=None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def flattened(texts):
    return texts.map(lambda t: [{"key": k, "value": v} for k, v in flat_pairs(t)], na_action=None)


@F.pandas_udf(T.StringType())
def sorted_json(texts):
    return texts.map(ordered, na_action="ignore")


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else; null is none.  Spark's own JSON
    functions pass over what follows the first value and allow single quotes, so the text
    must also be the first of two items of a list, and parse without those."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    strict = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()
    return F.coalesce(F.json_object_keys(text).isNotNull() & alone & strict, F.lit(False))


def normalised_columns(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON object column as columns in its place; a text that is no
    object of this schema gives nulls."""
    parsed = F.from_json(column, schema)
    return df.withColumn("_fields", parsed).select(*[c for c in df.columns if c != column], "_fields.*")


def verdict(text: Column) -> Column:
    """1.0 if a judge's final result, what it boxes, or else its whole text holds
    Yes; otherwise 0.0.  A null stays null."""
    # The marks around a judge's final result.
    rest = F.element_at(F.split(text, "<最终结果>"), -1)
    rest = F.element_at(F.split(rest, r"<\\最终结果>"), 1)
    rest = F.element_at(F.split(F.element_at(F.split(rest, r"boxed\{"), -1), r"\}"), 1)
    whole = F.when(F.contains(text, F.lit("<最终结果>")) | F.contains(text, F.lit("boxed")), rest).otherwise(text)
    return F.contains(whole, F.lit("Yes")).cast("double")


def judged(df: DataFrame, key: str, verdicts: DataFrame, answer: str) -> DataFrame:
    """``df`` with ``judge`` read from the table of a judge's answers (one row a key);
    rows that were not judged have null."""
    return df.join(verdicts.select(key, verdict(F.col(answer)).alias("judge")), key, "left")
