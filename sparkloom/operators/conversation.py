"""Conversations: role merging, observation wrapping, placeholders, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nested import is_object

OPEN, CLOSE = "<tool_response>", "</tool_response>"


def wrap_observation(text: Column) -> Column:
    """Tagged once; a text that is tagged already stays."""
    t = F.trim(text)
    return F.when(F.startswith(t, F.lit(OPEN)) & F.endswith(t, F.lit(CLOSE)), text).otherwise(F.concat(F.lit(OPEN + "\n"), text, F.lit("\n" + CLOSE)))


def mapped_roles(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Tool messages become wrapped user messages; other roles than user,
    assistant and system are an error."""
    out = F.when(F.col(role) == "tool", "user").when(F.col(role).isin("user", "assistant", "system"), F.col(role)).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))))
    return df.withColumn(text, F.when(F.col(role) == "tool", wrap_observation(F.col(text))).otherwise(F.col(text))).withColumn(role, out)


def merge_same_role(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Neighbouring messages of one role become one, joined by a line feed;
    blanks at the joints and empty sides go (gaps and islands)."""
    w = W.partitionBy(conv).orderBy(turn)
    island = F.sum(F.when(F.lag(role).over(w) == F.col(role), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("island", island).groupBy(conv, "island", role)
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("x"))))
    joined = F.array_join(F.filter(F.transform(rows, lambda r: F.trim(r["x"])), lambda x: x != ""), "\n")
    return out.agg(F.min(turn).cast("long").alias(turn), F.count(F.lit(1)).alias("n_merged"), joined.alias(text)).drop("island")


def with_placeholders(df: DataFrame, images: Column, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The first message gets the image tags that the conversation lacks."""
    have = df.groupBy(conv).agg(F.sum(F.regexp_count(F.col(text), F.lit("<image>"))).alias("_have"), F.min(turn).alias("_first"))
    lack = F.greatest(images - F.col("_have"), F.lit(0)).cast("int")
    out = df.join(have, conv)
    return out.withColumn(text, F.when(F.col(turn) == F.col("_first"), F.concat(F.repeat(F.lit("<image>\n"), lack), F.col(text))).otherwise(F.col(text))).drop("_have", "_first")


def validate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Shape of each conversation: errors in a fixed order, joined by a bar."""
    n = F.row_number().over(W.partitionBy(conv).orderBy(turn)) - 1
    wrong = F.col(role) != F.when(F.col("n") % 2 == 0, "user").otherwise("assistant")
    g = df.withColumn("n", n).groupBy(conv).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.max(F.when(F.col("n") == 0, F.col(role))).alias("first"),
        F.count_if(wrong).alias("n_wrong"),
        F.count_if((F.col(role) == "assistant") & F.contains(F.col(text), F.lit("<tool_call>"))).alias("n_calls"),
        F.max_by(F.when(F.col(role) == "assistant", F.coalesce(text, F.lit(""))).otherwise(""), "n").alias("last"),
    )
    errors = F.array(
        F.when(F.col("first") != "user", "first_not_user"),
        F.when(F.col("n_wrong") > 0, "roles_do_not_alternate"),
        F.when(F.col("n_messages") % 2 == 1, "odd_length"),
        F.when(F.col("n_calls") == 0, "no_tool_call"),
        F.when(~F.contains(F.col("last"), F.lit("<answer>")), "no_final_answer"),
    )
    return g.select(conv, "n_messages", F.array_join(F.array_compact(errors), "|").alias("errors"))


def tool_calls(text: Column, known: list[str]) -> Column:
    """Array of struct(name, error) for each tagged call of a message: text that
    is no JSON object, an unknown name, arguments that are no object."""
    body = F.regexp_extract_all(text, F.lit("(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))

    def one(x):
        name, args = F.get_json_object(x, "$.name"), F.get_json_object(x, "$.arguments")
        error = F.when(~is_object(x), "not_an_object").when(name.isNull() | ~name.isin(known), "unsupported_tool").when(~is_object(args), "arguments_not_an_object")
        return F.struct(name.alias("name"), error.alias("error"))

    return F.transform(body, one)
