"""Training rows of known datasets, and rewards as the managers give them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .losses import overlong_penalty, reward_on_last

# Source, ability, instruction behind the question, system message and tool
# of each dataset.
SOURCES = {
    "gsm8k": {"source": "openai/gsm8k", "instruction": 'Let\'s think step by step and output the final answer after "####".'},
    "math": {"source": "DigitalLearningGmbH/MATH-lighteval", "instruction": "Let's think step by step and output the final answer within \\boxed{}."},
    "gsm8k_tool": {
        "source": "openai/gsm8k",
        "instruction": "Let's think step by step and output the final answer after `####`.",
        "system": "You are a math expert. You are given a question and you need to solve it step by step. Reasoning step by step before any tool call. You should use the `calc_gsm8k_reward` tool after step by step solving the question, before generate final answer at least once and refine your answer if necessary. Put your final answer in the format of `#### <answer>`.",
        "tool": "calc_gsm8k_reward",
    },
}


def _after_mark(answer: Column) -> Column:
    found = tx.gsm8k(answer)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no number behind #### in: "), F.coalesce(answer, F.lit("null")))).cast("string"))


def _in_box(answer: Column) -> Column:
    found = tx.last_boxed(answer)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no box in: "), F.coalesce(answer, F.lit("null")))).cast("string"))


def dataset_rows(df: DataFrame, kind: str, split: str, question: str = "question", answer: str = "answer", index: str = "index") -> DataFrame:
    """Rows (data_source, prompt, ability, reward_model, extra_info) of ``kind``: the question
    with its instruction, behind a system message where the dataset has tools, and the
    truth from the answer (behind ####, or in the last box); an answer without one fails
    the query."""
    if kind not in SOURCES:
        raise ValueError(f"no rows of {kind}: {', '.join(SOURCES)}")
    known = SOURCES[kind]
    truth = (_in_box if kind == "math" else _after_mark)(F.col(answer))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    turns = [turn("user", F.concat(F.col(question), F.lit(" " + known["instruction"])))]
    if "system" in known:
        turns.insert(0, turn("system", F.lit(known["system"])))
    df = df.withColumn("_truth", truth)
    extra = [F.lit(split).alias("split"), F.col(index).alias("index")]
    if kind != "math":
        extra += [F.col(answer).alias("answer"), F.col(question).alias("question")]
    if "tool" in known:
        extra += tool_arguments(known["tool"], F.col("_truth"))
    return df.select(F.lit(known["source"]).alias("data_source"), F.array(*turns).alias("prompt"), F.lit("math").alias("ability"), F.struct(F.lit("rule").alias("style"), F.col("_truth").alias("ground_truth")).alias("reward_model"), F.struct(*extra).alias("extra_info"))


def tool_arguments(tool: str, truth: Column) -> list[Column]:
    """What a row says of its tools: that it has arguments, and the truth as the one that
    makes the tool."""
    made = F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs"))
    return [F.lit(True).alias("need_tools_kwargs"), F.create_map(F.lit(tool), made).alias("tools_kwargs")]


def with_code_tool(rows: DataFrame, tool: str = "code_interpreter") -> DataFrame:
    """Rows of a dataset whose extra_info gets the arguments of a code tool."""
    extra = F.col("extra_info")
    for column, name in zip(tool_arguments(tool, F.col("reward_model.ground_truth")), ("need_tools_kwargs", "tools_kwargs"), strict=True):
        extra = extra.withField(name, column)
    return rows.withColumn("extra_info", extra)


def chat_rows(df: DataFrame, source: str, split: str, messages: str = "messages", tools: str = "tools", index: str = "index") -> DataFrame:
    """Rows of dialogues with tools for supervised training."""
    return df.select(F.lit(source).alias("data_source"), F.col(messages).alias("messages"), F.col(tools).alias("tools"), F.lit(False).alias("enable_thinking"), F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"))


# ------------------------------------------------------------------ reward managers

#: Managers by name: functions (df, score column, mask column, options) -> extra columns
#: and what is added to the score.
MANAGERS: dict[str, Callable[..., Column]] = {}


def register_manager(name: str):
    """Decorator for a function of (length, options) that gives what a response's length
    adds to its score; a second function of one name is an error."""

    def add(fn):
        if MANAGERS.get(name, fn) is not fn:
            raise ValueError(f"manager {name} is registered already")
        MANAGERS[name] = fn
        return fn

    return add


@register_manager("naive")
def _naive(length: Column, **options) -> Column:
    return F.lit(0.0)


@register_manager("dapo")
def _dapo(length: Column, most: int | None = None, buffer: int | None = None, factor: float = 1.0, **options) -> Column:
    """Responses that come into the last ``buffer`` of ``most`` tokens lose up to ``factor``."""
    if buffer is None:
        return F.lit(0.0)
    if most is None:
        raise ValueError("a buffer needs the most tokens")
    return overlong_penalty(length, most, buffer, factor)


def rewarded(df: DataFrame, score: Column, mask: str, manager: str = "naive", stored: str | None = None, env: str | None = None, **options) -> DataFrame:
    """``df`` with ``acc``, the score of the response, ``added``, what its manager adds for
    its length, and ``rewards``, an array with their sum on the last valid token of
    ``mask``.  Rewards of the environment (an array ``env``) are added token by token; a
    row that has rewards ``stored`` keeps them.  A score may be a number or a boolean; a
    row without a valid token has no reward but the environment's."""
    if manager not in MANAGERS:
        raise ValueError(f"no manager {manager}: {', '.join(MANAGERS)}")
    length = F.aggregate(F.col(mask), F.lit(0), lambda a, x: a + x.cast("int"))
    df = df.withColumn("acc", score.cast("double")).withColumn("added", MANAGERS[manager](length, **options).cast("double"))
    own = reward_on_last(F.col(mask), F.col("acc") + F.col("added"))
    if env is not None:
        own = F.zip_with(own, F.col(env), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    return df.withColumn("rewards", F.coalesce(F.col(stored), own) if stored is not None else own)
