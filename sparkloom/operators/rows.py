"""Row builders, strict joins and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def allowed(df: DataFrame, answer: str, values: list[str]) -> DataFrame:
    """Rows whose trimmed, lower-case answer is one of ``values``."""
    return df.where(F.lower(F.trim(answer)).isin(values))


def prefixed(paths: str, base: str) -> Column:
    """An array of paths below ``base``; null and empty ones are null."""
    return F.transform(paths, lambda p: F.when(p != "", F.concat(F.lit(base.rstrip("/") + "/"), p)))


def two_choices(df: DataFrame, answer: str, other: str, a: str = "A") -> DataFrame:
    """Open questions, those without option ``a``, become a choice between their
    answer (A) and ``other`` (B); others stay."""
    is_open = F.col(a).isNull()
    return df.withColumns({"A": F.when(is_open, F.col(answer)).otherwise(F.col(a)), "B": F.when(is_open, F.lit(other)), "answer_letter": F.when(is_open, F.lit("A")).otherwise(F.col(answer))})


def shuffled_choices(choices: str, key: Column, seed: str = "42") -> Column:
    """struct(choices, letter): an array of options in the order of a seeded hash,
    and the letter where its first option, the right one, has gone."""
    order = F.array_sort(F.transform(choices, lambda c: F.struct(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), c)).alias("h"), c.alias("c"))))
    out = F.transform(order, lambda x: x["c"])
    return F.struct(out.alias("choices"), F.chr(F.array_position(out, F.col(choices)[0]) + 64).alias("letter"))


def strictly_synced(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``left`` with ``fields`` taken from ``right`` by ``key``.  A key that comes
    twice on the right, or is missing there, fails the job when it is read."""
    once = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(f).alias("_new_" + f) for f in fields])
    out = left.join(once, key, "left")
    wrong = F.when(F.col("_n").isNull(), F.concat(F.lit("no row for key "), F.col(key).cast("string"))).when(F.col("_n") > 1, F.concat(F.lit("several rows for key "), F.col(key).cast("string")))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))
    return out.where(checked).select(*[F.col("_new_" + c).alias(c) if c in fields else F.col(c) for c in left.columns], *[F.col("_new_" + f).alias(f) for f in fields if f not in left.columns])


def step_tables(base: DataFrame, steps: list[tuple[DataFrame, str]], key: str, value: str) -> DataFrame:
    """``base`` left-joined with each (table, suffix) by ``key``; ``value`` comes
    back as value_suffix."""
    for table, suffix in steps:
        base = base.join(table.select(key, F.col(value).alias(f"{value}_{suffix}")), key, "left")
    return base


def with_shared(df: DataFrame, kind: str, shared: str) -> DataFrame:
    """Rows of the kind ``shared`` given to every other kind, with ``group``."""
    kinds = df.where(F.col(kind) != shared).select(F.col(kind).alias("group")).distinct()
    own = df.where(F.col(kind) != shared).withColumn("group", F.col(kind))
    return own.unionByName(df.where(F.col(kind) == shared).crossJoin(kinds))


def joined_maps(a: str, b: str) -> Column:
    """Two maps as one; a key that both have with different values is an error."""
    clash = F.exists(F.map_keys(a), lambda k: F.coalesce(F.col(b)[k] != F.col(a)[k], F.lit(False)))
    rest = F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k))
    return F.when(clash, F.raise_error(F.lit("maps differ in a key")).cast("map<string,string>")).otherwise(F.map_concat(a, rest))


def first_rows_by_group(df: DataFrame, by: str, order: list[Column], k: int = 2) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def circular_score(df: DataFrame, group: str, said: str, gold: str) -> DataFrame:
    """(group, hit): whether all rotations of a question are answered right; a
    missing answer is wrong."""
    return df.groupBy(group).agg(F.every(F.coalesce(F.col(said) == F.col(gold), F.lit(False))).alias("hit"))


def vanilla_score(df: DataFrame, said: Column, gold: str, by: list[str]) -> DataFrame:
    """(by, n, acc): each question counts for itself; an answer without an option is wrong."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(said == F.col(gold), F.lit(False)).cast("double")).alias("acc"))


def required_subset(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``df``; a row whose key ``known`` lacks fails the query and is named."""
    marked = df.join(known.select(F.col(key).alias("_key"), F.lit(True).alias("_known")).distinct(), F.col(key) == F.col("_key"), "left")
    stray = F.raise_error(F.concat(F.lit(f"{key} is not in the table: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return marked.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(stray.cast(df.schema[key].dataType))).select(df.columns)


def core_metrics(df: DataFrame, source: str, variable: str, metric: str) -> DataFrame:
    """``section`` of each metric name (mean@4, best@8/mean, ...): core for the
    variable acc, or reward where a source has no acc, at the source's largest
    count and of kind mean, maj or best/mean; else aux."""
    n = F.regexp_extract(metric, "@([0-9]+)", 1).cast("int")
    by = W.partitionBy(source)
    named = F.when(F.max((F.col(variable) == "acc").cast("int")).over(by) == 1, "acc").otherwise("reward")
    kind = F.col(metric).startswith("mean") | F.col(metric).startswith("maj") | (F.col(metric).startswith("best") & F.endswith(F.col(metric), F.lit("/mean")))
    core = (F.col(variable) == named) & kind & (n == F.max(n).over(W.partitionBy(source, variable)))
    return df.withColumn("section", F.when(core, "core").otherwise("aux"))


def kl_penalised(scores: str, kl: str, mask: str, beta: float) -> Column:
    """Token rewards: scores minus ``beta`` times the KL of masked tokens."""
    return F.expr(f"transform(arrays_zip({scores}, {kl}, {mask}), x -> x.{scores} - {beta}D * x.{kl} * x.{mask})")


def mask_lengths(attention: str, n_response: Column, action: str | None = None) -> Column:
    """struct(prompt, response, observation): lengths of an attention mask whose
    last ``n_response`` places are the response; with an action mask the response
    tokens outside it are observations."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.size(attention) - n_response
    response = F.slice(attention, n + 1, n_response)
    seen = F.lit(0) if action is None else total(F.zip_with(response, F.slice(action, F.size(action) - n_response + 1, n_response), lambda r, a: r * (1 - a)))
    return F.struct(total(F.slice(attention, F.lit(1), n)).cast("long").alias("prompt"), (total(response) - seen).cast("long").alias("response"), seen.cast("long").alias("observation"))


def stored_or(score: str, computed: Column) -> Column:
    """A score that is there already, else the computed one."""
    return F.coalesce(F.col(score), computed)


def faulty_paths(df: DataFrame, key: str, paths: str, listing: DataFrame) -> DataFrame:
    """(key, path, fault) of references that are absolute, or that ``listing``
    (path) does not hold; equal references of a key are one row."""
    each = df.select(key, F.explode(paths).alias("path")).where("path <> ''").distinct()
    known = listing.select("path").distinct().withColumn("_there", F.lit(True))
    fault = F.when(F.startswith("path", F.lit("/")), "absolute").when(F.col("_there").isNull(), "missing")
    return each.join(known, "path", "left").withColumn("fault", fault).where("fault is not null").select(key, "path", "fault")


def first_existing(df: DataFrame, key: str, path: str, roots: list[str], listing: DataFrame) -> DataFrame:
    """(key, path, found): the first of the path itself and the path below each root
    that ``listing`` (path) holds; null if none."""
    tries = F.array(F.col(path), *[F.concat(F.lit(r.rstrip("/") + "/"), F.col(path)) for r in roots])
    each = df.select(key, F.col(path).alias("path"), F.posexplode(tries).alias("_at", "_try"))
    known = listing.select(F.col("path").alias("_try")).distinct().withColumn("_there", F.lit(True))
    return each.join(known, "_try", "left").groupBy(key, "path").agg(F.min_by("_try", F.when(F.col("_there"), F.col("_at"))).alias("found"))


def cached_or(df: DataFrame, key: str, cache: DataFrame, value: str, missing: Column) -> DataFrame:
    """``df`` with ``value`` looked up in ``cache`` by ``key`` (one row a key), else
    ``missing``.  The optimizer broadcasts a small cache."""
    return df.join(cache.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), missing))


def by_parent(df: DataFrame, key: str, nodes: DataFrame, parent: str, score: str) -> DataFrame:
    """(parent, n, score): rows looked up in ``nodes`` (key, parent) and averaged
    again by parent; rows without a node have a null parent."""
    return df.join(nodes.select(key, parent), key, "left").groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias(score))


def right_at_threshold(df: DataFrame, by: list[str], qid: str, mode: str, score: str, threshold: float) -> DataFrame:
    """Share of questions, among those asked in both modes, with a miou score above
    ``threshold`` whose long_acc answer is right; 0 without such questions."""
    is_miou, is_long = F.col(mode) == "miou", F.col(mode) == "long_acc"
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    each = df.groupBy(*by, qid).agg(some(is_miou).alias("a"), some(is_long).alias("b"), some(is_miou & (F.col(score) > threshold)).alias("x"), some(is_long & (F.col(score) == 1)).alias("y"))
    both, hit = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("x") & F.col("y"))
    return each.groupBy(*by).agg(F.when(both > 0, F.bround(hit / both, 4)).otherwise(0.0).alias("acc"))


def score_sheet(df: DataFrame, category: str, score: str, groups: dict[str, str]) -> DataFrame:
    """(name, value): sums of scores by group of categories (``groups`` maps a
    category to its group, others stand for themselves), then Final Score and
    Final Score Norm, a tenth of it."""
    names = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]) if groups else None
    name = F.col(category) if names is None else F.coalesce(names[F.col(category)], F.col(category))
    sums = df.groupBy(name.alias("name")).agg(F.sum(score).cast("double").alias("value"))
    total = df.agg(F.coalesce(F.sum(score), F.lit(0)).cast("double").alias("t"))
    lines = F.explode(F.array(F.struct(F.lit("Final Score").alias("name"), F.col("t").alias("value")), F.struct(F.lit("Final Score Norm").alias("name"), (F.col("t") / 10).alias("value"))))
    return sums.unionByName(total.select(lines.alias("x")).select("x.*"))


def paired_scores(df: DataFrame, text: str, score: str) -> DataFrame:
    """``df`` with ``pair_score``: where exactly two rows have one text, 1 if both
    have a score other than 0, else 0; other rows and empty texts keep their score."""
    groups = df.where(F.col(text) != "").groupBy(text).agg(F.every(F.col(score) != 0).alias("_both"), F.count(F.lit(1)).alias("_n"))
    pair = F.when(F.col("_n") == 2, F.coalesce(F.col("_both"), F.lit(False)).cast("double")).otherwise(F.col(score))
    return df.join(groups, text, "left").withColumn("pair_score", pair).drop("_both", "_n")


def group_rows(df: DataFrame, prompt: str, n: int) -> DataFrame:
    """Each prompt row ``n`` times, with ``uid`` (SHA-256 of the prompt) and its ``ordinal`` from 0."""
    return df.withColumn("uid", F.sha2(prompt, 256)).withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def with_tools(rows: DataFrame, tools: list[str]) -> DataFrame:
    """Training rows (``curate.rl_rows``) whose extra info says that each tool is
    created with the row's truth, question and source."""
    made = F.struct(F.struct(F.col("reward_model.ground_truth"), F.col("extra_info.question"), F.col("data_source")).alias("create_kwargs"))
    extra = F.col("extra_info").withField("need_tools_kwargs", F.lit(True)).withField("tools_kwargs", F.struct(*[made.alias(t) for t in tools]))
    return rows.withColumn("extra_info", extra)


def adapted(rows: DataFrame, source: str | None = None, system: str | None = None, ability: str | None = None) -> DataFrame:
    """Training rows under another source or ability, or with a system message in
    front of their trimmed question; what is None stays."""
    changes = {c: F.lit(v) for c, v in (("data_source", source), ("ability", ability)) if v is not None}
    if system is not None:
        turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        changes["prompt"] = F.array(turn("system", F.lit(system)), turn("user", F.trim(F.col("extra_info.question"))))
    return rows.withColumns(changes) if changes else rows


def within_length(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows whose prompt has at most ``most`` tokens by ``length``, for example
    ``word_count`` or ``token_count(path)`` of the prompt."""
    return df.where(length <= most)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_count(path: str):
    """A UDF: number of a tokenizer file's tokens of a text, without special ones; null counts 0."""
    import pandas as pd

    @F.pandas_udf(T.IntegerType())
    def count(texts):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(x.ids) for x in found], dtype="int32")

    return count


def submission(df: DataFrame, prediction: str, a: str, letter) -> DataFrame:
    """``submission``: the letter that ``letter(prediction)`` infers where option
    ``a`` is there, else the prediction itself."""
    return df.withColumn("submission", F.when(F.col(a).isNotNull(), letter(F.col(prediction))).otherwise(F.col(prediction)))
