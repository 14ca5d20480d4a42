"""Further breakdowns of evaluation results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breakdowns as bd
from .common import query, r6

QUERIES: dict = {}
STEPS = "s AS (SELECT event_id AS id, value > 20 AS a, value % 3 < 2 AS b, event_id % 5 < 3 AS m FROM events)"


@query(QUERIES, f"""WITH {STEPS}, t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (NOT (a AND b) AND NOT m) AS ik, count(*) FILTER (a AND b AND NOT m) AS ig, count(*) FILTER (m AND (a OR b)) AS ml, count(*) FILTER (m AND a AND b) AS ms,
 count(*) FILTER (m AND NOT (a OR b)) AS rl, count(*) FILTER (m AND NOT (a AND b)) AS rs FROM s)
 SELECT {r6('ik / n')} AS insufficient, {r6('ig / n')} AS inadequate, {r6('ml / n')} AS mastery_loose, {r6('ms / n')} AS mastery_strict, {r6('rl / (rl + ml)::DOUBLE')} AS rote_loose, {r6('rs / (rs + ms)::DOUBLE')} AS rote_strict FROM t""")
def step_mastery(read):
    df = read("events").select((F.col("value") > 20).alias("a"), (F.col("value") % 3 < 2).alias("b"), (F.col("event_id") % 5 < 3).alias("m"))
    return bd.step_mastery(df, ["a", "b"], "m")


@query(QUERIES, f"WITH n AS (SELECT count(*) // 5 AS w FROM events) SELECT least(event_id // w, 4) AS part, {r6('100 * avg(value)')} AS score, {r6('stddev_pop(100 * avg(value)) OVER ()')} AS spread FROM events, n GROUP BY 1")
def positional_groups(read):
    df = read("events")
    return bd.positional_groups(df, "event_id", "value", df.count())


@query(QUERIES, f"""WITH c AS (SELECT event_id // 4 AS k, max(CASE WHEN value > 20 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 0) AS a, max(CASE WHEN value > 20 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 1) AS b,
 max(CASE WHEN value > 20 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 2) AS c, max(CASE WHEN value > 20 THEN 1 ELSE 0 END) FILTER (event_id % 4 = 3) AS d FROM events GROUP BY 1)
 SELECT {r6('avg((a + b + c + d) / 4)')} AS acc, {r6('avg((a * b + c * d) / 2)')} AS q_acc, {r6('avg((a * c + b * d) / 2)')} AS i_acc, {r6('avg(a * b * c * d)')} AS g_acc FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""")
def paired_blocks(read):
    df = read("events").select(F.floor(F.col("event_id") / 4).alias("k"), F.floor(F.col("event_id") % 4 / 2).alias("q"), (F.col("event_id") % 2).alias("i"), (F.col("value") > 20).alias("s"))
    return bd.paired_blocks(df, "k", "q", "i", "s")


@query(QUERIES, "WITH g AS (SELECT user_id, upper(left(event_type, 1)) AS l, count(*) AS c FROM events GROUP BY ALL), t AS (SELECT *, max(c) OVER (PARTITION BY user_id) AS m FROM g) SELECT user_id, string_agg(l, '' ORDER BY l) AS letters FROM t WHERE c = m GROUP BY user_id")
def most_frequent_letters(read):
    return bd.most_frequent(read("events").withColumn("l", F.upper(F.substring("event_type", 1, 1))), "user_id", "l")


@query(QUERIES, f"SELECT event_type, {r6('(count(*) FILTER (value > 50 AND user_id % 3 <> 0) + 1e-9) / (count(*) FILTER (user_id % 3 <> 0) + 1e-9)')} AS accuracy FROM events GROUP BY event_type")
def smoothed_accuracy(read):
    return read("events").groupBy("event_type").agg(bd.smoothed_accuracy(F.col("value") > 50, F.col("user_id") % 3 != 0).alias("accuracy"))


@query(QUERIES, f"SELECT lang, source, count(*) FILTER (contains(text, '$$$') OR contains(text, '!!')) AS failed, {r6('avg(CASE WHEN contains(text, $x$$$$$x$) OR contains(text, $x$!!$x$) THEN 1 ELSE 0 END)')} AS share FROM documents GROUP BY ALL")
def failure_scan(read):
    return bd.failures(read("documents"), ["lang", "source"], "text", ["$$$", "!!"])


@query(QUERIES, f"SELECT user_id, {r6('max_by(value, event_id)')} AS value FROM events GROUP BY user_id")
def rank_merge(read):
    return bd.last_writer(read("events"), "user_id", "value", "event_id")


@query(QUERIES, f"""WITH e AS (SELECT event_type, CASE WHEN value > 30 THEN 1 ELSE 0 END AS s, user_id % 4 <> 0 AS can, event_id % 5 <> 0 AS did FROM events),
 g AS (SELECT event_type, sum(s) FILTER (can) / count(*) FILTER (can)::DOUBLE AS r, coalesce(sum(s) FILTER (can AND did), 0) / count(*) FILTER (did)::DOUBLE AS p, avg(s) AS a FROM e GROUP BY event_type)
 SELECT event_type, {r6('a')} AS accuracy, {r6('r')} AS recall, {r6('p')} AS precision, {r6('CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END')} AS f1 FROM g""")
def asymmetric_f1(read):
    df = read("events").withColumn("s", (F.col("value") > 30).cast("int"))
    return bd.asymmetric_f1(df, ["event_type"], "s", F.col("user_id") % 4 != 0, F.col("event_id") % 5 != 0)


@query(QUERIES, f"""WITH e AS (SELECT user_id AS uid, value AS s, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS a FROM events),
 p AS (SELECT x.uid, count(*) FILTER (x.s > y.s) AS good, count(*) AS n FROM e x JOIN e y ON x.uid = y.uid AND x.a = 1 AND y.a = 0 GROUP BY x.uid),
 u AS (SELECT DISTINCT uid FROM e) SELECT {r6('avg(CASE WHEN n > 0 THEN good / n::DOUBLE ELSE 0.5 END)')} AS accuracy FROM u LEFT JOIN p USING (uid)""")
def preference_accuracy(read):
    df = read("events").select(F.col("user_id").alias("uid"), F.col("value").alias("s"), F.col("event_type").isin("click", "view").cast("int").alias("a"))
    return bd.preference_accuracy(df, "uid", "s", "a")


@query(QUERIES, f"WITH g AS (SELECT event_id // 4 AS k, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS s, count(*) AS n FROM events GROUP BY 1) SELECT {r6('avg(CASE WHEN s = 4 THEN 1 ELSE 0 END)')} AS consistent, {r6('sum(s) / sum(n)')} AS accuracy FROM g")
def view_consistency(read):
    df = read("events").select(F.floor(F.col("event_id") / 4).alias("k"), (F.col("value") > 10).alias("s"))
    return bd.view_consistency(df, "k", "s", 4)


@query(QUERIES, f"WITH g AS (SELECT event_type, avg(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS l, avg(CASE WHEN value > 40 THEN 1 ELSE 0 END) AS c FROM events GROUP BY 1) SELECT event_type, {r6('CASE WHEN c > 0 THEN least(l, c) / c ELSE 0 END')} AS recovery FROM g")
def clue_recovery(read):
    df = read("events").select("event_type", (F.col("value") > 60).cast("int").alias("l"), (F.col("value") > 40).cast("int").alias("c"))
    return bd.clue_recovery(df, "event_type", "l", "c")
