"""Metrics, evaluation reports, balancing and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, metrics, reports
from ..streaming import windows
from .common import RESPONSES, query, r6, responses

QUERIES: dict = {}
LABELLED = "d AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, CASE WHEN d.n_chars > 2000 THEN 'long' ELSE 'short' END AS duration, d.n_chars FROM labels l JOIN documents d USING (doc_id))"


def _labelled(read):
    d = read("documents").select("doc_id", "lang", "source", "n_chars", F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("duration"))
    return read("labels").select("doc_id", "quality", "toxic").join(d, "doc_id")


@query(QUERIES, f"SELECT event_type, {r6('avg(value)')} AS value_mean, {r6('max(value)')} AS value_max, {r6('min(value)')} AS value_min FROM events GROUP BY event_type")
def data_metrics(read):
    return metrics.suite(read("events"), ["value"], ["event_type"])


@query(QUERIES, f"WITH {RESPONSES} SELECT {r6('1 - var_samp(length - price / 2000) / (var_samp(length) + 1e-5)')} AS explained FROM r")
def explained_variance(read):
    return responses(read).agg(metrics.explained_variance(F.col("length"), F.col("price") / 2000).alias("explained"))


@query(QUERIES, """WITH v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS p, min_by(value, event_id) AS v FROM events GROUP BY ALL)
 SELECT user_id, v AS majority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, p) AS rk FROM v) WHERE rk = 1""")
def maj_vote(read):
    return metrics.majority(read("events"), ["user_id"], "event_type", "value", "event_id")


@query(QUERIES, f"""WITH e AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, max(value) AS b, min(value) AS w FROM events GROUP BY ALL)
 SELECT event_type, n, count(*) AS prompts, {r6('avg(m)')} AS mean_at_n, {r6('avg(s)')} AS std_at_n, {r6('avg(b)')} AS best_at_n, {r6('avg(w)')} AS worst_at_n FROM e GROUP BY ALL""")
def validation_metrics(read):
    return metrics.validation(read("events"), "event_type", "user_id", "value")


@query(QUERIES, f"""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT user_id, {r6('sum(value * (pow(r / n::DOUBLE, 4) - pow((r - 1) / n::DOUBLE, 4)))')} AS best_of FROM r GROUP BY user_id""")
def best_of_n(read):
    return metrics.best_of(read("events"), ["user_id"], "value", 4)


@query(QUERIES)
def bootstrap_best_of_n(read):
    return metrics.bootstrap(read("events").select("user_id", "value"), ["user_id"], "value", 4)


@query(QUERIES, f"SELECT event_type, {r6('avg(value)')} AS mean, {r6('quantile_cont(value, 0.5)')} AS p50, {r6('quantile_cont(value, 0.95)')} AS p95 FROM events GROUP BY event_type")
def trace_latency_pcts(read):
    return metrics.latencies(read("events"), ["event_type"], "value")


@query(QUERIES, f"SELECT event_type, count(*) AS n, {r6('quantile_disc(value, 0.5)')} AS p50, {r6('quantile_disc(value, 0.9)')} AS p90, {r6('quantile_disc(value, 0.99)')} AS p99 FROM events GROUP BY event_type")
def nearest_rank_pcts(read):
    return metrics.nearest_ranks(read("events"), ["event_type"], "value")


@query(QUERIES, f"""WITH {LABELLED} SELECT 'Overall' AS level, 'all' AS name, count(*) AS n, {r6('avg(quality)')} AS accuracy FROM d
 UNION ALL SELECT 'lang', lang, count(*), {r6('avg(quality)')} FROM d GROUP BY lang UNION ALL SELECT 'source', source, count(*), {r6('avg(quality)')} FROM d GROUP BY source""")
def acc_report(read):
    return reports.accuracy(_labelled(read), "quality", ["lang", "source"])


@query(QUERIES, f"WITH {LABELLED} SELECT lang, duration, count(*) AS n, {r6('avg(quality)')} AS score FROM d GROUP BY ROLLUP (lang, duration)")
def acc_rollup(read):
    return reports.rolled_up(_labelled(read), "quality", ["lang", "duration"])


@query(QUERIES, f"""WITH {LABELLED}, p AS (SELECT source, coalesce(avg(quality) FILTER (lang = 'en'), 0) AS en, coalesce(avg(quality) FILTER (lang = 'de'), 0) AS de, coalesce(avg(quality) FILTER (lang = 'fr'), 0) AS fr, coalesce(avg(quality) FILTER (lang = 'es'), 0) AS es FROM d GROUP BY source)
 SELECT source, {r6('en')} AS en, {r6('de')} AS de, {r6('fr')} AS fr, {r6('es')} AS es, {r6('(en + de + fr + es) / 4')} AS average FROM p""")
def subject_pivot(read):
    return reports.pivoted(_labelled(read), "source", "lang", ["en", "de", "fr", "es"], "quality")


@query(QUERIES, f"""WITH {LABELLED} SELECT {r6('(SELECT avg(quality) FROM d)')} AS answer_accuracy, {r6('(SELECT avg(m) FROM (SELECT min(quality) AS m FROM d GROUP BY doc_id // 3))')} AS figure_accuracy, {r6('(SELECT avg(m) FROM (SELECT min(quality) AS m FROM d GROUP BY doc_id // 5, lang))')} AS question_accuracy""")
def hallusion_allcorrect(read):
    df = _labelled(read).withColumn("f", F.floor(F.col("doc_id") / 3)).withColumn("q", F.floor(F.col("doc_id") / 5))
    return reports.all_correct(df, "quality", ["f"], ["q", "lang"])


@query(QUERIES, f"""WITH {LABELLED}, p AS (SELECT lang, doc_id // 4 AS k, sum(quality) AS s, count(*) AS n, min(quality) AS b FROM d GROUP BY ALL)
 SELECT lang, {r6('100 * (sum(s) / sum(n) + avg(b))')} AS score FROM p GROUP BY lang""")
def mme_plus(read):
    return reports.paired_score(_labelled(read).withColumn("k", F.floor(F.col("doc_id") / 4)), "lang", "k", "quality")


@query(QUERIES, f"""WITH {LABELLED}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) AS n FROM d GROUP BY lang),
 p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM c)
 SELECT lang, tp, fp, fn, n, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END')} AS f1, {r6('(n - fp - fn) / n::DOUBLE')} AS accuracy FROM p""")
def yorn_f1(read):
    return reports.yes_no_f1(_labelled(read), F.col("quality") == 1, F.col("toxic") == 0, ["lang"])


@query(QUERIES, f"WITH {LABELLED}, g AS (SELECT lang, avg(quality) AS m, sum(quality) AS s, count(*) AS n FROM d GROUP BY lang) SELECT {r6('avg(m)')} AS macro, {r6('sum(s) / sum(n)')} AS micro FROM g")
def macro_micro(read):
    return reports.macro_micro(_labelled(read), "lang", "quality")


@query(QUERIES, f"WITH {LABELLED} SELECT lang, {r6('avg(a)')} AS accuracy, count(*) AS cycles FROM (SELECT doc_id % 4 AS c, lang, avg(quality) AS a FROM d GROUP BY ALL) GROUP BY lang")
def cycle_avg(read):
    return reports.cycles(_labelled(read).withColumn("c", F.col("doc_id") % 4), "c", "lang", "quality")


@query(QUERIES, f"WITH s AS (SELECT event_type, CASE WHEN event_id % 2 = 1 THEN -(value - 50) ELSE value - 50 END AS s FROM events) SELECT event_type, {r6('avg(s)')} AS reward, {r6('avg(CASE WHEN s > 0 THEN 1.0 WHEN s = 0 THEN 0.5 ELSE 0.0 END)')} AS win_rate FROM s GROUP BY event_type")
def wildvision_pref(read):
    return reports.preference(read("events"), ["event_type"], F.col("value") - 50, F.col("event_id") % 2 == 1)


@query(QUERIES, f"WITH t AS (SELECT event_type, value / 200 AS iou, unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS threshold FROM events) SELECT event_type, {r6('threshold')} AS threshold, {r6('avg(CASE WHEN iou >= threshold THEN 1 ELSE 0 END)')} AS accuracy FROM t GROUP BY event_type, threshold")
def acc_at_iou(read):
    return reports.at_thresholds(read("events").withColumn("iou", F.col("value") / 200), ["event_type"], "iou", [0.1, 0.2, 0.3, 0.4, 0.5])


@query(QUERIES, f"WITH {LABELLED}, g AS (SELECT source, lang, avg(quality) AS s FROM d GROUP BY ALL) SELECT source, {r6('max(s) FILTER (lang = $$en$$)')} AS en, {r6('max(s) FILTER (lang = $$es$$)')} AS es, {r6('max(s) FILTER (lang = $$de$$)')} AS de, {r6('max(s) FILTER (lang = $$fr$$)')} AS fr FROM g GROUP BY source")
def leaderboard_pivot(read):
    g = _labelled(read).groupBy("source", "lang").agg(F.avg("quality").alias("s"))
    return reports.leaderboard(g, "source", "lang", ["en", "es", "de", "fr"], "s")


@query(QUERIES, f"WITH {LABELLED} SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM d) s, (SELECT DISTINCT lang FROM d) l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = s.source AND d.lang = l.lang AND d.quality = 0)")
def completeness(read):
    df = _labelled(read)
    return reports.missing(df, df, df.where("quality = 0"), "source", "lang").select("source", "lang")


@query(QUERIES, f"SELECT event_id, {r6('CASE WHEN h > l THEN 100 * (value - l) / (h - l) ELSE 100 END')} AS rescaled FROM events JOIN (SELECT event_type, min(value) AS l, max(value) AS h FROM events GROUP BY event_type) USING (event_type)")
def minmax_rescale(read):
    return reports.rescaled(read("events"), "event_type", "value").select("event_id", "rescaled")


@query(QUERIES, f"WITH {LABELLED}, g AS (SELECT source, lang, sum(quality * n_chars) / sum(n_chars)::DOUBLE AS d FROM d GROUP BY ALL) SELECT lang, {r6('avg(d)')} AS distance, count(*) AS pages FROM g GROUP BY lang")
def weighted_pages(read):
    return reports.weighted_pages(_labelled(read), ["source"], "lang", "quality", "n_chars")


@query(QUERIES, f"""WITH g AS (SELECT l_orderkey AS k, l_returnflag AS f, CASE WHEN avg(l_discount) > 0.05171 THEN 1 ELSE 0 END AS hit FROM lineitem GROUP BY ALL),
 j AS (SELECT a.k, a.hit AS a, n.hit AS n, r.hit AS r FROM g a JOIN g n ON a.k = n.k AND a.f = 'A' AND n.f = 'N' JOIN g r ON r.k = a.k AND r.f = 'R')
 SELECT {r6('avg(a)')} AS a, {r6('avg(n)')} AS n, {r6('avg(r)')} AS r, {r6('avg((a + n + r) / 3.0::DOUBLE)')} AS average, {r6('avg(CASE WHEN a + n + r = 3 THEN 1 ELSE 0 END)')} AS hit_all, {r6('avg(CASE WHEN a + n + r = 0 THEN 1 ELSE 0 END)')} AS miss_all FROM j""")
def rotation_join(read):
    each = [read("lineitem").where(F.col("l_returnflag") == f).groupBy("l_orderkey").agg((F.avg("l_discount") > 0.05171).cast("int").alias(f.lower())) for f in "ANR"]
    return reports.rotations(each, "l_orderkey", ["a", "n", "r"])


# -------------------------------------------------------------------- balancing


def _batches(read):
    return read("events").select(F.floor(F.col("event_id") / 256).alias("batch"), F.col("event_id").alias("pos"), F.ceil("value").alias("length"))


@query(QUERIES)
def balance_kk(read):
    return balance.imbalance(balance.balanced(_batches(read), "batch", "pos", "length", 8), "batch", "length")


@query(QUERIES, f"""WITH RECURSIVE e AS (SELECT event_id // 256 AS batch, row_number() OVER (PARTITION BY event_id // 256 ORDER BY event_id) AS i, CAST(ceil(value) AS BIGINT) AS n FROM events),
 s AS (SELECT DISTINCT batch, 0::BIGINT AS i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS sums FROM e
  UNION ALL SELECT s.batch, s.i + 1, list_transform(s.sums, lambda x, j: CASE WHEN j = list_position(s.sums, list_min(s.sums)) THEN x + e.n ELSE x END) FROM s JOIN e ON e.batch = s.batch AND e.i = s.i + 1),
 f AS (SELECT batch, unnest(arg_max(sums, i)) AS s, max(i) AS n FROM s GROUP BY batch) SELECT batch, min(s) FILTER (s > 0) AS least, max(s) AS largest, {r6('avg(s) FILTER (s > 0)')} AS mean FROM f GROUP BY batch""")
def balance_greedy(read):
    return balance.imbalance(balance.balanced(_batches(read), "batch", "pos", "length", 8, "greedy"), "batch", "length")


@query(QUERIES, "SELECT event_id // 256 AS batch, CAST(least(count(*), ceil(sum(ceil(value)) / 2000.0)) AS BIGINT) AS parts, CAST(sum(ceil(value)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def micro_batches(read):
    out = balance.micro_batches(_batches(read), "batch", "pos", "length", 2000)
    return out.groupBy("batch").agg(F.countDistinct("part").alias("parts"), F.sum("length").alias("tokens"))


# ------------------------------------------- windows (beyond the reference's own)


@query(QUERIES, f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM events GROUP BY ALL")
def ext_tumbling(read):
    return windows.tumbling(read("events"), "ts", "1 hour", ["event_type"], "value")


@query(QUERIES, f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n, {r6('sum(value)')} AS total FROM events, range(2) t(k) GROUP BY 1")
def ext_sliding(read):
    return windows.sliding(read("events"), "ts", "1 hour", "30 minutes", [], "value")


@query(QUERIES, f"""WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM n) SELECT min(ts) AS start, user_id, count(*) AS n, {r6('sum(value)')} AS total FROM s GROUP BY user_id, s""")
def ext_session(read):
    return windows.sessions(read("events"), "ts", "2 hours", ["user_id"], "value")
