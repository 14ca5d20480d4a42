"""Batch operators, curation, advantages and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantage as adv
from ..operators import batch, curate, losses
from .common import RESPONSES, query, r6, responses

QUERIES: dict = {}
EVENTS = "e AS (SELECT user_id AS uid, event_id AS pos, value AS score, event_type AS kind FROM events)"


def _events(read):
    return read("events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("pos"), F.col("value").alias("score"), F.col("event_type").alias("kind"))


# ------------------------------------------------------------------- advantages


@query(QUERIES, f"""WITH {EVENTS},
 a AS (SELECT kind, (score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6) AS x FROM e WINDOW w AS (PARTITION BY uid))
 SELECT kind, count(*) AS n, {r6('avg(x)')} AS advantage_mean, {r6('min(x)')} AS advantage_min, {r6('max(x)')} AS advantage_max FROM a GROUP BY kind""")
def flagship_advantages(read):
    out = adv.grpo(_events(read))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("advantage").alias("advantage_mean"), F.min("advantage").alias("advantage_min"), F.max("advantage").alias("advantage_max"))


def _adv(name, fn, expr, source=RESPONSES, rows="r", cols="uid, pos, score"):
    sql = f"WITH {source} SELECT {cols}, {r6(expr)} AS advantage FROM {rows} WINDOW w AS (PARTITION BY uid)"
    fn.__name__ = name
    query(QUERIES, sql)(fn)


_adv("adv_grpo", lambda read: adv.estimator("grpo")(responses(read)).select("uid", "pos", "score", "advantage"), "(score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6)")
_adv("adv_grpo_nostd", lambda read: adv.grpo(responses(read), normalise=False).select("uid", "pos", "score", "advantage"), "score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END")
_adv("adv_rloo", lambda read: adv.rloo(responses(read)).select("uid", "pos", "score", "advantage"), "CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE score END")
_adv("adv_opo", lambda read: adv.opo(responses(read)).select("uid", "pos", "score", "advantage"), "score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE sum(score * length) OVER w / sum(length) OVER w END")


@query(QUERIES, f"""WITH {EVENTS}, k AS (SELECT *, row_number() OVER o AS rk, lead(score) OVER o AS second, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM e WINDOW o AS (PARTITION BY uid ORDER BY score DESC, pos))
 SELECT uid, pos, {r6('CASE WHEN rk = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END')} AS advantage FROM k""")
def adv_passk(read):
    return adv.grpo_passk(_events(read)).select("uid", "pos", "advantage")


@query(QUERIES, f"""WITH {RESPONSES},
 c AS (SELECT *, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS c FROM r WINDOW w AS (PARTITION BY uid)),
 m AS (SELECT sum(c * length) / (sum(length) + 1e-8) AS mu, sum(length) AS n FROM c),
 v AS (SELECT sum((c - mu) * (c - mu) * length) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM c, m)
 SELECT uid, pos, score, {r6('(c - mu) / sqrt(var + 1e-8)')} AS advantage FROM c, m, v""")
def adv_rfpp_baseline(read):
    return adv.reinforce_pp_baseline(responses(read)).select("uid", "pos", "score", "advantage")


@query(QUERIES, f"WITH {RESPONSES}, b AS (SELECT ln(avg(exp(2.0::DOUBLE * (score - m)))) / 2.0::DOUBLE + any_value(m) AS base FROM r, (SELECT max(score) AS m FROM r)) SELECT uid, pos, score, {r6('score - base')} AS advantage FROM r, b")
def adv_softmean(read):
    return adv.soft_mean_baseline(responses(read), beta=2.0).select("uid", "pos", "score", "advantage")


@query(QUERIES, f"WITH {EVENTS} SELECT pos, row_number() OVER (PARTITION BY pos // 2 ORDER BY score DESC, pos) = 1 AS chosen FROM e")
def dpo_pairs(read):
    return adv.chosen_mask(_events(read)).select("pos", "chosen")


@query(QUERIES, f"""WITH {RESPONSES} SELECT uid, pos, {r6('''CASE WHEN count(*) OVER w > 1 THEN 5.0 * (score - (sum(score) OVER w - score) / (count(*) OVER w - 1)) + (tax - (sum(tax) OVER w - tax) / (count(*) OVER w - 1)) ELSE 5.0 * score + tax END''')} AS advantage FROM r WINDOW w AS (PARTITION BY uid)""")
def adv_prime_rloo(read):
    return adv.multi_source_rloo(responses(read), "uid", {"score": 5.0, "tax": 1.0}).select("uid", "pos", "advantage")


def _tokens(read):
    """Token arrays of embeddings: rewards, and a mask that leaves every seventh
    token out."""
    rewards = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    df = read("embeddings").select(F.col("vec_id").alias("uid"), rewards.alias("rewards"))
    df = df.withColumn("mask", F.transform("rewards", lambda x, i: F.when((i + F.col("uid")) % 7 == 3, 0).otherwise(1)))
    return df.withColumn("values", F.transform("rewards", lambda x: x / 2 + 0.1))


TOKENS = """t0 AS (SELECT vec_id AS uid, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)) AS rewards FROM embeddings),
 t1 AS (SELECT uid, rewards, unnest(rewards) AS r, unnest(range(len(rewards))) AS i FROM t0),
 t AS (SELECT uid, i, r, CASE WHEN (i + uid) % 7 = 3 THEN 0 ELSE 1 END AS m, r / 2 + 0.1::DOUBLE AS v FROM t1)"""


@query(QUERIES, f"""WITH {TOKENS}, s AS (SELECT sum(r * m) / (sum(m) + 1e-8) AS mu, sum(m)::DOUBLE AS n FROM t),
 v AS (SELECT sum((r - mu) * (r - mu) * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM t, s)
 SELECT uid, CAST(i AS INTEGER) AS i, {r6('(r - mu) / sqrt(var + 1e-8)')} AS whitened FROM t, s, v""")
def masked_whiten(read):
    return adv.whiten(_tokens(read), "rewards", "mask").select("uid", F.posexplode("whitened").alias("i", "whitened"))


@query(QUERIES, f"WITH {TOKENS} SELECT uid, CAST(i AS INTEGER) AS i, {r6('sum(r * m) OVER (PARTITION BY uid ORDER BY i DESC)')} AS ret FROM t")
def returns_remax(read):
    return _tokens(read).select("uid", F.posexplode(adv.remax_returns("rewards", "mask")).alias("i", "ret"))


@query(QUERIES, f"""WITH RECURSIVE {TOKENS}, w(uid, i, run, ret) AS (
  SELECT uid, i, r * m, r FROM t WHERE i = 63 UNION ALL SELECT t.uid, t.i, (t.r + 0.9::DOUBLE * w.run) * t.m, t.r + 0.9::DOUBLE * w.run FROM w JOIN t ON t.uid = w.uid AND t.i = w.i - 1)
 SELECT uid, CAST(i AS INTEGER) AS i, {r6('ret')} AS ret FROM w""")
def returns_rfpp(read):
    return _tokens(read).select("uid", F.posexplode(adv.suffix_returns(F.col("rewards"), F.col("mask"), 0.9)).alias("i", "ret"))


@query(QUERIES, f"""WITH RECURSIVE {TOKENS}, w AS (
  SELECT uid, i, r, v, m, 0.0::DOUBLE AS carry, CASE WHEN m = 1 THEN 1 ELSE 1 END AS z, (r - v) * m AS adv, m * r AS ret FROM t WHERE i = 63
  UNION ALL
  SELECT t.uid, t.i, t.r, t.v, t.m, CASE WHEN w.m = 1 THEN w.v ELSE w.carry END, 1,
    (t.r + (CASE WHEN t.m = 1 THEN 0.99::DOUBLE ELSE 1 END) * (CASE WHEN w.m = 1 THEN w.v ELSE w.carry END) - t.v) * t.m + (CASE WHEN t.m = 1 THEN 0.99::DOUBLE * 0.95::DOUBLE ELSE 1 END) * w.adv,
    (CASE WHEN t.m = 1 THEN 0.99::DOUBLE ELSE 1 END) * w.ret + t.m * t.r
  FROM w JOIN t ON t.uid = w.uid AND t.i = w.i - 1)
 SELECT uid, CAST(i AS INTEGER) AS i, {r6('adv')} AS advantage, {r6('ret')} AS ret FROM w""")
def gae(read):
    g = _tokens(read).withColumn("g", adv.gae("rewards", "values", "mask", 0.99, 0.95))
    both = F.arrays_zip(F.col("g.advantages").alias("a"), F.col("g.returns").alias("r"))
    return g.select("uid", F.posexplode(both).alias("i", "z")).select("uid", "i", F.col("z.a").alias("advantage"), F.col("z.r").alias("ret"))


@query(QUERIES, """WITH t AS (SELECT vec_id AS uid, unnest(list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 40) AS BIGINT))) AS id, unnest(range(len(embedding))) AS i FROM embeddings),
 f AS (SELECT uid, min(i) FILTER (id IN (0, 1)) AS f FROM t GROUP BY uid)
 SELECT t.uid, CAST(i AS INTEGER) AS i, CASE WHEN f IS NULL OR i <= f THEN 1 ELSE 0 END AS mask, CASE WHEN f IS NULL THEN i ELSE least(i, f) END AS position FROM t JOIN f USING (uid)""")
def eos_mask_positions(read):
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40))
    df = read("embeddings").select(F.col("vec_id").alias("uid"), ids.alias("ids")).withColumn("mask", adv.until_first_eos(F.col("ids"), [0, 1]))
    both = F.arrays_zip("mask", adv.position_ids("mask").alias("position"))
    return df.select("uid", F.posexplode(both).alias("i", "z")).select("uid", "i", F.col("z.mask").alias("mask"), F.col("z.position").cast("long").alias("position"))


@query(QUERIES, f"""WITH d AS (SELECT date_trunc('hour', ts) AS step, avg(value) / 100 AS kl FROM events GROUP BY 1)
 SELECT step, {r6('0.2::DOUBLE * exp(sum(ln(1 + greatest(least(kl / 0.3::DOUBLE - 1, 0.2::DOUBLE), -0.2::DOUBLE) * 256 / 10000)) OVER (ORDER BY step))')} AS coefficient FROM d""")
def kl_controller(read):
    steps = read("events").groupBy(F.date_trunc("hour", "ts").alias("step")).agg((F.avg("value") / 100).alias("kl"))
    return adv.kl_coefficients(steps, 0.2, 0.3, 10000, 256).select("step", "coefficient")


# ----------------------------------------------------------------------- losses


@query(QUERIES, f"""WITH {TOKENS}, s AS (SELECT uid, sum(r * m) AS s, sum(m)::DOUBLE AS n FROM t GROUP BY uid)
 SELECT {r6('sum(s) / (sum(n) + 1e-8)')} AS token_mean, {r6('avg(s)')} AS seq_sum, {r6('avg(s / n)')} AS seq_mean, {r6('sum(s) / 64')} AS seq_norm FROM s""")
def loss_agg_modes(read):
    df = _tokens(read).select(losses.masked_sum("rewards", "mask").alias("s"), losses.mask_size("mask").alias("n"))
    modes = {"token_mean": "token-mean", "seq_sum": "seq-mean-token-sum", "seq_mean": "seq-mean-token-mean", "seq_norm": "seq-mean-token-sum-norm"}
    return df.agg(*[losses.loss_aggregate(F.col("s"), F.col("n"), m, 64).alias(k) for k, m in modes.items()])


@query(QUERIES, f"""WITH {TOKENS}, s AS (SELECT uid, sum(m)::DOUBLE AS n, sum(r * m) / (sum(m) + 1e-8) AS mu FROM t GROUP BY uid)
 SELECT s.uid, {r6('any_value(mu)')} AS mean, {r6('sum((r - mu) * (r - mu) * m) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1)')} AS var FROM t JOIN s USING (uid) GROUP BY s.uid""")
def masked_stats(read):
    return _tokens(read).select("uid", losses.masked_mean("rewards", "mask").alias("mean"), losses.masked_var("rewards", "mask").alias("var"))


@query(QUERIES, f"""WITH {RESPONSES}, p AS (SELECT uid, exp(greatest(least(score - tax, 20.0::DOUBLE), -20.0::DOUBLE) * 10) AS ratio, (length - 25) / 10 AS a FROM r),
 q AS (SELECT uid, a, -a * ratio AS l1, -a * greatest(least(ratio, 1.2::DOUBLE), 0.8::DOUBLE) AS l2 FROM p)
 SELECT uid, {r6('avg(CASE WHEN a < 0 THEN least(greatest(l1, l2), -a * 3) ELSE greatest(l1, l2) END)')} AS loss, {r6('avg(CASE WHEN l2 > l1 THEN 1 ELSE 0 END)')} AS clip, {r6('avg(CASE WHEN greatest(l1, l2) > -a * 3 AND a < 0 THEN 1 ELSE 0 END)')} AS clip_low FROM q GROUP BY uid""")
def ppo_clip_loss(read):
    t = losses.ppo_terms((F.col("score") - F.col("tax")) * 10, (F.col("length") - 25) / 10)
    return responses(read).groupBy("uid").agg(F.avg(t["loss"]).alias("loss"), F.avg(t["clipped"]).alias("clip"), F.avg(t["clipped_low"]).alias("clip_low"))


@query(QUERIES, f"WITH {RESPONSES} SELECT uid, {r6('avg(0.5::DOUBLE * greatest((score - length / 500) * (score - length / 500), (greatest(least(score, tax + 0.02::DOUBLE), tax - 0.02::DOUBLE) - length / 500) * (greatest(least(score, tax + 0.02::DOUBLE), tax - 0.02::DOUBLE) - length / 500)))')} AS loss FROM r GROUP BY uid")
def value_loss(read):
    return responses(read).groupBy("uid").agg(F.avg(losses.value_loss(F.col("score"), F.col("tax"), F.col("length") / 500, 0.02)).alias("loss"))


@query(QUERIES, f"""WITH {RESPONSES}, d AS (SELECT uid, score * 30 - tax * 30 AS d FROM r)
 SELECT uid, {r6('avg(d)')} AS k1, {r6('avg(abs(d))')} AS k_abs, {r6('avg(0.5::DOUBLE * d * d)')} AS k2, {r6('avg(greatest(least(exp(greatest(least(-d, 20), -20)) - greatest(least(-d, 20), -20) - 1, 10), -10))')} AS k3 FROM d GROUP BY uid""")
def kl_penalties(read):
    names = {"k1": "k1", "k_abs": "abs", "k2": "k2", "k3": "k3"}
    return responses(read).groupBy("uid").agg(*[F.avg(losses.kl_penalty(F.col("score") * 30, F.col("tax") * 30, k)).alias(n) for n, k in names.items()])


@query(QUERIES, f"WITH {RESPONSES} SELECT uid, pos, length, {r6('least(-(length - 30) / 20.0::DOUBLE * 0.5::DOUBLE, 0)')} AS penalty FROM r")
def overlong_penalty(read):
    return responses(read).select("uid", "pos", "length", losses.overlong_penalty(F.col("length"), 50, 20, 0.5).alias("penalty"))


@query(QUERIES, f"""WITH {TOKENS}, z AS (SELECT uid, max(r) AS t FROM t GROUP BY uid), p AS (SELECT t.uid, r, exp(r - z.t) / sum(exp(r - z.t)) OVER (PARTITION BY t.uid) AS p FROM t JOIN z USING (uid))
 SELECT uid, {r6('-sum(p * ln(p))')} AS entropy FROM p GROUP BY uid""")
def entropy_from_logits(read):
    return _tokens(read).select("uid", losses.entropy("rewards").alias("entropy"))


@query(QUERIES, """WITH t AS (SELECT vec_id AS uid, list_transform(embedding[1:(vec_id % 12) + 1], lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT)) AS ids FROM embeddings),
 p AS (SELECT uid, CASE WHEN len(ids) > 8 THEN ids[len(ids) - 7:] ELSE list_concat(list_transform(range(8 - len(ids)), lambda x: 0), ids) END AS l,
   CASE WHEN len(ids) > 8 THEN list_concat(ids[1:4], ids[len(ids) - 3:]) ELSE list_concat(ids, list_transform(range(8 - len(ids)), lambda x: 0)) END AS m FROM t)
 SELECT uid, array_to_string(l, ',') AS left_padded, array_to_string(m, ',') AS middle_cut FROM p""")
def pad_truncate(read):
    ids = F.transform(F.slice("embedding", F.lit(1), (F.col("vec_id") % 12 + 1).cast("int")), lambda x: F.floor(F.abs(x.cast("double")) * 1000))
    df = read("embeddings").select(F.col("vec_id").alias("uid"), ids.alias("ids"))
    return df.select("uid", F.array_join(losses.padded(F.col("ids"), 8, 0, "left", "left"), ",").alias("left_padded"), F.array_join(losses.padded(F.col("ids"), 8, 0, "right", "middle"), ",").alias("middle_cut"))


# ---------------------------------------------------------------------- filters


@query(QUERIES, f"WITH {RESPONSES} SELECT uid, pos, score FROM (SELECT *, stddev_pop(score) OVER w AS sd, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY uid)) WHERE sd > 0 OR n = 1")
def dapo_group_filter(read):
    return curate.group_variance_filter(responses(read), "uid", "score").select("uid", "pos", "score")


@query(QUERIES, f"""WITH {RESPONSES}, g AS (SELECT uid, avg(score) BETWEEN 0.04 AND 0.06 AND max(length) < 49 AS good FROM r GROUP BY uid),
 k AS (SELECT * FROM g ORDER BY good DESC, uid LIMIT (SELECT CAST(floor(count(*) / 2.0) AS BIGINT) FROM g)) SELECT uid, pos, score, good FROM r JOIN k USING (uid)""")
def prime_filter_downsample(read):
    """Scores are added in the order of the table, as the twin adds them in one thread."""
    at = F.struct("_metadata.file_name", "_metadata.row_index").alias("at")
    return curate.accuracy_band(responses(read, at), "uid", "score", "length", 0.04, 0.06, 50, 2.0, "at").select("uid", "pos", "score", "good")


#: Sample rules over documents; ``curate.QUESTION_RULES`` are those of the question filter.
RULES = [("markup_noise", r"[|]{1}"), ("shouting", "[A-Z]{4,}!!"), ("license_line", "(?i)licensed? under"), ("short_question", r"^\S{0,40}$")]
RULE_CASE = "CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN regexp_matches(text, '[|]{1}') THEN 'markup_noise' WHEN regexp_matches(text, '[A-Z]{4,}!!') THEN 'shouting' WHEN regexp_matches(text, '(?i)licensed? under') THEN 'license_line' WHEN regexp_matches(text, '^\\S{0,40}$') THEN 'short_question' ELSE 'keep' END"


@query(QUERIES, f"SELECT doc_id, {RULE_CASE} AS reason FROM documents")
def rule_filter(read):
    return read("documents").select("doc_id", curate.classify(F.col("text"), RULES).alias("reason"))


@query(QUERIES, f"SELECT {RULE_CASE} AS reason, count(*) AS n FROM documents GROUP BY 1")
def rule_counts(read):
    return curate.counts(read("documents").select(curate.classify(F.col("text"), RULES).alias("reason")))


@query(QUERIES, f"SELECT doc_id, reason, rank FROM (SELECT doc_id, reason, row_number() OVER (PARTITION BY reason ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM (SELECT doc_id, {RULE_CASE} AS reason FROM documents)) WHERE rank <= 5")
def audit_sample(read):
    return curate.audit_sample(read("documents").select("doc_id", curate.classify(F.col("text"), RULES).alias("reason")), "reason", "doc_id", 5).select("doc_id", "reason", F.col("rank").cast("long").alias("rank"))


@query(QUERIES, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def dedup_first(read):
    return curate.first_seen(read("documents"), ["text", "lang"], "doc_id").select("doc_id")


@query(QUERIES, "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_returnflag) = 1)")
def conflict_removal(read):
    return curate.without_conflicts(read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(QUERIES, "SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256(source || '/' || doc_id), 1, 8) AS BIGINT) % 100 < 5 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(read):
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return read("documents").select("doc_id", F.when(curate.hash_bucket(key) < 5, "val").otherwise("train").alias("split"))


@query(QUERIES, "SELECT pos, CASE WHEN row_number() OVER (PARTITION BY uid ORDER BY pos) > 1 THEN kind || ':' || uid ELSE uid END AS uid, uid AS source_uid FROM (SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS uid, event_type AS kind FROM events)")
def uid_rename(read):
    df = _events(read).withColumn("uid", F.col("uid").cast("string"))
    return curate.rename_repeats(df, "uid", F.col("kind"), ["pos"]).select("pos", "uid", "source_uid")


@query(QUERIES, "SELECT count(*) FILTER (l AND r) AS shared, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only FROM (SELECT doc_id, bool_or(s = 1) AS l, bool_or(s = 2) AS r FROM (SELECT doc_id, 1 AS s FROM documents UNION ALL SELECT doc_id, 2 FROM labels UNION ALL SELECT page_id * 7, 2 FROM pages) GROUP BY doc_id)")
def set_diff(read):
    right = read("labels").select("doc_id").union(read("pages").select(F.col("page_id") * 7))
    return curate.key_difference(read("documents"), right, "doc_id")


@query(QUERIES, "SELECT p_partkey AS uid, unnest(['chosen', 'rejected']) AS kind, unnest([p_name, p_type]) AS response FROM part")
def preference_unpivot(read):
    return curate.unpivot_preferences(read("part").withColumnRenamed("p_partkey", "uid"), ["uid"], "p_name", "p_type")


@query(QUERIES, "SELECT o_orderkey AS pos, CASE WHEN o_orderkey < CAST(floor(0.75 * (SELECT count(*) FROM orders)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM orders")
def percent_split(read):
    df = read("orders").select(F.col("o_orderkey").alias("pos"))
    return curate.head_split(df, "pos", df.count(), 0.75)


@query(QUERIES, "SELECT 'docs' AS data_source, text AS question, CAST(quality AS VARCHAR) AS ground_truth, 'quality' AS ability, doc_id AS idx FROM documents JOIN labels USING (doc_id)")
def rl_rows(read):
    df = read("documents").join(read("labels"), "doc_id")
    out = curate.rl_rows(df, F.lit("docs"), F.col("text"), F.col("quality").cast("string"), F.lit("quality"), F.col("doc_id"), F.lit("train"))
    return out.select("data_source", F.col("prompt")[0]["content"].alias("question"), F.col("reward_model.ground_truth").alias("ground_truth"), "ability", F.col("extra_info.index").alias("idx"))


@query(QUERIES, "SELECT p_partkey AS id, len(list_filter([p_name, p_brand, p_type], lambda x: x IS NOT NULL)) AS n, p_brand AS b FROM part")
def choices_map(read):
    m = curate.choices_map({"A": F.col("p_name"), "B": F.col("p_brand"), "C": F.col("p_type")})
    return read("part").select(F.col("p_partkey").alias("id"), F.size(m).cast("long").alias("n"), m["B"].alias("b"))


@query(QUERIES, """WITH p AS (SELECT p_partkey AS g, [p_name, p_brand, p_type] AS o, p_size % 3 AS a FROM part), e AS (SELECT *, unnest([0, 1, 2]) AS k FROM p)
 SELECT g AS g_index, g + k * 1000000 AS idx, array_to_string(list_concat(o[k + 1:], o[1:k]), '|') AS options, CAST((a - k + 3) % 3 AS BIGINT) AS answer FROM e""")
def circular_expand(read):
    df = read("part").select(F.col("p_partkey").alias("idx"), F.array("p_name", "p_brand", "p_type").alias("options"), (F.col("p_size") % 3).alias("answer"))
    return curate.circular_expand(df, "idx", "options", "answer", 1_000_000).select("g_index", "idx", F.array_join("options", "|").alias("options"), "answer")


@query(QUERIES, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(read):
    return read("documents").join(read("labels"), "doc_id", "left_anti").select("doc_id")


@query(QUERIES, "SELECT d.doc_id, l.quality AS answer FROM documents d JOIN labels l USING (doc_id)")
def answer_join(read):
    return read("documents").join(read("labels"), "doc_id").select("doc_id", F.col("quality").alias("answer"))


@query(QUERIES, "SELECT a.p_partkey AS id, b.p_name AS image FROM part a LEFT JOIN part b ON a.p_size = b.p_partkey")
def image_pointer_selfjoin(read):
    a, b = read("part").select("p_partkey", "p_size"), read("part").select(F.col("p_partkey").alias("at"), "p_name")
    return a.join(b, F.col("p_size") == F.col("at"), "left").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("image"))


# -------------------------------------------------------------------- positions


def _orders(read):
    return read("orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v"))


@query(QUERIES, "SELECT o_orderkey AS pos, o_custkey AS v FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000 AND (o_orderkey - 100) % 7 = 0")
def slice_step(read):
    return batch.slice_rows(_orders(read), 100, 5000, 7)


@query(QUERIES, "SELECT o_orderkey * 3 + k AS pos, o_custkey AS v FROM orders, range(3) t(k)")
def repeat_interleave(read):
    return batch.repeat(_orders(read), 3).select("pos", "v")


@query(QUERIES, "SELECT k * (SELECT count(*) FROM orders) + o_orderkey AS pos, o_custkey AS v FROM orders, range(3) t(k)")
def repeat_tile(read):
    df = _orders(read)
    return batch.repeat(df, 3, interleave=False, total=F.lit(df.count())).select("pos", "v")


@query(QUERIES, "SELECT o_orderkey AS pos, o_custkey AS v, CAST(k AS INTEGER) AS copy FROM orders, range(1, 4) t(k) WHERE k <= o_custkey % 4")
def sample_repeat(read):
    return batch.repeat_by(_orders(read), F.col("v") % 4).select("pos", "v", "copy")


@query(QUERIES, "WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS pos, o_custkey AS v FROM orders UNION ALL SELECT n + o_orderkey, o_custkey FROM orders, n WHERE o_orderkey < (7 - n % 7) % 7")
def pad_divisor(read):
    df = _orders(read)
    return batch.pad_to_multiple(df, 7, df.count()).select("pos", "v")


@query(QUERIES, "SELECT o_orderkey AS pos, o_orderkey // CAST(ceil((SELECT count(*) FROM orders) / 7.0) AS BIGINT) AS chunk FROM orders")
def chunk(read):
    df = _orders(read)
    return batch.chunk(df, 7, df.count()).select("pos", "chunk")


@query(QUERIES, "SELECT o_orderkey // 5 AS pos, string_agg(o_custkey, ',' ORDER BY o_orderkey) AS vs FROM orders GROUP BY 1")
def fold(read):
    return batch.fold(_orders(read), 5, "v").select("pos", F.array_join("v", ",").alias("vs"))


@query(QUERIES, "SELECT vec_id * 4 + k AS pos, array_to_string(list_transform(embedding[k * 16 + 1:k * 16 + 16], lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',') AS vs FROM embeddings, range(4) t(k)")
def unfold_columns(read):
    df = read("embeddings").select(F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("v"))
    return batch.unfold_columns(df, 4, "v").select("pos", F.array_join("v", ",").alias("vs"))


@query(QUERIES, "WITH n AS (SELECT max(o_orderkey) AS m FROM orders) SELECT m - o_orderkey AS pos, o_custkey AS v FROM orders, n")
def reorder(read):
    df = _orders(read)
    last = df.agg(F.max("pos")).first()[0]
    return batch.reorder(df, df.select(F.col("pos").alias("old"), (F.lit(last) - F.col("pos")).alias("new"))).select("pos", "v")


@query(QUERIES, "SELECT o_orderkey AS pos, o_custkey AS v, o_totalprice AS price FROM orders")
def positional_union(read):
    return batch.positional_union(_orders(read), read("orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v"), F.col("o_totalprice").alias("price"))).select("pos", "v", "price")


@query(QUERIES, "WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS pos, o_custkey AS v FROM orders UNION ALL SELECT n + c_custkey, c_custkey FROM customer, n")
def concat_batches(read):
    a, b = _orders(read), read("customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("v"))
    return batch.concat([a, b], [a.count(), b.count()])
