"""Small operators on rows, arrays and prompts, each with a twin that computes it anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, prompts
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import balance, batch, breakdowns, datasets, losses, reports
from ..operators import rows as rw
from .common import query, r6

QUERIES: dict = {}


def _orders(read):
    return read("orders").select(F.col("o_orderkey").alias("pos"), "o_custkey", "o_orderstatus", "o_totalprice")


# -------------------------------------------------------------------------- rows


@query(QUERIES, f"SELECT o_orderkey AS pos, o_custkey AS customer, {r6('o_totalprice')} AS o_totalprice, o_orderstatus AS status FROM orders")
def batch_columns(read):
    """Columns chosen, taken out and renamed, then put together again by position."""
    df = batch.rename(batch.project(_orders(read), ["pos", "o_custkey", "o_orderstatus", "o_totalprice"]), {"o_custkey": "customer", "o_orderstatus": "status"})
    taken, rest = batch.pop(df, ["pos", "status"])
    return batch.positional_union(df.select("pos", *rest.columns), taken)


@query(QUERIES, "WITH w AS (SELECT o_orderkey AS pos, o_orderkey * 7 % (SELECT count(*) FROM orders) AS old FROM orders WHERE o_orderkey % 3 = 0) SELECT w.pos, o_custkey, o_orderstatus FROM w JOIN orders ON o_orderkey = w.old")
def picked_rows(read):
    """Rows by a list of positions, some more than once."""
    df = _orders(read)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    wanted = df.where("pos % 3 = 0").crossJoin(n).select(F.col("pos").alias("index"), (F.col("pos") * 7 % F.col("n")).alias("at"))
    return batch.pick(df, wanted).select("pos", "o_custkey", "o_orderstatus")


@query(QUERIES, """WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS pos, o_custkey FROM orders UNION ALL SELECT n + k, o_custkey FROM orders, n, range(5) r(k) WHERE o_orderkey = n - 1
 UNION ALL SELECT n + 5 + k, o_custkey FROM orders, n, range(2) r(k) WHERE o_orderkey = 0""")
def padded_edges(read):
    """The last row five times more, then the first one twice."""
    df = _orders(read).select("pos", "o_custkey")
    n = df.count()
    return batch.pad_edge(batch.pad_edge(df, 5, n), 2, n + 5, first=True)


@query(QUERIES, "SELECT o_orderkey AS pos, o_custkey FROM orders WHERE o_orderkey % 8 = 3")
def rank_shards(read):
    return batch.rank_shard(_orders(read), 3, 8).select("pos", "o_custkey")


@query(QUERIES, "SELECT o_orderkey AS pos, o_custkey FROM orders")
def reversed_order(read):
    """Rows moved by a permutation and back by its reverse."""
    df = _orders(read).select("pos", "o_custkey")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    there = df.crossJoin(n).select(F.col("pos").alias("old"), (F.col("n") - 1 - F.col("pos")).alias("new"))
    return batch.reorder(batch.reorder(df, there), batch.reverse_permutation(there)).select("pos", "o_custkey")


@query(QUERIES, """WITH q AS (SELECT item_id, '  ' || text || ' ' AS q FROM benchmark) SELECT item_id, 'other' AS data_source, 'system' AS first_role, 'Think.' AS first, 'user' AS second_role, trim(q) AS second, 'maths' AS ability FROM q""")
def adapted_rows(read):
    """Training rows under another source and ability, with a system message."""
    df = read("benchmark").select("item_id", F.lit("own").alias("data_source"), F.lit("x").alias("ability"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"), F.struct(F.concat(F.lit("  "), "text", F.lit(" ")).alias("question")).alias("extra_info"))
    out = rw.adapted(df, source="other", system="Think.", ability="maths")
    m = F.col("prompt")
    return out.select("item_id", "data_source", m[0]["role"].alias("first_role"), m[0]["content"].alias("first"), m[1]["role"].alias("second_role"), m[1]["content"].alias("second"), "ability")


@query(QUERIES, "SELECT o_orderkey, o_custkey FROM orders")
def subset_assertion(read):
    """Orders, every one of a known customer; a stray one would fail the query."""
    known = read("customer").select(F.col("c_custkey").alias("o_custkey"))
    return rw.required_subset(read("orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query(QUERIES, f"SELECT l_returnflag, count(*) AS n, {r6('avg((coalesce(chr(CAST(65 + l_linenumber % 4 AS INTEGER)) = chr(CAST(65 + l_suppkey % 4 AS INTEGER)), false))::INTEGER)')} AS acc FROM lineitem GROUP BY l_returnflag")
def vanilla_accuracy(read):
    df = read("lineitem").select("l_returnflag", F.char(65 + F.col("l_linenumber") % 4).alias("said"), F.char(65 + F.col("l_suppkey") % 4).alias("gold"))
    return rw.vanilla_score(df, F.col("said"), "gold", ["l_returnflag"])


# ----------------------------------------------------------------------- reports


def _scale(value, wide):
    return f"""WITH v AS (SELECT c_mktsegment AS seg, c_custkey, {value} AS v FROM customer), g AS (SELECT seg, min(v) AS lo, max(v) AS hi FROM v GROUP BY seg), w AS (SELECT max(hi - lo) * {wide}::DOUBLE AS w FROM g)
 SELECT c_custkey, {r6("(v - CASE WHEN (lo + hi) / 2 + w / 2 < 100 THEN (lo + hi) / 2 - w / 2 ELSE 100 - w END) / w * 100")} AS scaled FROM v JOIN g USING (seg), w"""


@query(QUERIES, _scale("c_acctbal / 100", "1.25"))
def scaled_scores(read):
    """Scores of all groups on one scale, as charts show them."""
    return reports.shared_scale(read("customer").withColumn("score", F.col("c_acctbal") / 100), "c_mktsegment", "score").select("c_custkey", "scaled")


@query(QUERIES, _scale("ln(c_acctbal / 100 + 20)", "1.005"))
def scaled_logs(read):
    return reports.shared_scale(read("customer").withColumn("score", F.col("c_acctbal") / 100 + 20), "c_mktsegment", "score", log=True).select("c_custkey", "scaled")


@query(QUERIES, f"SELECT l_returnflag, {r6('sum(l_quantity) / (sum(l_extendedprice) / 1000 * 8)')} AS throughput FROM lineitem GROUP BY l_returnflag")
def device_throughput(read):
    g = read("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("tokens"), (F.sum("l_extendedprice") / 1000).alias("seconds"))
    return g.select("l_returnflag", breakdowns.throughput(F.col("tokens"), F.col("seconds"), 8).alias("throughput"))


@query(QUERIES, f"""WITH s AS (SELECT o_custkey % 50 AS batch, o_orderkey % 4 AS part, sum(o_custkey) AS s FROM orders GROUP BY ALL) SELECT batch, min(s)::BIGINT AS least, max(s)::BIGINT AS largest, {r6('avg(s)')} AS mean FROM s GROUP BY batch""")
def part_imbalance(read):
    parts = read("orders").select((F.col("o_custkey") % 50).alias("batch"), (F.col("o_orderkey") % 4).alias("part"), F.col("o_custkey").alias("length"))
    return balance.imbalance(parts, "batch", "length")


# ------------------------------------------------------------------------ arrays

_IDS = """t AS (SELECT vec_id AS uid, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 40) AS BIGINT)) AS ids, len(embedding) AS n, vec_id % 20 AS pad FROM embeddings)"""


def _ids(read):
    """Token ids with some places of padding in front."""
    df = read("embeddings").select(F.col("vec_id").alias("uid"), F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40)).alias("ids"), (F.col("vec_id") % 20).alias("pad"))
    return df.withColumn("mask", F.transform("ids", lambda x, i: F.when(i < F.col("pad"), 0).otherwise(1)))


@query(QUERIES, f"WITH {_IDS} SELECT uid, array_to_string(ids[pad + 1:], ',') AS ids FROM t")
def left_padding(read):
    return _ids(read).select("uid", F.array_join(losses.without_left_padding(F.col("ids"), F.col("mask")).cast("array<string>"), ",").alias("ids"))


@query(QUERIES, f"""WITH {_IDS} SELECT uid, array_to_string(list_transform(range(n), lambda i: CASE WHEN i >= 40 THEN 0 WHEN i < 5 + uid % 7 - 1 OR i = least(5 + uid % 7 + 10, n) - 1 THEN 0 ELSE 1 END), '') AS mask FROM t""")
def sft_masks(read):
    """Loss masks: the prompt but its last token, the response's last token and padding out."""
    df = read("embeddings").select(F.col("vec_id").alias("uid"), F.transform("embedding", lambda x, i: F.when(i < 40, 1).otherwise(0)).alias("mask"))
    return df.select("uid", F.array_join(losses.sft_loss_mask(F.col("mask"), (5 + F.col("uid") % 7).cast("int"), F.lit(10)).cast("array<string>"), "").alias("mask"))


@query(QUERIES, f"""WITH {_IDS}, r AS (SELECT uid, unnest(range(n)) AS i, 30 + uid % 20 AS last FROM t) SELECT uid, i::INTEGER AS i, {r6('CASE WHEN i = last - 1 THEN uid / 100.0::DOUBLE ELSE 0 END')} AS reward FROM r""")
def last_token_rewards(read):
    df = read("embeddings").select(F.col("vec_id").alias("uid"), F.transform("embedding", lambda x, i: F.when(i < 30 + F.col("vec_id") % 20, 1).otherwise(0)).alias("mask"))
    return df.select("uid", F.posexplode(losses.reward_on_last(F.col("mask"), F.col("uid") / 100.0)).alias("i", "reward"))


@query(QUERIES, f"""WITH w AS (SELECT a.item_id, string_split(a.text, ' ') AS a, string_split(b.text, ' ') AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2),
 c AS (SELECT item_id, a, b, list_concat(a[1:CAST(item_id % 5 AS BIGINT)], b[CAST(item_id % 5 AS BIGINT) + 1:]) AS x FROM w), n AS (SELECT item_id, greatest(len(a), len(x)) AS size, list_filter(range(1, greatest(len(a), len(x)) + 1), lambda i: a[i] IS DISTINCT FROM x[i]) AS off FROM c)
 SELECT item_id, {r6("CASE WHEN len(off) = 0 THEN size ELSE off[1] - 1 END / size::DOUBLE")} AS ratio FROM n""")
def prefix_ratios(read):
    """Common beginnings of word lists."""
    b = read("benchmark").select(F.col("item_id").alias("g"), F.split("text", " ").alias("b"))
    df = read("benchmark").select("item_id", F.split("text", " ").alias("a")).join(b, F.col("item_id") - F.col("item_id") % 2 == F.col("g"))
    k = (F.col("item_id") % 5).cast("int")
    mixed = F.concat(F.slice("a", F.lit(1), k), F.slice("b", k + 1, F.size("b")))
    return df.select("item_id", sim.prefix_ratio(F.col("a"), mixed).alias("ratio"))


@query(QUERIES, """SELECT vec_id AS uid, vec_id % 4 AS count, CASE WHEN vec_id % 4 > 0 THEN vec_id || ',0,' || (vec_id + 2) || ',3' END AS box, CASE WHEN vec_id % 4 > 0 THEN round((vec_id % 7) / 10.0, 1)::DOUBLE END AS confidence FROM embeddings""")
def segment_groups(read):
    """Boxes of a segment with the first one picked."""
    box = lambda k: F.array(F.col("vec_id") + k, F.lit(0).cast("long"), F.col("vec_id") + 2 + k, F.lit(3).cast("long"))
    df = read("embeddings").select("vec_id", F.slice(F.array(box(0), box(1), box(2)), F.lit(1), (F.col("vec_id") % 4).cast("int")).alias("boxes"), F.slice(F.array(F.round((F.col("vec_id") % 7) / 10.0, 1), F.lit(0.1), F.lit(0.2)), F.lit(1), (F.col("vec_id") % 4).cast("int")).alias("sure"))
    g = df.select("vec_id", geometry.segment_group("boxes", "sure").alias("g"))
    return g.select(F.col("vec_id").alias("uid"), "g.count", F.array_join(F.col("g.selected_box").cast("array<string>"), ",").alias("box"), F.col("g.selected_confidence").alias("confidence"))


@query(QUERIES, f"""WITH c AS (SELECT vec_id AS uid, list_transform(embedding[1:12], lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings),
 p AS (SELECT i, j, k FROM range(4) a(i), range(4) b(j), range(4) d(k) WHERE i <> j AND i <> k AND j <> k)
 SELECT uid, {r6("min(c[i + 1] + c[4 + j + 1] + c[8 + k + 1])")} AS cost FROM c, p GROUP BY uid""")
def cheapest_assignment(read):
    """Three rows to three of four columns at the least cost; the twin tries all."""

    @F.pandas_udf("double")
    def cost(values):
        def one(v):
            m = [[float(x) for x in v[4 * r : 4 * r + 4]] for r in range(3)]
            return sum(m[r][c] for r, c in enumerate(sim.assignment(m)))

        return values.map(one)

    return read("embeddings").select(F.col("vec_id").alias("uid"), cost(F.transform("embedding", lambda x: x.cast("double"))).alias("cost"))


@query(QUERIES, "SELECT vec_id AS uid, array_to_string(list_transform(embedding[1:4], lambda x: round(CAST(x AS DOUBLE), 4)), ',') AS box FROM embeddings")
def rounded_boxes(read):
    """Boxes with four digits."""
    return read("embeddings").select(F.col("vec_id").alias("uid"), F.array_join(F.transform(prompts.rounded_floats(4)(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))), lambda x: F.when(x.cast("string") == "-0.0", "-0.0").otherwise(F.regexp_replace(x.cast("decimal(12,4)").cast("string"), r"(\.\d+?)0+$", "$1"))), ",").alias("box"))


# ------------------------------------------------------------------------- texts


@query(QUERIES, r"SELECT item_id, replace(regexp_replace(replace(trim(t), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS text FROM (SELECT item_id, ' ' || replace(text, '.', ' [title]') || ' [header] x  y [substeps]z' AS t FROM benchmark)")
def cleaned_endings(read):
    t = F.concat(F.lit(" "), F.replace("text", F.lit("."), F.lit(" [title]")), F.lit(" [header] x  y [substeps]z"))
    return read("benchmark").select("item_id", tx.hellaswag_clean(t).alias("text"))


@query(QUERIES, """WITH t AS (SELECT doc_id, left(text, 30) AS g, repeat('<answer>x</answer>', CAST(doc_id % 14 AS INTEGER)) || CASE WHEN doc_id % 3 < 2 THEN '<answer>' || left(text, 30) || CASE WHEN doc_id % 3 = 1 THEN ' other' ELSE '' END || '</answer>' ELSE '' END AS t FROM documents WHERE text IS NOT NULL),
 a AS (SELECT *, doc_id % 14 + (doc_id % 3 < 2)::INTEGER AS tags, CASE WHEN doc_id % 3 = 0 THEN g WHEN doc_id % 3 = 1 THEN g || ' other' WHEN doc_id % 14 > 0 THEN 'x' END AS said FROM t),
 s AS (SELECT doc_id, said IS NULL AS none, tags, trim(regexp_replace(regexp_replace(regexp_replace(lower(said), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(regexp_replace(lower(g), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS hit FROM a)
 SELECT doc_id, CASE WHEN none OR NOT hit THEN 0.0 WHEN tags > 10 THEN 0.25 ELSE 1.0 END::DOUBLE AS score FROM s""")
def tag_spam(read):
    """Exact matches that lose three quarters of their score for more than ten tags."""
    gold = F.substring("text", 1, 30)
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<answer>"), gold, F.lit("</answer>"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<answer>"), gold, F.lit(" other</answer>"))).otherwise("")
    text = F.concat(F.repeat(F.lit("<answer>x</answer>"), (F.col("doc_id") % 14).cast("int")), tail)
    return read("documents").where("text is not null").select("doc_id", tx.em_with_penalty(text, F.array(gold)).alias("score"))


@query(QUERIES, """SELECT doc_id, NOT (lang = 'en') AND doc_id % 2 = 0 AS chinese, lower(left(text, 50)) || ' ABC!~ 12' AS half FROM documents WHERE text IS NOT NULL""")
def wide_signs(read):
    """Chinese characters told, full-width signs made plain."""
    wide = F.concat(F.lower(F.substring("text", 1, 50)), F.lit("　ＡＢＣ！～　１２"))
    chinese = F.when((F.col("lang") != "en") & (F.col("doc_id") % 2 == 0), F.concat("text", F.lit("中"))).otherwise(F.col("text"))
    return read("documents").where("text is not null").select("doc_id", tx.has_cjk(chinese).alias("chinese"), tx.half_width(wide).alias("half"))


@query(QUERIES, """SELECT c_nationkey, string_agg('Doc ' || k || ' (Title: ' || c_name || ') ' || c_mktsegment, chr(10) ORDER BY k) AS text FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) GROUP BY c_nationkey""")
def passage_texts(read):
    """Passages found for a question as numbered documents."""
    rows = read("customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rs"))
    rows = rows.select("c_nationkey", F.transform("rs", lambda r: r["c_name"]).alias("titles"), F.transform("rs", lambda r: r["c_mktsegment"]).alias("texts"))
    return rows.select("c_nationkey", tx.passages("titles", "texts").alias("text"))


# ----------------------------------------------------------------------- prompts

_HEAD = "Answer the following multiple choice question. The last line of your response should be of the following format: ''Answer: $LETTER'' (without quotes) where LETTER is one of ABCD. Think step by step before answering."
_JUDGE = prompts.OPTION_JUDGE.split("{question}")[0].replace("'", "''").replace("\n", "' || chr(10) || '")


@query(QUERIES, f"""SELECT item_id, '{_HEAD}' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'A) ' || item_id || chr(10) || 'B) ' || (item_id + 1) || chr(10) || 'C) ' || chr(10) || 'D) ' || left(text, 5) AS prompt,
 md5('{_JUDGE}' || text || '?' || chr(10) || 'Options: A. ' || item_id || ' B. ' || left(text, 5) || chr(10) || 'Answer: ' || item_id || chr(10) || 'Your output: ') AS judge FROM benchmark""")
def filled_prompts(read):
    """Prompts of four-choice questions and of a judge, filled from columns."""
    b = read("benchmark")
    four = prompts.filled(prompts.FOUR_CHOICES, question="text", A="item_id", B=F.col("item_id") + 1, C=F.lit(None), D=F.substring("text", 1, 5))
    options = prompts.option_lines(F.array(F.col("item_id").cast("string"), F.substring("text", 1, 5)))
    judge = prompts.filled(prompts.OPTION_JUDGE, question="text", options=options, answer="item_id")
    return b.select("item_id", four.alias("prompt"), F.md5(judge.cast("binary")).alias("judge"))


@query(QUERIES, """WITH c AS (SELECT event_id, event_id % 50 AS a1, event_id % 50 + 1 + event_id % 7 AS b1, 100 + event_id % 9 AS a2, 100 + event_id % 9 + 2 AS b2, 4 + event_id % 60 AS n, 2 AS fps FROM events),
 f AS (SELECT *, (b1 - a1) * fps AS d1, (b2 - a2) * fps AS d2 FROM c), p AS (SELECT *, d1 + d2 AS d, greatest(1, CAST(floor(n * (d1::DOUBLE / (d1 + d2))) AS BIGINT)) AS k1, greatest(1, CAST(floor(n * (d2::DOUBLE / (d1 + d2))) AS BIGINT)) AS k2 FROM f),
 l AS (SELECT event_id, CASE WHEN n >= d THEN list_concat(range(a1 * fps, b1 * fps), range(a2 * fps, b2 * fps)) ELSE list_concat(list_transform(range(k1), lambda k: CAST(floor(a1 * fps + d1::DOUBLE / k1 / 2 + d1::DOUBLE / k1 * k) AS BIGINT)), list_transform(range(k2), lambda k: CAST(floor(a2 * fps + d2::DOUBLE / k2 / 2 + d2::DOUBLE / k2 * k) AS BIGINT))) END AS frames FROM p)
 SELECT event_id, array_to_string(frames, ',') AS frames, 'A total of ' || len(frames) || ' frames are sampled. Their corresponding timestamps are:' || chr(10) || chr(10) || array_to_string(list_transform(frames, lambda x: CAST(x / 2.0::DOUBLE AS VARCHAR)), ', ') || chr(10) || chr(10) AS said FROM l""")
def sampled_frames(read):
    """Frames shared by the clues of a video, with the sentence of their times."""
    e = F.col("event_id")
    span = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    clues = F.array(span(e % 50, e % 50 + 1 + e % 7), span(100 + e % 9, 102 + e % 9))
    df = read("events").select("event_id", prompts.clue_frames(clues, 4 + e % 60, F.lit(2.0)).alias("f"))
    return df.select("event_id", F.array_join(F.col("f").cast("array<string>"), ",").alias("frames"), prompts.frame_times(F.col("f"), F.lit(2.0)).alias("said"))


_DRAW = lambda what, n: f"CAST('0x' || substr(md5('count:' || c_custkey || ':' || {what}), 1, 12) AS BIGINT) % {n}"


@query(QUERIES, rf"""WITH a AS (SELECT c_custkey, {_DRAW("'n'", 3)} + 3 AS n, {_DRAW("'t'", 26)} AS t FROM customer), b AS (SELECT *, {_DRAW("'k'", "n")} + 1 AS k FROM a),
 l AS (SELECT c_custkey, n, t, k, i, {_DRAW("'o' || i", 1 << 40)} AS o, chr(CAST(97 + CASE WHEN i <= k THEN t ELSE (t + 1 + {_DRAW("'x' || i", 25)}) % 26 END AS INTEGER)) AS c, chr(CAST(97 + t AS INTEGER)) AS g FROM b, range(1, 6) r(i) WHERE i <= n),
 w AS (SELECT c_custkey, any_value(g) AS g, any_value(k) AS k, string_agg(c, '-' ORDER BY o, i) AS word, string_agg(c || CASE WHEN c = g THEN ' = ' ELSE ' != ' END || g || '.', chr(10) ORDER BY o, i) AS steps FROM l GROUP BY c_custkey)
 SELECT c_custkey, 'How many ' || g || ' are there in word ' || word || '?' AS prompt, steps || chr(10) || '\boxed{{' || k || '}} ' || g || ' in ' || word || '.' AS answer FROM w""")
def letter_counts(read):
    """Questions how many of a letter a word has, drawn by key."""
    return prompts.letter_counts(read("customer"), "c_custkey")


# ---------------------------------------------------------- rows of datasets, rewards



@query(QUERIES, f"""WITH k AS (SELECT item_id, text, kind FROM benchmark, (VALUES ('gsm8k'), ('math'), ('gsm8k_tool')) v(kind))
 SELECT item_id, kind, CASE kind WHEN 'math' THEN 'DigitalLearningGmbH/MATH-lighteval' ELSE 'openai/gsm8k' END AS data_source, CASE kind WHEN 'math' THEN item_id::VARCHAR ELSE item_id || '000' END AS truth,
   CASE kind WHEN 'gsm8k_tool' THEN 2 ELSE 1 END AS turns, text || CASE kind WHEN 'gsm8k' THEN ' Let''s think step by step and output the final answer after "####".' WHEN 'math' THEN ' Let''s think step by step and output the final answer within {chr(92)}boxed{{}}.' ELSE ' Let''s think step by step and output the final answer after `####`.' END AS asked,
   CASE kind WHEN 'gsm8k_tool' THEN 'calc_gsm8k_reward=' || item_id || '000' WHEN 'math' THEN 'code_interpreter=' || item_id ELSE '' END AS tools FROM k""")
def dataset_rows(read):
    """Training rows of three datasets, one with a tool of its own and one with a code tool
    added."""
    b, out = read("benchmark"), None
    for kind in ("gsm8k", "math", "gsm8k_tool"):
        answer = F.concat(F.lit("so \\boxed{1} or \\boxed{"), "item_id", F.lit("}.")) if kind == "math" else F.concat(F.lit("we get #### "), "item_id", F.lit(",000 in all"))
        rows = datasets.dataset_rows(b.select(F.col("item_id").alias("index"), F.col("text").alias("question"), answer.alias("answer")), kind, "train")
        rows = datasets.with_code_tool(rows) if kind == "math" else rows
        tools = F.lit("")
        if kind != "gsm8k":
            tools = F.array_join(F.transform(F.map_entries("extra_info.tools_kwargs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["create_kwargs"]["ground_truth"])), ",")
        one = rows.select(F.col("extra_info.index").alias("item_id"), F.lit(kind).alias("kind"), "data_source", F.col("reward_model.ground_truth").alias("truth"), F.size("prompt").alias("turns"), F.element_at("prompt", -1)["content"].alias("asked"), tools.alias("tools"))
        out = one if out is None else out.unionByName(one)
    return out


@query(QUERIES, f"""WITH r AS (SELECT vec_id AS uid, 20 + vec_id % 40 AS n, vec_id % 3 = 0 AS hit FROM embeddings), s AS (SELECT *, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END AS acc, least(-(n - (60 - 20)) / 20.0::DOUBLE * 0.5::DOUBLE, 0) AS added FROM r),
 t AS (SELECT uid, unnest(range(64)) AS i, n, acc, added FROM s)
 SELECT uid, i::INTEGER AS i, {r6("acc")} AS acc, {r6("added")} AS added, {r6("CASE WHEN uid % 10 = 4 THEN 0.25::DOUBLE ELSE CASE WHEN i = n - 1 THEN acc + added ELSE 0 END + CASE WHEN i % 16 = 5 THEN 0.1::DOUBLE ELSE 0 END END")} AS reward FROM t""")
def managed_rewards(read):
    """Token rewards with a length penalty, the environment's own and stored ones."""
    mask = F.transform("embedding", lambda x, i: F.when(i < 20 + F.col("vec_id") % 40, 1).otherwise(0))
    env = F.transform("embedding", lambda x, i: F.when(i % 16 == 5, 0.1).otherwise(0.0))
    stored = F.when(F.col("vec_id") % 10 == 4, F.transform("embedding", lambda x: F.lit(0.25)))
    df = read("embeddings").select(F.col("vec_id").alias("uid"), mask.alias("mask"), env.alias("env"), stored.alias("stored"))
    out = datasets.rewarded(df, F.col("uid") % 3 == 0, "mask", "dapo", stored="stored", env="env", most=60, buffer=20, factor=0.5)
    return out.select("uid", "acc", "added", F.posexplode("rewards").alias("i", "reward"))


@query(QUERIES, """WITH q AS (SELECT c_custkey AS id, c_custkey % 7 AS k FROM customer) SELECT id, CASE WHEN k % 2 = 0 AND k <> 6 THEN 1.0::DOUBLE ELSE 0 END AS score FROM q""")
def letter_rewards(read):
    """Answers that count letters: right where the last box is the truth as it stands."""
    k = F.col("c_custkey") % 7
    said = F.when(k == 6, F.lit("none")).otherwise(F.concat(F.lit("a = b.\n\\boxed{9} no \\boxed{"), k.cast("string"), F.lit("} in it")))
    gold = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".0")))
    return read("customer").select(F.col("c_custkey").alias("id"), tx.boxed_equal(said, gold).alias("score"))
