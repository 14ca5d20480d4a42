"""Answers in many shapes, row builders, strict joins and selections.

The texts are written in SQL that both engines read, from real words of the
tables; the twins extract from them anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import rows as rw
from .common import query, r6

QUERIES: dict = {}

_W = "split_part(name, ' ', 1)"
#: A part's answer in nine shapes: tags of any case, tool turns, tags within tags, none.
SHAPES = f"""CASE p_partkey % 9 WHEN 0 THEN 'so <answer>' || name || '</answer>' WHEN 1 THEN '<ANSWER> ' || {_W} || ' </Answer>  ' WHEN 2 THEN '<answer>a <b> ' || name || '</answer>'
 WHEN 3 THEN '<answer>' || name || '</answer> and more' WHEN 4 THEN 'user x <tool_response>1</tool_response> assistant ' || {_W} || ' <answer>' || name || '</answer>'
 WHEN 5 THEN '<answer>' || name || '</answer> <tool_response>2</tool_response>' WHEN 6 THEN '<answer>  </answer>' WHEN 7 THEN '<answer>x</answer><answer>' || name || '</answer>' ELSE name END"""
SHAPED = f"p AS (SELECT p_partkey AS id, p_name AS name, {SHAPES.replace('name', 'p_name')} AS t FROM part)"


def shaped(read):
    return read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr(SHAPES.replace("name", "p_name")).alias("t"))


@query(QUERIES, f"""WITH {SHAPED}, f AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)<tool_response>') THEN regexp_extract(t, '(?is)^.*(?:<\\|im_start\\|>|^|\\s)assistant\\s*(.*)$', 1) ELSE t END AS final FROM p)
 SELECT id, len(regexp_extract_all(t, '(?i)<answer>')) = 1 AND len(regexp_extract_all(t, '(?i)</answer>')) = 1 AND regexp_matches(final, '(?is)<answer>\\s*[^<>]+?\\s*</answer>\\s*$') AS ok FROM f""")
def strict_answer_format(read):
    return shaped(read).select("id", tx.strict_format(F.col("t")).alias("ok"))


@query(QUERIES, f"""WITH {SHAPED}, x AS (SELECT id, list_transform(regexp_extract_all(t, '(?is)<answer>(.*?)</answer>', 1), lambda s: trim(s)) AS a, regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1) AS b FROM p)
 SELECT id, a[len(a)] AS last, CASE WHEN len(b) > 0 THEN b[1] END AS first FROM x""")
def tagged_answers(read):
    return shaped(read).select("id", tx.last_answer(F.col("t")).alias("last"), tx.first_answer(F.col("t")).alias("first"))


_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || '.,;:!?')"
_SAID = "CASE id % 6 WHEN 0 THEN upper(name) || ' .' WHEN 1 THEN 'C. ' || name WHEN 2 THEN 'c' WHEN 3 THEN 'cat ' || name WHEN 4 THEN '(' || name || ')' ELSE name || ' !' END"
_GOLD = "CASE WHEN id % 6 IN (1, 2, 3) THEN 'C' WHEN id % 12 = 5 THEN '.' ELSE ' ' || name END"


@query(QUERIES, f"""WITH b AS (SELECT p_partkey AS id, p_name AS name FROM part), s AS (SELECT id, {_SAID} AS said, {_GOLD} AS gold FROM b), n AS (SELECT id, {_NORM.format('said')} AS x, {_NORM.format('gold')} AS y FROM s)
 SELECT id, x AS normal, x = y OR (regexp_matches(y, '^[a-z]$') AND left(x, 1) = y AND NOT regexp_matches(x, '^.[a-z0-9_]')) AS ok FROM n""")
def rule_match(read):
    df = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).select("id", F.expr(_SAID).alias("said"), F.expr(_GOLD).alias("gold"))
    return df.select("id", tx.normalised(F.col("said")).alias("normal"), tx.rule_match(F.col("said"), F.col("gold")).alias("ok"))


_CHOICE = """CASE id % 10 WHEN 0 THEN 'The answer is (' || l || ').' WHEN 1 THEN l || ' is ' || name || ' one two three' WHEN 2 THEN l WHEN 3 THEN 'A or B, ' || name WHEN 4 THEN 'Cannot determine the answer ' || l
 WHEN 5 THEN 'Sorry for the delay, the answer is ' || l WHEN 6 THEN 'Failed to obtain answer via API ' || l WHEN 7 THEN name || ' Z' WHEN 8 THEN name || ': ' || l || '!' ELSE name END"""
_CHOICES = f"c AS (SELECT id, {_CHOICE} AS t FROM (SELECT p_partkey AS id, p_name AS name, substring('ABCDE', CAST(p_size % 5 + 1 AS INTEGER), 1) AS l FROM part))"


@query(QUERIES, f"""WITH {_CHOICES}, w AS (SELECT *, list_filter(regexp_split_to_array(translate(t, '.()[],:;!*#{{}}', '             '), '\\s+'), lambda x: x <> '') AS w FROM c),
 s AS (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: list_contains(w, x)) AS seen FROM w)
 SELECT id, CASE WHEN contains(t, 'Failed to obtain') THEN NULL WHEN contains(t, 'Cannot determine the answer') THEN 'Z' WHEN len(seen) = 0 AND list_contains(w, 'Z') THEN 'Z'
  WHEN len(seen) = 1 AND list_position(w, seen[1]) - 1 > len(w) - 5 THEN seen[1] END AS letter FROM s""")
def option_letter(read):
    df = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("substring('ABCDE', cast(p_size % 5 + 1 as int), 1)").alias("l"))
    return df.select("id", F.expr(_CHOICE).alias("t")).select("id", tx.infer_letter(F.col("t")).alias("letter"))


_ORDER = """CASE id % 5 WHEN 0 THEN 'it is ' || o || '.' WHEN 1 THEN 'first ' || substring(o, 1, 1) || ', second ' || substring(o, 2, 1) || ', third ' || substring(o, 3, 1) || ' and fourth ' || substring(o, 4, 1)
 WHEN 2 THEN 'AABB' WHEN 3 THEN 'step 1 ' || substring(o, 4, 1) || ' step 2 ' || substring(o, 3, 1) || ' step 3 ' || substring(o, 2, 1) || ' step 4 ' || substring(o, 1, 1) ELSE 'none' END"""
_PERM = "CASE p_size % 4 WHEN 0 THEN 'ABCD' WHEN 1 THEN 'DCBA' WHEN 2 THEN 'BADC' ELSE 'CDAB' END"


@query(QUERIES, f"SELECT id, CASE id % 5 WHEN 0 THEN o WHEN 1 THEN o WHEN 3 THEN reverse(o) END AS o FROM (SELECT p_partkey AS id, {_PERM} AS o FROM part)")
def order_infer(read):
    df = read("part").select(F.col("p_partkey").alias("id"), F.expr(_PERM).alias("o"))
    return df.select("id", tx.infer_order(F.expr(_ORDER)).alias("o"))


_BOX = """CASE id % 5 WHEN 0 THEN '<think>' || name || '</think> so \\\\boxed{' || n || '}.' WHEN 1 THEN 'no thoughts \\\\boxed{' || n || '}' WHEN 2 THEN '<think>x</think> \\\\boxed{' || n || '} ' || repeat(name, 9)
 WHEN 3 THEN '<think>a</think> \\\\boxed{1} or \\\\boxed{' || n || ' }' ELSE ' <think></think>' END"""


@query(QUERIES, f"""WITH b AS (SELECT p_partkey AS id, p_name AS name, CAST(p_size AS STRING) AS n FROM part), t AS (SELECT id, n, {_BOX.replace(chr(92) * 2, chr(92))} AS t FROM b),
 x AS (SELECT *, regexp_extract_all(right(t, 100), '\\\\boxed\\{{([^{{}}]*)\\}}', 1) AS boxes FROM t)
 SELECT id, CASE WHEN regexp_full_match(t, '(?s)<think>.*</think>.*\\\\boxed\\{{.*\\}}.*') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS form, CASE WHEN len(boxes) > 0 AND boxes[len(boxes)] = n THEN 1 ELSE -1 END AS score FROM x""")
def boxed_rewards(read):
    df = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("n"))
    df = df.select("id", "n", F.expr(_BOX).alias("t"))
    return df.select("id", tx.think_box_format(F.col("t")).alias("form"), tx.strict_box(F.col("t"), F.col("n")).alias("score"))


@query(QUERIES, f"""WITH b AS (SELECT a.p_partkey AS id, lower(trim(a.p_name)) AS x, lower(trim(b.p_name)) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 + 1),
 s AS (SELECT id, 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE AS s FROM b) SELECT id, {r6('CASE WHEN s > 0.4 THEN s ELSE 0 END')} AS anls FROM s""")
def anls_documents(read):
    b = read("part").select(F.col("p_partkey").alias("g"), F.col("p_name").alias("gold"))
    df = read("part").join(b, F.floor(F.col("p_partkey") / 2) + 1 == F.col("g"))
    return df.select(F.col("p_partkey").alias("id"), tx.anls_cut(F.col("p_name"), F.col("gold"), 0.4).alias("anls"))


_XY = "[l_quantity * 1.5 - 10, l_discount * 900 + 0.5, l_quantity * 3 + l_tax * 100, l_linenumber * 100 + 0.5]"


@query(QUERIES, f"""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, {_XY} AS x FROM lineitem),
 r AS (SELECT k, n, greatest(0, least(99, round_even(x[1], 0))) AS l, greatest(0, least(49, round_even(x[2], 0))) AS t, greatest(1, least(100, round_even(x[3], 0))) AS r, greatest(1, least(50, round_even(x[4], 0))) AS b FROM b)
 SELECT k, n, CASE WHEN r > l AND b > t THEN CAST(l AS BIGINT) || ',' || CAST(t AS BIGINT) || ',' || CAST(r AS BIGINT) || ',' || CAST(b AS BIGINT) END AS rect FROM r""")
def crop_rect(read):
    box = F.expr("array(l_quantity * 1.5D - 10, l_discount * 900 + 0.5D, l_quantity * 3 + l_tax * 100, l_linenumber * 100 + 0.5D)").cast("array<double>")
    df = read("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), box.alias("x"))
    return df.select("k", "n", F.array_join(geo.crop_rect("x", F.lit(100), F.lit(50)).cast("array<string>"), ",").alias("rect"))


@query(QUERIES, f"""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, [l_discount * (l_linenumber % 3) * 6, l_tax, l_discount + l_tax, 1.0::DOUBLE] AS x FROM lineitem)
 SELECT k, n, {r6("CASE WHEN x[1] <= 1.5 THEN x[1] * 640 ELSE x[1] END")} AS x1, {r6("CASE WHEN x[1] <= 1.5 THEN x[2] * 480 ELSE x[2] END")} AS y1, {r6("CASE WHEN x[1] <= 1.5 THEN x[3] * 640 ELSE x[3] END")} AS x2, {r6("CASE WHEN x[1] <= 1.5 THEN x[4] * 480 ELSE x[4] END")} AS y2 FROM b""")
def pixel_box(read):
    box = F.expr("array(l_discount * (l_linenumber % 3) * 6, l_tax, l_discount + l_tax, 1D)").cast("array<double>")
    df = read("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), box.alias("x"))
    p = geo.pixel_box("x", F.lit(640), F.lit(480))
    return df.select("k", "n", *[p[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query(QUERIES, "SELECT p_partkey, p_brand FROM part WHERE lower(trim(p_brand)) IN ('brand#1', 'brand#11', 'brand#13', 'brand#15')")
def allow_list(read):
    return rw.allowed(read("part"), "p_brand", ["brand#1", "brand#11", "brand#13", "brand#15"]).select("p_partkey", "p_brand")


@query(QUERIES, "SELECT p_partkey AS id, 'data/' || p_brand || '||data/' || p_type AS paths FROM part")
def prefixed_paths(read):
    df = read("part").select(F.col("p_partkey").alias("id"), F.array("p_brand", F.lit(""), "p_type").alias("p"))
    return df.select("id", F.array_join(rw.prefixed("p", "data/"), "|", "").alias("paths"))


@query(QUERIES, "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS a, CASE WHEN p_size % 2 = 0 THEN 'Other' END AS b, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE p_name END AS letter FROM part")
def two_choices(read):
    df = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("answer"), F.when(F.col("p_size") % 2 != 0, F.col("p_brand")).alias("A"))
    return rw.two_choices(df, "answer", "Other").select("id", F.col("A").alias("a"), F.col("B").alias("b"), F.col("answer_letter").alias("letter"))


@query(QUERIES, """WITH c AS (SELECT p_partkey AS id, p_name AS good, unnest([p_name, p_brand, p_type, 'none']) AS c FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('42:' || id || ':' || c)) AS k FROM c)
 SELECT id, string_agg(c, '|' ORDER BY k) AS choices, chr(64 + CAST(min(k) FILTER (c = good) AS INTEGER)) AS letter FROM o GROUP BY id""")
def shuffled_choices(read):
    df = read("part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_brand", "p_type", F.lit("none")).alias("c"))
    s = rw.shuffled_choices("c", F.col("id"))
    return df.select("id", F.array_join(s["choices"], "|").alias("choices"), s["letter"].alias("letter"))


@query(QUERIES, "SELECT o_orderkey, o_custkey, c_mktsegment AS segment FROM orders JOIN (SELECT c_custkey, c_mktsegment FROM customer) ON o_custkey = c_custkey")
def strict_sync(read):
    right = read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return rw.strictly_synced(read("orders").select("o_orderkey", "o_custkey", F.lit("").alias("segment")), right, "o_custkey", ["segment"])


@query(QUERIES, "SELECT o_orderkey AS id, a.l_quantity AS q_1, b.l_quantity AS q_2, c.l_quantity AS q_3 FROM orders LEFT JOIN lineitem a ON a.l_orderkey = o_orderkey AND a.l_linenumber = 1 LEFT JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 2 LEFT JOIN lineitem c ON c.l_orderkey = o_orderkey AND c.l_linenumber = 3")
def step_tables(read):
    steps = [(read("lineitem").where(F.col("l_linenumber") == i).select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("q")), str(i)) for i in (1, 2, 3)]
    return rw.step_tables(read("orders").select(F.col("o_orderkey").alias("id")), steps, "id", "q")


@query(QUERIES, f"WITH k AS (SELECT DISTINCT event_type AS g FROM events WHERE event_type <> 'click'), a AS (SELECT event_type AS g, value FROM events WHERE event_type <> 'click' UNION ALL SELECT g, value FROM events, k WHERE event_type = 'click') SELECT g, count(*) AS n, {r6('avg(value)')} AS score FROM a GROUP BY g")
def shared_group(read):
    return rw.with_shared(read("events").select("event_type", "value"), "event_type", "click").groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("score"))


@query(QUERIES, "SELECT p_partkey AS id, 'brand=' || p_brand || ',size=' || p_size || ',type=' || p_type AS m FROM part")
def metadata_union(read):
    a = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    b = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    df = read("part").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b")).select("id", rw.joined_maps("a", "b").alias("m"))
    return df.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("m"))


@query(QUERIES, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k <= 2")
def top_two(read):
    return rw.first_rows_by_group(read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber")])


@query(QUERIES, "SELECT l_orderkey AS g, bool_and(CASE WHEN l_linenumber = 4 AND l_tax < 0.01 THEN false ELSE l_discount < 0.08 END) AS hit FROM lineitem GROUP BY 1")
def circular_eval(read):
    said = F.when((F.col("l_linenumber") == 4) & (F.col("l_tax") < 0.01), None).when(F.col("l_discount") < 0.08, "A").otherwise("B")
    return rw.circular_score(read("lineitem").select(F.col("l_orderkey").alias("g"), said.alias("said"), F.lit("A").alias("gold")), "g", "said", "gold")


_METRICS = """SELECT s, v, m FROM (SELECT DISTINCT event_type AS s FROM events) a CROSS JOIN (SELECT 'acc' AS v UNION ALL SELECT 'reward' UNION ALL SELECT 'len') b CROSS JOIN
 (SELECT 'mean@4' AS m UNION ALL SELECT 'mean@8' UNION ALL SELECT 'maj@8/mean' UNION ALL SELECT 'best@8/mean' UNION ALL SELECT 'best@8/std' UNION ALL SELECT 'worst@8/mean') c WHERE NOT (s = 'click' AND v = 'acc')"""


@query(QUERIES, f"WITH x AS ({_METRICS}) SELECT s, v, m, CASE WHEN v = CASE WHEN s = 'click' THEN 'reward' ELSE 'acc' END AND m IN ('mean@8', 'maj@8/mean', 'best@8/mean') THEN 'core' ELSE 'aux' END AS section FROM x")
def core_metrics(read):
    names = [(v, m) for v in ("acc", "reward", "len") for m in ("mean@4", "mean@8", "maj@8/mean", "best@8/mean", "best@8/std", "worst@8/mean")]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(m).alias("m")) for v, m in names])).alias("x")
    df = read("events").select(F.col("event_type").alias("s")).distinct().select("s", pairs).select("s", "x.v", "x.m")
    return rw.core_metrics(df.where(~((F.col("s") == "click") & (F.col("v") == "acc"))), "s", "v", "m")


@query(QUERIES, f"""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_discount AS s, l_discount - 0.1 * l_tax * CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS r, l_tax AS kl, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS m FROM lineitem)
 SELECT k, string_agg(CAST(round(r * 10000) AS BIGINT), ',' ORDER BY i, s, kl, m) AS rewards, {r6('coalesce(sum(kl * m) / nullif(sum(m), 0), 0)')} AS kl FROM t GROUP BY k""")
def kl_penalised_rewards(read):
    row = F.struct(F.col("l_linenumber").alias("i"), F.col("l_discount").cast("double").alias("s"), F.col("l_tax").cast("double").alias("k"), (F.col("l_quantity") > 10).cast("int").alias("m"))
    df = read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(row)).alias("x"))
    df = df.select("k", F.col("x.s").alias("s"), F.col("x.k").alias("kl"), F.col("x.m").alias("m")).withColumn("r", rw.kl_penalised("s", "kl", "m", 0.1))
    mean = F.expr("coalesce(aggregate(zip_with(kl, m, (a, b) -> a * b), 0D, (a, b) -> a + b) / nullif(aggregate(m, 0, (a, b) -> a + b), 0), 0D)")
    return df.select("k", F.expr("array_join(transform(r, v -> cast(cast(round(v * 10000) as bigint) as string)), ',')").alias("rewards"), mean.alias("kl"))


@query(QUERIES, """WITH t AS (SELECT l_orderkey AS k, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS m, CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS a FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity > 10, l_discount > 0.03))
 SELECT k, CAST(coalesce(sum(m) FILTER (i <= n - n // 2), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(m * a) FILTER (i > n - n // 2), 0) AS BIGINT) AS response, CAST(coalesce(sum(m * (1 - a)) FILTER (i > n - n // 2), 0) AS BIGINT) AS observation FROM t GROUP BY k""")
def mask_lengths(read):
    row = F.struct(F.col("l_linenumber").alias("i"), (F.col("l_quantity") > 10).cast("int").alias("m"), (F.col("l_discount") > 0.03).cast("int").alias("a"))
    df = read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(row)).alias("x")).select("k", F.col("x.m").alias("m"), F.col("x.a").alias("a"))
    return df.select("k", rw.mask_lengths("m", F.floor(F.size("m") / 2).cast("int"), "a").alias("n")).select("k", "n.*")


@query(QUERIES, f"SELECT event_id, {r6('CASE WHEN event_id % 3 = 0 THEN value ELSE value / 2 END')} AS score FROM events")
def stored_scores(read):
    df = read("events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("rm_score"), "value")
    return df.select("event_id", rw.stored_or("rm_score", F.col("value") / 2).alias("score"))
