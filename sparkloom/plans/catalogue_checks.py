"""Rule-based checks of answers, sheets of scores, paths and training rows.

As in ``catalogue_answers`` both engines build the texts from words of the tables,
and the twins judge them anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import nested, tables
from ..functions import text as tx
from ..operators import batch, curate, metrics, reports
from ..operators import rows as rw
from . import catalogue_scores as cs
from .common import query, r6

QUERIES: dict = {}


def _part(read, *exprs: str):
    return read("part").selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS brand", "p_type AS type", "p_size AS size", "CAST(p_retailprice AS DOUBLE) AS price").selectExpr("*", *exprs)


_P = "p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part)"

_TAGGED = """CASE id % 9 WHEN 0 THEN 'a</think><answer>' || name || '</answer>' WHEN 1 THEN '<think>a</think> <answer> ' || name || ' </answer>' WHEN 2 THEN name WHEN 3 THEN 'a</think><code>' || name || '</code><answer>b</answer>'
 WHEN 4 THEN 'a</think><code>' || name || '<answer>b</answer>' WHEN 5 THEN 'a</think><answer></answer>' WHEN 6 THEN 'a</think><answer>' || repeat(name, 60) || '</answer>' WHEN 7 THEN '<think>a</think><answer>x</answer>b</think>' || name ELSE 'a<answer>b</answer></think>' || name END"""


def _n(text: str, tag: str) -> str:
    return f"len(regexp_extract_all({text}, '{tag}'))"


@query(QUERIES, f"""WITH {_P}, t AS (SELECT id, size, {_TAGGED} AS t FROM p), h AS (SELECT id, size, CASE WHEN starts_with(t, '<think>') THEN t ELSE '<think>' || t END AS t FROM t),
 r AS (SELECT *, trim(regexp_replace(t, '(?s)^.*</think>', '')) AS rest FROM h), a AS (SELECT *, trim(regexp_extract(rest, '(?s)<answer>(.*?)</answer>', 1)) AS a FROM r),
 f AS (SELECT id, CASE WHEN size % 2 = 0 AND length(a) < 300 THEN 1.0 ELSE 0.0 END AS acc, CASE WHEN {_n('t', '<think>')} = {_n('t', '</think>')} AND {_n('t', '<code>')} = {_n('t', '</code>')} AND {_n('rest', '<answer>')} = {_n('rest', '</answer>')} AND a <> '' AND length(a) < 300 THEN 1.0 ELSE 0.0 END AS format FROM a)
 SELECT id, {r6('0.8 * acc + 0.2 * format')} AS score, {r6('acc')} AS acc, {r6('format')} AS format FROM f""")
def tagged_rewards(read):
    return _part(read, f"{_TAGGED} AS t").select("id", an.tagged_reward(F.col("t"), F.col("size") % 2 == 0).alias("r")).select("id", "r.*")


_BACK = chr(92)
_MATHS = """CASE id % 9 WHEN 0 THEN 'Answer: ' || size WHEN 1 THEN 'answer : x = ' || size || ',000' WHEN 2 THEN 'Answer: 1' || chr(10) || name || ' ANSWER: $' || size || '$.' WHEN 3 THEN 'Answer: ' || size || ' square km' WHEN 4 THEN 'Answer: ' || bs || 'frac1' || size
 WHEN 5 THEN 'Answer: ' || bs || 'text{' || name || '}' WHEN 6 THEN 'Answer: ' || bs || 'boxed{' || size || '}' WHEN 7 THEN 'Answer: ' || size || repeat(' ' || name, 50) ELSE name END"""
_TRUTHS = "CASE id % 9 WHEN 1 THEN CAST(size * 1000 AS STRING) WHEN 4 THEN bs || 'frac{1}{' || size || '}' WHEN 5 THEN name ELSE CAST(size AS STRING) END"


# As the twin's engine writes replacements.
_REWRITTEN = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"),
    (r"(\\text\{)(.*?)(\})", r"\2"),
    (r"(\\textbf\{)(.*?)(\})", r"\2"),
    (r"(\\overline\{)(.*?)(\})", r"\2"),
    (r"(\\boxed\{)(.*)(\})", r"\2"),
    (r"(frac)([^{])(.)", r"frac{\2}{\3}"),
    (r"(sqrt)([^{])", r"sqrt{\2}"),
]


def _final_sql(x: str) -> str:
    x = f"list_last(string_split({x}, '='))"
    for old, new in [*an.REPLACED, *((r, "") for r in an.REMOVED)]:
        x = f"replace({x}, '{old}', '{new}')"
    for pattern, to in _REWRITTEN:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"replace({x}, '$', '')"


def _plain_sql(x: str) -> str:
    return f"trim(CASE WHEN regexp_full_match(replace({x}, ',', ''), '[0-9]+') THEN replace({x}, ',', '') ELSE {x} END)"


@query(QUERIES, f"""WITH {_P}, b AS (SELECT *, chr(92) AS bs FROM p), t AS (SELECT id, right({_MATHS}, 300) AS t, {_TRUTHS} AS g FROM b), m AS (SELECT *, regexp_extract_all(t, '(?i)Answer\\s*:\\s*([^\\n]+)', 1) AS m FROM t),
 s AS (SELECT id, {_final_sql("CASE WHEN len(m) > 0 THEN m[len(m)] ELSE '[INVALID]' END")} AS x, {_final_sql('g')} AS y FROM m) SELECT id, {_plain_sql('x')} AS said, CASE WHEN {_plain_sql('x')} = {_plain_sql('y')} THEN 1 ELSE -1 END AS score FROM s""")
def answer_lines(read):
    df = _part(read, "chr(92) AS bs").selectExpr("id", f"{_MATHS} AS t", f"{_TRUTHS} AS g")
    said = F.try_element_at(F.regexp_extract_all(F.right("t", F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1), F.lit(-1))
    return df.select("id", an.final_answer(F.coalesce(said, F.lit("[INVALID]"))).alias("said"), an.answer_line_score(F.col("t"), F.col("g")).alias("score"))


_LETTER = """CASE id % 8 WHEN 0 THEN 'The best answer is ' || l WHEN 1 THEN ' so ' || chr(92) || 'boxed{(' || l || ')}' WHEN 2 THEN 'Answer: ' || l || ' ' || name WHEN 3 THEN 'answer :$' || l || '$' WHEN 4 THEN lower(l)
 WHEN 5 THEN 'one two three four five six seven eight nine ten ' || name WHEN 6 THEN 'Best answer:Best option:' || l ELSE '' END"""
_L = "substring('ABCDE', CAST(size % 5 + 1 AS INTEGER), 1) AS l"


def _lead_sql(leads: list[str]) -> str:
    x = "trim(t)"
    for lead in leads:
        x = f"replace({x}, '{lead}', '')"
    return x


@query(QUERIES, f"""WITH {_P}, l AS (SELECT id, name, {_L} FROM p), t AS (SELECT id, l, {_LETTER} AS t FROM l), r AS (SELECT *, {_lead_sql(an.LEADS)} AS r, {_lead_sql(an.VIDEO_LEADS)} AS v FROM t)
 SELECT id, CASE WHEN id % 8 = 1 THEN '(' || l || ')' WHEN regexp_matches(r, '[A-E]') THEN regexp_extract(r, '[A-E]') WHEN id % 8 = 4 THEN l WHEN id % 8 = 7 THEN 'A' ELSE '' END AS letter, regexp_extract(v, '[ABCD]') AS video,
 CASE WHEN regexp_extract(t, '(?i)answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1) = l THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM r""")
def led_letters(read):
    df = _part(read, _L).selectExpr("id", "l", f"{_LETTER} AS t")
    t = F.col("t")
    return df.select("id", an.letter_behind(t).alias("letter"), an.letter_behind(t, an.VIDEO_LEADS, "ABCD", boxed=False).alias("video"), an.answer_letter_score(t, F.col("l")).alias("score"))


_SAID2 = "CASE id % 4 WHEN 0 THEN ' ' || upper(name) WHEN 1 THEN split_part(name, ' ', 1) || '. ' || brand WHEN 2 THEN brand || ' ' || name ELSE left(name, 2) || ' x' END"


@query(QUERIES, f"""WITH {_P}, s AS (SELECT id, split_part(trim(lower({_SAID2})), ' ', 1) AS a, split_part(trim(lower(name)), ' ', 1) AS b FROM p) SELECT id, position(replace(a, '.', '') IN b) > 0 OR position(b IN a) > 0 AS ok FROM s""")
def same_options(read):
    return _part(read, f"{_SAID2} AS said").select("id", an.same_option(F.col("said"), F.col("name")).alias("ok"))


_GOLD2 = "CASE id % 3 WHEN 0 THEN CAST(price AS STRING) WHEN 1 THEN CAST(size AS STRING) || '%' ELSE CAST(size AS STRING) || '.25' END"
_SAID3 = "CASE id % 7 WHEN 0 THEN CAST(price AS STRING) WHEN 1 THEN CAST(size AS STRING) WHEN 2 THEN CAST(size AS STRING) || '.254' WHEN 3 THEN CAST(size AS STRING) || '.26 %' WHEN 4 THEN CAST(size * 100 AS STRING) WHEN 5 THEN CAST(size AS STRING) || '25' ELSE name END"


def _places(x: str) -> str:
    return f"length(split_part(CAST({x} AS VARCHAR), '.', 2))"


def _shown(item: str) -> str:
    digits = f"CAST(greatest(least({_places('s')}, {_places(item)}), 2) AS INTEGER)"
    return f"round(s, {digits}) = round({item}, {digits})"


@query(QUERIES, f"""WITH {_P}, t AS (SELECT id, TRY_CAST(trim(rtrim({_GOLD2}, '%')) AS DOUBLE) AS g, TRY_CAST(trim(rtrim({_SAID3}, '%')) AS DOUBLE) AS s FROM p)
 SELECT id, coalesce({_shown('g')}, false) AS plain, coalesce({_shown('g')} OR {_shown('(g / 100)')} OR {_shown('(g * 100)')}, false) AS scaled, coalesce({_shown('g')} OR abs(g - s) <= 0.01 * greatest(abs(g), abs(s)), false) AS close FROM t""")
def shown_numbers(read):
    df = _part(read).selectExpr("id", f"{_GOLD2} AS g", f"{_SAID3} AS s")
    return df.select("id", an.equal_as_shown()("g", "s").alias("plain"), an.equal_as_shown(scaled=True)("g", "s").alias("scaled"), an.equal_as_shown(close=True)("g", "s").alias("close"))


_RAW = """CASE id % 9 WHEN 0 THEN '"' || upper(name) || '" (' || brand || ')' WHEN 1 THEN ' $' || size || '.5 ' WHEN 2 THEN size || ' %' WHEN 3 THEN 'https://x.org/' || size WHEN 4 THEN '555-' || size WHEN 5 THEN '2024-0' || (size % 9) || '-11' WHEN 6 THEN name || '.py'
 WHEN 7 THEN replace(name, ' ', '.') || '@mail.org' ELSE 'page ' || size END"""


@query(QUERIES, f"""WITH {_P}, t AS (SELECT id, {_RAW} AS t FROM p), c AS (SELECT id, trim(regexp_replace(trim(lower(t)), '\\s*\\([^)]*\\)', '', 'g')) AS c FROM t), q AS (SELECT id, trim(rtrim(trim(ltrim(trim(regexp_replace(c, '^[''"]|[''"]$', '', 'g')), '$')), '%')) AS c FROM c)
 SELECT id, c, id % 9 IN (3, 6, 7, 8) OR regexp_full_match(c, '[0-9]+([- ][0-9]+)?') OR regexp_full_match(c, '[0-9]{{4}}[- ][0-9]{{2}}([- ][0-9]{{2}})?') AS exact FROM q""")
def exact_answers(read):
    c = an.clean_string(F.col("t"))
    return _part(read).selectExpr("id", f"{_RAW} AS t").select("id", c.alias("c"), an.must_match(c).alias("exact"))


_CHAT = "CASE id % 3 WHEN 0 THEN '<|im_start|>system' || chr(10) || name || '<|im_end|>' ELSE '' END || 'q<tool_call>' || brand || '</tool_call>' || chr(10) || CASE id % 2 WHEN 0 THEN '<tool_call>' || type || chr(10) || '</tool_call>' ELSE '<tool_call>' END"


@query(QUERIES, f"""WITH {_P} SELECT id, 'q<tool_call>' || brand || '</tool_call>' || chr(10) || CASE id % 2 WHEN 0 THEN '<tool_call>' || type || chr(10) || '</tool_call>' ELSE '<tool_call>' END AS rest, brand || CASE id % 2 WHEN 0 THEN '|' || type || chr(10) ELSE '' END AS calls FROM p""")
def chat_parts(read):
    df = _part(read).selectExpr("id", f"{_CHAT} AS t")
    return df.select("id", an.without_system(F.col("t")).alias("rest"), F.array_join(an.contents(F.col("t"), "<tool_call>", "</tool_call>"), "|").alias("calls"))


_HELD = """CASE id % 4 WHEN 0 THEN '{"response": "' || name || '", "thinking": "' || brand || '"}' WHEN 1 THEN '{"response": "' || name || '", "raw_response": "r", "image_path_list": ["a", "' || brand || '"]}' WHEN 2 THEN '{"answer": "' || name || '"}' ELSE name END"""


@query(QUERIES, f"""WITH {_P} SELECT id, CASE WHEN id % 4 = 2 THEN '{{"answer": "' || name || '"}}' ELSE name END AS prediction, CASE WHEN id % 4 = 0 THEN brand ELSE '' END AS thinking, CASE WHEN id % 4 = 1 THEN 'r' ELSE '' END AS raw_response, CASE WHEN id % 4 = 1 THEN 'a|' || brand ELSE '' END AS images FROM p""")
def unpacked_predictions(read):
    df = _part(read).selectExpr("id", f"{_HELD} AS t").select("id", an.unpacked(F.col("t")).alias("x"))
    return df.select("id", "x.prediction", "x.thinking", "x.raw_response", F.array_join("x.images", "|").alias("images"))


@query(QUERIES, f"""WITH {_P} SELECT id, '{{"a": ["<image data URL omitted: ' || (15 + length(brand)) || ' chars>", "' || name || '"], "b": "<image data URL omitted: ' || (14 + size) || ' chars>"}}' AS t FROM p""")
def redacted_images(read):
    df = _part(read, """'{"a": ["data:image/png;' || brand || '", "' || name || '"], "b": "data:image/gif' || repeat('x', size) || '"}' AS t""")
    return df.select("id", an.without_images(F.col("t")).alias("t"))


@query(QUERIES, f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * 10 END AS s, l_tax * 10 AS g, l_quantity AS q, [l_discount * 100, l_quantity] AS a, CASE WHEN l_linenumber = 2 THEN [l_tax * 100] ELSE [l_tax * 100, l_quantity + 1] END AS b FROM lineitem)
 SELECT k, n, {r6('coalesce(greatest(0, 1 - abs(s - g) / nullif(abs(g), 0)), 0)')} AS closeness, {r6('coalesce((s - g) * (s - g), 0)')} AS mse, {r6('coalesce(1 - least(abs(s - g), 0.1) / 0.1, 0)')} AS rmse, {r6('CASE WHEN len(b) = 2 THEN 1 - least((abs(a[1] - b[1]) + abs(a[2] - b[2])) / 2, 10) / 10 ELSE 0 END')} AS angles FROM x""")
def number_errors(read):
    df = read("lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "if(l_linenumber = 3, 'none', cast(l_discount * 10 as string)) AS s", "cast(l_tax * 10 as string) AS g", "array(l_discount * 100, l_quantity) AS a", "if(l_linenumber = 2, array(l_tax * 100), array(l_tax * 100, l_quantity + 1)) AS b")
    df = df.withColumns({"a": F.col("a").cast("array<double>"), "b": F.col("b").cast("array<double>")})
    s, g = F.col("s"), F.col("g")
    return df.select("k", "n", an.relative_closeness(s, g).alias("closeness"), an.squared_error(s, g).alias("mse"), an.error_score(s, g).alias("rmse"), an.angles_score("a", "b").alias("angles"))


@query(QUERIES, f"""WITH e AS (SELECT event_id AS id, radians(value % 180 - 90) AS a, radians((value % 180 - 90) * 0.99) AS b, radians(user_id % 360 - 180.0) AS c, radians(user_id % 360 - 179.5) AS d FROM events)
 SELECT id, {r6('exp(-6371.0088 * 2 * asin(sqrt(least(1, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin((d - c) / 2), 2)))) / 100)')} AS score FROM e""")
def place_scores(read):
    a, c = F.col("value") % 180 - 90, F.col("user_id") % 360
    return read("events").select(F.col("event_id").alias("id"), an.proximity(a, c - 180.0, a * 0.99, c - 179.5).alias("score"))


@query(QUERIES, """WITH m AS (SELECT conv_id, turn, role, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
 SELECT conv_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN greatest(n - 2, 0) ELSE 0 END), 0) AS BIGINT) AS trained FROM m GROUP BY conv_id""")
def turn_masks(read):
    m = read("conversations").where("conv_id is not null and turn is not null").select("conv_id", F.struct("turn", "role", F.coalesce(rw.word_count(F.col("text")), F.lit(0)).alias("n")).alias("m"))
    df = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m")).select("conv_id", an.turn_loss_mask("m", 2).alias("x"))
    return df.select("conv_id", F.size("x").cast("long").alias("tokens"), F.aggregate("x", F.lit(0), lambda a, b: a + b).cast("long").alias("trained"))


_REF = "CASE id % 4 WHEN 0 THEN '/abs/' || brand WHEN 1 THEN brand WHEN 2 THEN type ELSE '' END"


@query(QUERIES, f"""WITH {_P}, r AS (SELECT DISTINCT id, unnest([{_REF}, brand]) AS path FROM p), l AS (SELECT DISTINCT brand AS path FROM p WHERE size % 2 = 0 AND id % 50 = 0)
 SELECT id, path, CASE WHEN path LIKE '/%' THEN 'absolute' ELSE 'missing' END AS fault FROM r WHERE path <> '' AND (path LIKE '/%' OR path NOT IN (SELECT path FROM l))""")
def path_faults(read):
    p = _part(read, f"{_REF} AS r")
    return rw.faulty_paths(p.select("id", F.array("r", "brand").alias("paths")), "id", "paths", p.where("size % 2 = 0 and id % 50 = 0").select(F.col("brand").alias("path")))


@query(QUERIES, f"""WITH {_P}, l AS (SELECT DISTINCT CASE size % 3 WHEN 0 THEN brand WHEN 1 THEN 'data/' || brand ELSE 'old/' || brand END AS path FROM p WHERE id % 20 = 0)
 SELECT id, brand AS path, CASE WHEN brand IN (FROM l) THEN brand WHEN 'data/' || brand IN (FROM l) THEN 'data/' || brand WHEN 'old/' || brand IN (FROM l) THEN 'old/' || brand END AS found FROM p""")
def resolved_paths(read):
    p = _part(read)
    listing = p.where("id % 20 = 0").select(F.expr("CASE size % 3 WHEN 0 THEN brand WHEN 1 THEN 'data/' || brand ELSE 'old/' || brand END").alias("path"))
    return rw.first_existing(p.select("id", F.col("brand").alias("p")), "id", "p", ["data", "old/"], listing)


@query(QUERIES, f"SELECT o_orderkey, {r6('coalesce(CAST(c_acctbal AS DOUBLE), -1)')} AS bal FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def cached_lookup(read):
    cache = read("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").cast("double").alias("bal"))
    return rw.cached_or(read("orders").select("o_orderkey", "o_custkey"), "o_custkey", cache, "bal", F.lit(-1.0)).select("o_orderkey", "bal")


@query(QUERIES, f"SELECT c_mktsegment AS root, count(*) AS n, {r6('avg(CAST(o_totalprice AS DOUBLE))')} AS score FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey GROUP BY ALL")
def scores_by_parent(read):
    nodes = read("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("root"))
    return rw.by_parent(read("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("double").alias("score")), "k", nodes, "root", "score")


_MODES = "SELECT event_type AS g, user_id AS q, CASE event_id % 3 WHEN 0 THEN 'miou' WHEN 1 THEN 'long_acc' ELSE 'clue' END AS mode, CASE event_id % 3 WHEN 0 THEN value / 100 ELSE CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END END AS s FROM events"


@query(QUERIES, f"""WITH m AS ({_MODES}), e AS (SELECT g, q, coalesce(bool_or(mode = 'miou'), false) AS a, coalesce(bool_or(mode = 'long_acc'), false) AS b, coalesce(bool_or(mode = 'miou' AND s > 0.3), false) AS x, coalesce(bool_or(mode = 'long_acc' AND s = 1), false) AS y FROM m GROUP BY ALL)
 SELECT g, {r6('round_even(coalesce(sum((x AND y)::INT) / nullif(sum((a AND b)::INT), 0), 0), 4)')} AS acc FROM e GROUP BY g""")
def acc_at_threshold(read):
    df = read("events").selectExpr("event_type AS g", "user_id AS q", "CASE event_id % 3 WHEN 0 THEN 'miou' WHEN 1 THEN 'long_acc' ELSE 'clue' END AS mode", "CASE event_id % 3 WHEN 0 THEN value / 100 ELSE CASE WHEN event_id % 2 = 0 THEN 1D ELSE 0D END END AS s")
    return rw.right_at_threshold(df, ["g"], "q", "mode", "s", 0.3)


@query(QUERIES, f"""WITH s AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE event_type END AS name, CASE WHEN value > 20 THEN 1 ELSE 0 END AS s FROM events)
 SELECT name, {r6('sum(s)')} AS value FROM s GROUP BY name UNION ALL SELECT 'Final Score', {r6('sum(s)')} FROM s UNION ALL SELECT 'Final Score Norm', {r6('sum(s) / 10')} FROM s""")
def category_sheet(read):
    df = read("events").select("event_type", (F.col("value") > 20).cast("int").alias("s"))
    return rw.score_sheet(df, "event_type", "s", {"click": "seen", "view": "seen"})


@query(QUERIES, f"""WITH b AS (SELECT p_partkey AS id, p_name || (p_partkey // 100) AS t, CASE WHEN p_size % 3 > 0 THEN 1.0 ELSE 0.0 END AS s FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, min(s) OVER (PARTITION BY t) AS m FROM b) SELECT id, {r6('CASE WHEN n = 2 THEN m ELSE s END')} AS pair_score FROM n""")
def text_pairs(read):
    df = read("part").selectExpr("p_partkey AS id", "p_name || (p_partkey div 100) AS t", "if(p_size % 3 > 0, 1D, 0D) AS s")
    return rw.paired_scores(df, "t", "s").select("id", "pair_score")


@query(QUERIES, "SELECT p_partkey AS id, sha256(p_name) AS uid, unnest([0, 1, 2, 3]) AS ordinal FROM part")
def grouped_prompts(read):
    return rw.group_rows(_part(read).select("id", "name"), "name", 4).select("id", "uid", "ordinal")


@query(QUERIES, f"""WITH {_P} SELECT id, 'search_' || brand AS source, 'sys|' || trim(name) AS said, type AS truth, brand AS made_from, name AS question FROM p""")
def tool_rows(read):
    df = _part(read)
    made = curate.rl_rows(df, F.col("brand"), F.col("name"), F.col("type"), F.lit("fact"), F.col("id"), F.lit("train"))
    tools = F.col("extra_info.tools_kwargs.search.create_kwargs")
    out = rw.adapted(rw.with_tools(made, ["search"]).withColumn("data_source", F.concat(F.lit("search_"), "data_source")), system="sys")
    return out.where("extra_info.need_tools_kwargs").select(F.col("extra_info.index").alias("id"), F.col("data_source").alias("source"), F.array_join("prompt.content", "|").alias("said"), tools["ground_truth"].alias("truth"), tools["data_source"].alias("made_from"), tools["question"].alias("question"))


@query(QUERIES, "SELECT item_id FROM benchmark WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 30")
def short_prompts(read):
    return rw.within_length(read("benchmark"), rw.word_count(F.col("text")), 30).select("item_id")


@query(QUERIES, f"""WITH {_P} SELECT id, CASE WHEN size % 2 = 0 THEN l ELSE 'The answer is ' || l END AS submission FROM (SELECT *, {_L} FROM p)""")
def submissions(read):
    df = _part(read, _L).selectExpr("id", "if(size % 2 = 0, brand, null) AS A", "'The answer is ' || l AS prediction")
    return rw.submission(df, "prediction", "A", tx.infer_letter).select("id", "submission")


_AT = """WITH r AS (SELECT event_type AS s, user_id AS p, value AS x, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events),
 k AS (SELECT DISTINCT s, p, n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192], lambda k: k < n), n)) AS k FROM r WHERE n > 1),
 q AS (SELECT s, p, k, sum(x * (pow(r / n, k) - pow((r - 1) / n, k))) AS b, sum(x * x * (pow(r / n, k) - pow((r - 1) / n, k))) AS b2, sum(x * (pow((n - r + 1) / n, k) - pow((n - r) / n, k))) AS w, sum(x * x * (pow((n - r + 1) / n, k) - pow((n - r) / n, k))) AS w2 FROM r JOIN k USING (s, p, n) GROUP BY ALL),
 m AS (SELECT s, 'mean@' || count(*) AS metric, avg(x) AS v FROM r GROUP BY s, p UNION ALL SELECT s, 'std@' || count(*), stddev_pop(x) FROM r GROUP BY s, p HAVING count(*) > 1
  UNION ALL SELECT s, 'best@' || k || '/mean', b FROM q UNION ALL SELECT s, 'best@' || k || '/std', sqrt(greatest(0, b2 - b * b)) FROM q UNION ALL SELECT s, 'worst@' || k || '/mean', w FROM q UNION ALL SELECT s, 'worst@' || k || '/std', sqrt(greatest(0, w2 - w * w)) FROM q)"""


@query(QUERIES, f"{_AT} SELECT s, metric, {r6('round(avg(v) + 1e-8, 4)')} AS value FROM m GROUP BY ALL")
def validation_at_k(read):
    df = metrics.validation_at(read("events").select(F.col("event_type").alias("s"), F.col("user_id").alias("p"), "value"), "s", "p", "value")
    return df.select("s", "metric", F.round(F.col("value") + 1e-8, 4).alias("value"))


@query(QUERIES, "WITH n AS (SELECT count(*) AS n FROM events) SELECT b AS mini_batch, least(300, n - b * 300) AS n FROM (SELECT unnest(range(0, (n + 299) // 300)) AS b, n FROM n)")
def mini_batches(read):
    return batch.mini_batches(read("events").select("event_id"), 300, 42, "event_id").groupBy("mini_batch").agg(F.count(F.lit(1)).alias("n"))


@query(QUERIES, "WITH n AS (SELECT count(*) AS n FROM events) SELECT 'train' AS split, CAST(floor(0.7 * n) AS BIGINT) AS n FROM n UNION ALL SELECT 'test', n - CAST(floor(0.7 * n) AS BIGINT) FROM n")
def seeded_split(read):
    return batch.ratio_split(read("events").select("event_id"), 0.7, 42, "event_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_BATCH = "event_id // 256 AS b, event_id AS pos, value AS s"


@query(QUERIES, f"WITH e AS (SELECT {_BATCH} FROM events), m AS (SELECT b, max(s) AS hi, min(s) AS lo, count(*) AS n FROM e GROUP BY b) SELECT b, n, true AS known, {r6('sum(CASE WHEN s = hi OR s = lo THEN 1 ELSE 0 END + 1e-8)')} AS weight FROM e JOIN m USING (b) GROUP BY b, n")
def resampled_batches(read):
    df = read("events").selectExpr("event_id div 256 AS b", "event_id AS pos", "value AS s")
    w = batch.resample_weights(df, "b", "s", "max_min")
    drawn = batch.multinomial_resample(w, "b", "weight", 42).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("weight") > 0.5).alias("known"))
    return drawn.join(w.groupBy("b").agg(F.sum("weight").alias("weight")), "b")


_HITS = "SELECT event_type AS sp, CAST(user_id % 3 AS STRING) AS area, CAST(user_id % 9 AS STRING) AS task, CASE WHEN value > 20 THEN 1 ELSE 0 END AS hit FROM events"


@query(QUERIES, f"""WITH h AS ({_HITS}), a AS (SELECT * FROM h UNION ALL SELECT 'ALL', area, task, hit FROM h), t AS (SELECT sp, area, task, avg(hit) AS v FROM a GROUP BY ALL)
 SELECT sp AS split, 'overall' AS kind, 'Overall' AS name, {r6('avg(hit)')} AS value FROM a GROUP BY sp UNION ALL SELECT sp, 'task', task, {r6('v')} FROM t UNION ALL SELECT sp, 'area', area, {r6('CASE WHEN count(*) = 3 THEN avg(v) END')} FROM t GROUP BY sp, area""")
def split_report(read):
    df = read("events").selectExpr("event_type AS sp", "cast(user_id % 3 as string) AS area", "cast(user_id % 9 as string) AS task", "cast(value > 20 as int) AS hit")
    return reports.split_report(df, "sp", "area", "task", "hit")


_CB = "[{}]".format(", ".join(cs._hits(cs._ngrams("x", n), cs._ngrams("y", n)) for n in range(1, 5)))


@query(QUERIES, f"""WITH {cs.PAIRS}, t AS (SELECT item_id % 5 AS g, {cs._words('x')} AS x, {cs._words('y')} AS y FROM p), h AS (SELECT g, {_CB} AS h, len(x) AS c, len(y) AS r FROM t),
 s AS (SELECT g, [sum(h[1]), sum(h[2]), sum(h[3]), sum(h[4])] AS h, [sum(greatest(c, 0)), sum(greatest(c - 1, 0)), sum(greatest(c - 2, 0)), sum(greatest(c - 3, 0))] AS t, (sum(c) + 1e-15) / (sum(r) + 1e-9) AS q FROM h GROUP BY g),
 f AS (SELECT g, CASE WHEN q < 1 THEN exp(1 - 1 / q) ELSE 1 END AS b, list_transform(h, lambda v, i: (v + 1e-15) / (t[i] + 1e-9)) AS p FROM s)
 SELECT g, {r6('b * p[1]')} AS bleu_1, {r6('b * sqrt(p[1] * p[2])')} AS bleu_2, {r6('b * pow(p[1] * p[2] * p[3], 1 / 3.0::DOUBLE)')} AS bleu_3, {r6('b * pow(p[1] * p[2] * p[3] * p[4], 0.25)')} AS bleu_4 FROM f""")
def caption_bleu(read):
    df = cs._pairs(read).select((F.col("item_id") % 5).alias("g"), "x", F.array("y").alias("y"))
    return reports.caption_bleu(df, "x", "y", ["g"])


_JSONS = """'so {"b": ' || size || ', "a": {"d": ["' || name || '", 2], "c": null}} {bad} then {"x": []}{"' || brand || '": 1.5}'"""
_FIRST = """'{"b": ' || size || ', "a": {"d": ["' || name || '", 2], "c": null}}'"""


@query(QUERIES, f"""WITH {_P} SELECT id, {_FIRST} || '|{{"x": []}}|{{"' || brand || '": 1.5}}' AS objects, 'b=' || size || '|a.d=' || name || '|a.d=2|a.c=' AS pairs, '{{"a": {{"c": null, "d": ["' || name || '", 2]}}, "b": ' || size || '}}' AS sorted FROM p""")
def nested_json(read):
    df = _part(read).select("id", nested.json_objects(F.expr(_JSONS)).alias("o"), F.expr(_FIRST).alias("f"))
    pairs = F.transform(nested.flattened("f"), lambda p: F.concat(p["key"], F.lit("="), F.coalesce(p["value"], F.lit(""))))
    return df.select("id", F.array_join("o", "|").alias("objects"), F.array_join(pairs, "|").alias("pairs"), nested.sorted_json("f").alias("sorted"))


@query(QUERIES, """SELECT event_id, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def json_columns(read):
    return nested.normalised_columns(read("events").select("event_id", "props"), "props", "k long")


_VERDICT = "CASE size % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No ' || name WHEN 2 THEN 'not Yes: boxed{No}' WHEN 3 THEN 'No <最终结果>' || 'Yes<' || chr(92) || '最终结果> No' ELSE 'maybe' END"


@query(QUERIES, f"WITH {_P} SELECT id, {r6('CASE WHEN id % 3 = 0 THEN NULL WHEN size % 5 IN (0, 3) THEN 1 ELSE 0 END')} AS judge FROM p")
def judge_verdicts(read):
    p = _part(read)
    return nested.judged(p.select("id"), "id", p.where("id % 3 <> 0").select("id", F.expr(_VERDICT).alias("a")), "a").select("id", "judge")


_CELL_GOLD = "CASE id % 8 WHEN 6 THEN '2024-05-xx' WHEN 7 THEN '2020-xx-xx' ELSE size || '|' || name END"
_CELL_SAID = """CASE id % 8 WHEN 0 THEN upper(name) || '[1]|' || size || '.0' WHEN 1 THEN name || ' (about)||' || size WHEN 2 THEN size || '' WHEN 3 THEN '"' || name || '"|' || size || '.|' || size WHEN 4 THEN name || '|' || (size + 1)
 WHEN 5 THEN name || '|' || size || '|' || brand WHEN 6 THEN CASE WHEN size % 2 = 0 THEN '2024-5-xx' ELSE '2024-06-xx' END ELSE CASE WHEN size % 2 = 0 THEN '2020.0' ELSE '2021' END END"""


@query(QUERIES, f"WITH {_P} SELECT id, CASE id % 8 WHEN 6 THEN size % 2 = 0 WHEN 7 THEN size % 2 = 0 ELSE id % 8 IN (0, 1, 3) END AS ok FROM p")
def table_denotations(read):
    return _part(read).selectExpr("id", f"{_CELL_GOLD} AS g", f"{_CELL_SAID} AS s").select("id", tables.denotation_match("g", "s").alias("ok"))


_SUM_SAID = "CASE id % 6 WHEN 0 THEN '$' || (size * 1000) || ',000' WHEN 1 THEN size || ' million dollars' WHEN 2 THEN '' || size WHEN 3 THEN size || ' billion' WHEN 4 THEN size || '%' ELSE name END"


@query(QUERIES, f"WITH {_P} SELECT id, id % 6 < 2 AS exact, id % 6 < 5 AS relieved FROM p")
def scaled_amounts(read):
    df = _part(read).selectExpr("id", "size || ' million' AS g", f"{_SUM_SAID} AS s")
    return df.select("id", tables.amount_match("g", "s").alias("x")).select("id", "x.exact", "x.relieved")


_CODE = "'<code>a</code>x<code>' || CASE id % 3 WHEN 0 THEN '```python' || chr(10) || 'if a:' || chr(10) || name || chr(10) || 'else:' || chr(10) || '  ' || brand || chr(10) || '```' WHEN 1 THEN name ELSE '```python ' || chr(10) || brand || chr(10) || '```' END || '</code>'"


@query(QUERIES, f"WITH {_P} SELECT id, CASE id % 3 WHEN 0 THEN 'if a:' || chr(10) || '    ' || name || chr(10) || 'else:' || chr(10) || '    ' || brand WHEN 2 THEN brand END AS code FROM p")
def code_blocks(read):
    return _part(read).selectExpr("id", f"{_CODE} AS t").select("id", tables.repaired_code(tables.python_code(F.col("t"))).alias("code"))


@query(QUERIES, f"WITH {_P}, c AS (SELECT id % 7 AS g, CASE WHEN size % 3 = 0 THEN 2 WHEN size % 3 = 1 THEN 3 ELSE 0 END AS hit, CASE WHEN size % 3 = 0 THEN 2 WHEN size % 3 = 1 THEN 0 ELSE 3 END AS off FROM p) SELECT g, {r6('2 * sum(hit) / nullif(2 * sum(hit) + sum(off), 0)')} AS f1 FROM c GROUP BY g")
def form_fields(read):
    gold = """'{"name": "' || name || '", "at": {"brand": ["' || brand || '", "z"]}}' AS g"""
    said = """CASE size % 3 WHEN 0 THEN 'so ```json' || chr(10) || '{"at": {"brand": ["z", "' || brand || '"]},' || chr(10) || ' "name": "none!"} ```' WHEN 1 THEN '{"name": "' || name || ' ", "at": {"brand": ["z", "' || brand || '"]}}' ELSE 'none' END AS s"""
    df = _part(read).selectExpr("id % 7 AS g0", gold, said).select(F.col("g0").alias("grp"), "g", tables.json_block(F.col("s")).alias("s"))
    return tables.form_f1(df, "s", "g", ["grp"]).select(F.col("grp").alias("g"), "f1")


@query(QUERIES, "SELECT event_id, row_number() OVER (ORDER BY value > 20 DESC, event_id) - 1 AS rank, count(*) OVER () AS total FROM events")
def mask_first(read):
    df = read("events").select("event_id", (F.col("value") > 20).alias("good"))
    return batch.mask_first_rank(df, "good", "event_id").select("event_id", "rank", "total")


_ASKED = """CASE id % 16 WHEN 0 THEN 'What colour is the ' || name || '?' WHEN 1 THEN ' Find the ' || name WHEN 2 THEN 'How many ' || name || 's at least?' WHEN 3 THEN 'In the bar chart, which ' || name || '?' WHEN 4 THEN 'According to the table, what ' || name || '?'
 WHEN 5 THEN 'Write a script for ' || name WHEN 6 THEN 'A riddle about a ' || name WHEN 7 THEN '   ' WHEN 8 THEN 'So A B = ' || size WHEN 9 THEN 'value of  x in ' || name WHEN 10 THEN chr(92) || 'frac{1}{' || size || '}' WHEN 11 THEN 'The programme of ' || name
 WHEN 12 THEN 'Is the summer ' || name || ' here?' WHEN 13 THEN 'The SQL of ' || name WHEN 14 THEN 'Which statement on the graph of ' || name WHEN 15 THEN name END"""
# The question filter's patterns, written out once more for the twin.
_KINDS = r"""CASE WHEN trim(coalesce(t, '')) = '' THEN 'empty_question'
 WHEN regexp_matches(trim(t), '(?i)(?:^\s*find\b|\b[A-Z]\s+[A-Z]\s*=|\b(?:find|calculate|compute|what is)\s+(?:the\s+)?(?:area|perimeter|volume)\b|\\(?:frac|sqrt|angle|triangle|overline)\b|\bvalue of\s+[xyz]\b|\b(?:mean|median|mode|average|sum|difference|product|quotient|calculate|calculation|compute|equation|fraction|ratio|percentage|percent(?:age)?|probability|algebra|geometry|hypotenuse|parallelogram|quadrilateral|polygon|hexagon|theorem|congruent|similar triangles|coordinate plane|intercept|radius|diameter|tangent|round to|nearest tenth|multiply|divide|subtract|at least|at most)\b)') THEN 'math_reasoning'
 WHEN regexp_matches(trim(t), '(?i)(?:\b(?:according to|following|data)\s+(?:the\s+)?table\b|\b(?:bar chart|pie chart|line graph|scatter plot|chart|graph|spreadsheet|schedule|diagram|flowchart|histogram|coordinate|x-axis|y-axis)\b)') THEN 'chart_or_diagram'
 WHEN regexp_matches(trim(t), '(?i)\b(?:write (?:a )?code|program(?:ming)?|python|javascript|sql|algorithm|terminal|compile|execute (?:the )?code|write (?:a )?script)\b') THEN 'code_or_symbolic_task'
 WHEN regexp_matches(trim(t), '(?i)\b(?:logic puzzle|riddle|number sequence|next number|sudoku|crossword|deduce|deduction|which statement)\b') THEN 'logic_puzzle'
 ELSE 'real_world_perception_candidate' END"""


@query(QUERIES, f"WITH {_P}, t AS (SELECT id, {_ASKED} AS t FROM p UNION ALL SELECT item_id, text FROM benchmark) SELECT id, {_KINDS} AS kind FROM t")
def question_kinds(read):
    asked = _part(read).selectExpr("id", f"{_ASKED} AS t").unionByName(read("benchmark").selectExpr("item_id AS id", "text AS t"))
    return asked.select("id", curate.question_kind(F.col("t")).alias("kind"))
