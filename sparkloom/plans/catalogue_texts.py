"""Caption sets and other answers over whole texts; the twins compute every rule
from the texts anew."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import forms, grids, numerics
from ..functions import similarity as sim
from ..operators import captions
from .common import query, r6, spread

QUERIES: dict = {}


def _captions(read):
    """The first answer of each conversation as a caption, its other messages as the
    references."""
    said = F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("said")
    refs = F.transform(F.sort_array(F.collect_list(F.when(F.col("turn") != 1, F.struct("turn", "text")))), lambda x: x["text"]).alias("refs")
    # Dealt by the blocks in which they are scored, texts are shuffled once.
    turns = captions.in_blocks(read("conversations").select("conv_id", "turn", "text"), "conv_id").repartition("_block")
    return turns.groupBy("_block", "_blocks", "_total", "conv_id").agg(said, refs).withColumn("g", F.col("conv_id") % 3)


_CAPTIONS = """c AS (SELECT conv_id AS id, conv_id % 3 AS g, coalesce(max(text) FILTER (turn = 1), '') AS said, coalesce(list(text ORDER BY turn, text) FILTER (turn <> 1), []) AS refs FROM conversations GROUP BY conv_id),
 s AS (SELECT id, -1 AS side, said AS text FROM c UNION ALL SELECT id, unnest(range(len(refs))), unnest(refs) FROM c)"""

_CIDER = rf"""{_CAPTIONS},
 w AS (SELECT id, side, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM s),
 gr AS (SELECT id, side, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT id, side, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, range(1, 5) t(n))),
 tf AS (SELECT id, side, n, gram, count(*)::DOUBLE AS c FROM gr GROUP BY ALL),
 held AS (SELECT gram, count(DISTINCT id) AS d FROM tf WHERE side >= 0 GROUP BY gram),
 v AS (SELECT tf.*, c * (ln((SELECT count(*) FROM c)::DOUBLE) - ln(greatest(1, coalesce(d, 0))::DOUBLE)) AS x FROM tf LEFT JOIN held USING (gram)),
 nn AS (SELECT id, side, n, sqrt(sum(x * x)) AS norm, sum(c) AS len FROM v GROUP BY ALL),
 dots AS (SELECT b.id, b.side, b.n, sum(least(a.x, b.x) * b.x) AS dot FROM v a JOIN v b ON a.id = b.id AND a.gram = b.gram AND a.side = -1 AND b.side >= 0 GROUP BY ALL),
 cs AS (SELECT b.id, b.side, sum(CASE WHEN a.norm > 0 AND b.norm > 0 THEN coalesce(dot, 0) / (a.norm * b.norm) ELSE 0 END) AS cosines
        FROM nn b JOIN nn a ON a.id = b.id AND a.n = b.n AND a.side = -1 LEFT JOIN dots d ON d.id = b.id AND d.side = b.side AND d.n = b.n WHERE b.side >= 0 GROUP BY ALL),
 sc AS (SELECT cs.id, cosines / 4 * exp(-pow(coalesce(a.len, 0) - coalesce(b.len, 0), 2) / 72) AS x
        FROM cs LEFT JOIN nn a ON a.id = cs.id AND a.side = -1 AND a.n = 2 LEFT JOIN nn b ON b.id = cs.id AND b.side = cs.side AND b.n = 2),
 ci AS (SELECT c.id, c.g, coalesce((SELECT sum(x) FROM sc WHERE sc.id = c.id) / nullif(len(refs), 0) * 10, 0) AS cider FROM c)"""

_ROUGE = """pairs AS (SELECT c.id, s.side, string_split(c.said, ' ') AS a, string_split(s.text, ' ') AS b FROM c JOIN s ON s.id = c.id AND s.side >= 0),
 dp AS (SELECT id, side, a, b, 0 AS i, list_transform(b, lambda x: 0) AS row FROM pairs
   UNION ALL
   SELECT id, side, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], CASE WHEN b[k] = a[i + 1] THEN 1 + CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END ELSE 0 END))))
   FROM dp WHERE i < len(a)),
 lcs AS (SELECT id, row[len(b)]::DOUBLE / len(a) AS p, row[len(b)]::DOUBLE / len(b) AS r FROM dp WHERE i = len(a)),
 best AS (SELECT id, max(p) AS p, max(r) AS r FROM lcs GROUP BY id),
 ro AS (SELECT c.id, CASE WHEN p > 0 AND r > 0 THEN 2.44::DOUBLE * p * r / (r + 1.44::DOUBLE * p) ELSE 0 END AS rouge_l FROM c LEFT JOIN best USING (id))"""


@query(QUERIES, f"WITH {_CIDER} SELECT id AS conv_id, {r6('cider')} AS cider FROM ci")
def caption_cider(read):
    return captions.cider(_captions(read), "conv_id", "said", "refs")


@query(QUERIES, f"""WITH RECURSIVE {_CIDER}, {_ROUGE}
 SELECT g, count(*) AS captions, {r6('100 * avg(rouge_l)')} AS rouge_l, {r6('100 * avg(cider)')} AS cider FROM ci JOIN ro USING (id) GROUP BY g""")
def caption_scores(read):
    return captions.caption_scores(_captions(read), "conv_id", "said", "refs", ["g"])


# Numbers of the part table written as expressions; the gold one is a little off, by up
# to two percent, so the tolerance decides.
_NUMBERS = """SELECT p_partkey AS id, p_partkey % 8 AS kind, CAST(floor(p_partkey / 8) AS BIGINT) AS t, p_name AS name, CAST(p_size AS BIGINT) AS a, 1 + p_partkey % 7 AS k, CAST(p_partkey * 37 % 401 - 200 AS DOUBLE) / 10000 AS off FROM part"""
_SAID = r"""CASE kind WHEN 0 THEN 'BSfrac{' || a || '}{' || k || '}' WHEN 1 THEN 'x = ' || a || ' BStimes ' || k WHEN 2 THEN 'BSboxed{BSsqrt{' || a || '}}' WHEN 3 THEN a || '%'
 WHEN 4 THEN 'BS( BSleft(' || a || ' - ' || k || 'BSright)^{2}BSpi BS)' WHEN 5 THEN '(' || a || ', ' || k || ')' WHEN 6 THEN '-' || a || '^2 + BSsqrt[3]{' || k * k * k || '}' ELSE name || '.' END"""
_VALUE = """CASE kind WHEN 0 THEN CAST(a AS DOUBLE) / k WHEN 1 THEN a * k WHEN 2 THEN sqrt(CAST(a AS DOUBLE)) WHEN 3 THEN CAST(a AS DOUBLE) / 100 WHEN 4 THEN CAST((a - k) * (a - k) AS DOUBLE) * 314 / 100 WHEN 6 THEN k - a * a END"""
_MICRO = f"CAST(round(({_VALUE}) * (1 + off) * 1000000) AS BIGINT)"


def _numbers(read, *exprs: str):
    columns = ["p_partkey AS id", "p_partkey % 8 AS kind", "CAST(floor(p_partkey / 8) AS BIGINT) AS t", "p_name AS name", "CAST(p_size AS BIGINT) AS a", "1 + p_partkey % 7 AS k", "CAST(p_partkey * 37 % 401 - 200 AS DOUBLE) / 10000 AS off", "char(92) AS bs"]
    return spread(read("part").select("p_partkey", "p_name", "p_size")).selectExpr(*columns).selectExpr("*", *(e.replace("BS", "' || bs || '") for e in exprs))


_GOLD = f"CASE kind WHEN 5 THEN '[' || k || ', ' || (a + t % 2) || ']' WHEN 7 THEN upper(replace(name, ' ', '-')) || CASE WHEN t % 3 = 0 THEN 'x' ELSE '' END ELSE {_MICRO} || 'e-6' END"
_BARE = "replace(replace(replace(lower({}), ' ', ''), '-', ''), '.', '')"


@query(QUERIES, f"""WITH p AS ({_NUMBERS}), v AS (SELECT *, CAST({_VALUE} AS DOUBLE) AS v, {_MICRO} / 1000000::DOUBLE AS g FROM p)
 SELECT id, CAST(CASE kind WHEN 5 THEN abs(least(a, k) - least(a + t % 2, k)) <= least(a + t % 2, k) * 0.01::DOUBLE AND abs(greatest(a, k) - greatest(a + t % 2, k)) <= greatest(a + t % 2, k) * 0.01::DOUBLE
   WHEN 7 THEN {_BARE.format("name")} = {_BARE.format("name")} || CASE WHEN t % 3 = 0 THEN 'x' ELSE '' END ELSE abs(v - g) <= abs(g) * 0.01::DOUBLE END AS DOUBLE) AS score FROM v""")
def expression_numbers(read):
    """Numbers as expressions, in LaTeX or plain, with units, to one percent."""
    return _numbers(read, f"{_SAID} AS said", f"{_GOLD} AS gold").select("id", numerics.numeric_match("said", "gold").alias("score"))


# Polynomials by their coefficients, fractions by their cross products, pairs by both.
_LEFT = r"""CASE kind WHEN 0 THEN '(x+' || a || ')^2' WHEN 1 THEN 'BSfrac{' || a || '}{' || k || '}' WHEN 2 THEN '[' || a || ',' || k || ')' WHEN 3 THEN '(x-y)(x+' || k || 'y)' WHEN 4 THEN a || '.0' WHEN 5 THEN k || ' ' || a || '/60'
 WHEN 6 THEN a || ' meters' ELSE 'BSsqrt{' || a * a * k || '}' END"""
_RIGHT = r"""CASE kind WHEN 0 THEN 'x^2+' || (2 * a + t % 3) || 'x+' || a * a WHEN 1 THEN (a * 3 + t % 2) || '/' || k * 3 WHEN 2 THEN '[' || a || '.0, ' || k || CASE WHEN t % 3 = 0 THEN ']' ELSE ')' END
 WHEN 3 THEN 'x^2 + ' || (k - 1 + t % 2) || 'xBScdot y - ' || k || 'y^{2}' WHEN 4 THEN CAST(a * CASE t % 4 WHEN 0 THEN 100 WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 1 END AS STRING) WHEN 5 THEN (k * 60 + a) || '/60' WHEN 6 THEN a + t % 2 || '' ELSE a || 'BSsqrt{' || (k + t % 2) || '}' END"""


@query(QUERIES, f"""WITH p AS ({_NUMBERS})
 SELECT id, CASE kind WHEN 0 THEN t % 3 = 0 WHEN 1 THEN abs(a * 3 - (a * 3 + t % 2)) <= 0.0001::DOUBLE * (a * 3 + t % 2) WHEN 2 THEN t % 3 <> 0 WHEN 3 THEN t % 2 = 0
     WHEN 4 THEN t % 4 <> 2 WHEN 5 THEN a * (k * 60 + a) = 0 OR k * a = k * 60 + a WHEN 6 THEN false ELSE sqrt(CAST(a * a * k AS DOUBLE)) >= (1 - 0.0001::DOUBLE) * a * sqrt(CAST(k + t % 2 AS DOUBLE)) END AS equal,
   CASE kind WHEN 0 THEN t % 3 = 0 WHEN 1 THEN false WHEN 2 THEN t % 3 <> 0 WHEN 3 THEN t % 2 = 0 WHEN 4 THEN t % 4 IN (1, 3) WHEN 5 THEN true WHEN 6 THEN t % 2 = 0 ELSE t % 2 = 0 END AS graded FROM p""")
def expression_equality(read):
    """Equality of answers as expressions, loosely and strictly graded."""
    return _numbers(read, f"{_LEFT} AS said", f"{_RIGHT} AS gold").select("id", numerics.maths_match("said", "gold").alias("equal"), numerics.graded_match("said", "gold").alias("graded"))


# An order's lines as a table, flags spanning their lines: once as HTML, once as LaTeX,
# where one amount differs.
def _order_tables(read, off: str = "CAST(n AS STRING)", sign: str = ""):
    lines = read("lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", "l_returnflag AS flag", "CAST(l_quantity AS BIGINT) AS n")
    lines = spread(lines, "id")  # the window and the groups keep to these parts
    # The count comes last: it needs no sort of its own then.
    lines = lines.withColumn("at", F.row_number().over(W.partitionBy("id", "flag").orderBy("line", "n"))).withColumn("high", F.count(F.lit(1)).over(W.partitionBy("id", "flag")))
    lines = lines.withColumn("off", F.expr(off))
    html = F.expr(f"""concat('<tr style="x">', if(at = 1, concat('<th rowspan="', high, '"><b>', flag, '</b></th>'), ''), '<td>', line, ' &amp; more</td><td class="n"> {sign}', n, '{sign}</td></tr>')""")
    latex = F.expr("""concat(if(at = 1, concat('\\\\multirow{', high, '}{*}{\\\\textbf{', flag, '}}'), ''), ' & ', line, ' \\\\& more & $', off, '$ \\\\\\\\ \\\\hline ')""")
    rows = lines.select("id", F.struct("flag", "at", "line", html.alias("html"), latex.alias("latex")).alias("r")).groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    joined = lambda form: F.array_join(F.transform("rs", lambda r: r[form]), "")
    head = F.concat(F.lit('<table border="0"><thead><tr><th colspan="2">Order '), F.col("id"), F.lit("</th><th>n<sup>o</sup></th></tr></thead><tbody>"))
    tex = F.concat(F.lit(r"\begin{tabular}{l|cc} \toprule \multicolumn{2}{c}{Order "), F.col("id"), F.lit(r"} & no \\ \midrule "))
    return rows.select("id", F.concat(head, joined("html"), F.lit("</tbody></table>")).alias("html"), F.concat(tex, joined("latex"), F.lit(r"\bottomrule \end{tabular}")).alias("latex"))


_LINES = "l AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS n FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY id, flag ORDER BY line, n) AS nth FROM l)"


@query(QUERIES, rf"""WITH {_LINES},
 g AS (SELECT id, '|Order ' || id || '|Order ' || id || '|no' || string_agg(chr(10) || '|' || flag || '|' || line || ' & more|' || n, '' ORDER BY flag, nth, line) AS html,
              '|Order ' || id || '|Order ' || id || '|no' || string_agg(chr(10) || '|' || flag || '|' || line || ' & more|$' || n || '$', '' ORDER BY flag, nth, line) AS latex FROM w GROUP BY id)
 SELECT id, md5(html) AS html, md5(latex) AS latex, 3 AS width FROM g""")
def table_grids(read):
    """Grids of HTML and LaTeX tables, spans expanded."""
    shown = lambda c: F.md5(F.array_join(F.transform(c, lambda r: F.concat(F.lit("|"), F.array_join(r, "|", "?"))), "\n").cast("binary"))
    df = _order_tables(read).select("id", grids.table_grid("html").alias("h"), grids.table_grid("latex").alias("l"))
    return df.select("id", shown(F.col("h")).alias("html"), shown(F.col("l")).alias("latex"), F.greatest(F.array_max(F.transform("h", F.size)), F.array_max(F.transform("l", F.size))).alias("width"))


@query(QUERIES, rf"""WITH {_LINES},
 c AS (SELECT *, '$' || (CASE WHEN line = 1 THEN n + id % 3 ELSE n END) || '$' AS off, '$' || n || '$' AS own FROM w)
 SELECT id, {r6("1 - sum(levenshtein(own, off)::DOUBLE / greatest(length(own), length(off))) / (count(*) + 1 + 2 * count(*) + count(DISTINCT flag) + 2)")} AS similarity FROM c GROUP BY id""")
def table_forms(read):
    """Similarity of an HTML table and a LaTeX one with an amount changed, both in the
    normal form."""
    df = _order_tables(read, "if(line = 1, n + id % 3, n)", "$")
    return df.select("id", grids.form_similarity("html", "latex").alias("similarity"))


_FORMULA = r"""CASE id % 5 WHEN 0 THEN 'so BS[ BSmathbf{A}_{' || a || '} = BSfrac{' || k || '}{X} BStag{' || a || '} BS] end' WHEN 1 THEN 'BSbegin{aligned}' || name || 'BSend{aligned}.' WHEN 2 THEN '..BStext{' || name || '} BSquad BSqquad x'
 WHEN 3 THEN 'BShspace{' || a || 'cm}BSoperatorname{Sin} ' || k || ' BSarraycolsep=1.4pt}' ELSE name END"""


@query(QUERIES, rf"""WITH p AS ({_NUMBERS.replace("SELECT p_partkey AS id", "SELECT chr(92) AS bs, p_partkey AS id", 1)}), t AS (SELECT id, {_FORMULA.replace("BS", "' || bs || '")} AS t FROM p),
 i AS (SELECT id, CASE WHEN regexp_extract(t, '\\\[(.+?)\\\]', 1) <> '' THEN trim(regexp_extract(t, '\\\[(.+?)\\\]', 1)) ELSE t END AS t FROM t),
 r AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\\(tag|hspace)\{{.*?\}}', '', 'g'), '\\(begin|end)\{{.*?\}}', '', 'g'), '\\arraycolsep.*?\}}', '', 'g'), '.') AS t FROM i)
 SELECT id, lower(replace(regexp_replace(t, '\\(mathbf|text|quad|qquad|operatorname)', '', 'g'), ' ', '')) AS formula FROM r""")
def formula_forms(read):
    """Formulas without what only their looks need."""
    return _numbers(read, f"{_FORMULA} AS f").select("id", grids.normal_formula(F.col("f")).alias("formula"))


# Parts as forms: what was said has its fields in another order, an edited name and, of
# some, no size.
_GOLD_FORM = """'{"item": [{"name": "' || name || '", "type": "' || kind || '"}], "size": ' || size || ', "tags": ["' || brand || '", "", "a"]}'"""
_SAID_FORM = """CASE WHEN id % 4 = 0 THEN 'Here: ```json' || chr(10) ELSE '' END || '{"tags": ["' || brand || '", "a"], ' || CASE WHEN id % 3 = 0 THEN '' ELSE '"size": "' || size || '", ' END || '"item": {"type": "' || kind || '", "name": "'
 || CASE WHEN id % 5 = 0 THEN replace(name, 'e', '') ELSE name END || '"}}' || CASE WHEN id % 4 = 0 THEN chr(10) || '```' ELSE '' END"""
_PARTS = "p AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part)"


def _forms(read):
    columns = ["p_partkey AS id", "p_name AS name", "p_type AS kind", "p_brand AS brand", "CAST(p_size AS STRING) AS size", "char(10) AS nl"]
    said = _SAID_FORM.replace("chr(10)", "nl")
    return spread(read("part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")).selectExpr(*columns).selectExpr("id", "id % 3 AS g", f"{said} AS said", f"{_GOLD_FORM} AS gold")


@query(QUERIES, f"""WITH {_PARTS}, c AS (SELECT id, CASE WHEN id % 5 = 0 THEN levenshtein(name, replace(name, 'e', '')) ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 + length(size) ELSE 0 END AS edits,
   1 + 1 + 1 + length(name) + 1 + length(kind) + 1 + length(size) + 1 + length(brand) + 1 AS whole FROM p)
 SELECT id, {r6("1 - edits::DOUBLE / whole")} AS accuracy FROM c""")
def form_trees(read):
    """Tree-edit accuracy of nested forms."""
    return _forms(read).select("id", forms.tree_accuracy("said", "gold").alias("accuracy"))


@query(QUERIES, f"""WITH {_PARTS}, f AS (
   SELECT id, 'item.name' AS field, name AS gold, CASE WHEN id % 5 = 0 THEN replace(name, 'e', '') ELSE name END AS said FROM p UNION ALL SELECT id, 'item.type', kind, kind FROM p
   UNION ALL SELECT id, 'size', size, CASE WHEN id % 3 = 0 THEN NULL ELSE size END FROM p UNION ALL SELECT id, 'tags', brand, brand FROM p UNION ALL SELECT id, 'tags', 'a', 'a' FROM p)
 SELECT field, count(*) FILTER (said = gold) AS both, CAST(coalesce(sum(CASE WHEN said IS NULL THEN 1 WHEN said <> gold THEN 2 ELSE 0 END), 0) AS BIGINT) AS off,
   {r6("count(*) FILTER (said = gold) / (count(*) FILTER (said = gold) + coalesce(sum(CASE WHEN said IS NULL THEN 1 WHEN said <> gold THEN 2 ELSE 0 END), 0) / 2::DOUBLE + 0.000001::DOUBLE)")} AS f1 FROM f GROUP BY field""")
def form_fields_report(read):
    """Counts and F1 of each field over all forms."""
    return forms.field_report(_forms(read), "said", "gold")


@query(QUERIES, f"""WITH {_PARTS} SELECT id, '{{"item": [{{"name": ["' || name || '"], "type": ["' || kind || '"]}}], "size": ["' || size || '"], "tags": ["' || brand || '", "a"]}}' AS form FROM p""")
def form_order(read):
    """Forms with their fields in order, values in lists, without what is empty."""
    return _forms(read).select("id", forms.canonical_json("gold").alias("form"))
