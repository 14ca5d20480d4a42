"""The driver's queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return short_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its lines that are not blank, those kept and their
    code points, those in a class of more than copies, the first one dropped."""
    from .line_dedup import marked_lines

    marked = marked_lines(_table(spark, sf_dir, "documents"))
    return marked.groupBy("doc_id").agg(F.count("kept").alias("n_lines"), F.count_if("kept").alias("n_kept"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).cast("long").alias("kept_chars"), F.count_if("near").alias("n_near"), F.min(F.when(~F.col("kept"), F.col("pos"))).cast("long").alias("first_dropped"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import read_token_files, write_token_files

    path = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path, digest=True)


#: Weights of the sources in turn, and the share of all sizes that they fill.
MIX = {"weights": [3.0, 1.0, 2.0], "share": 1.5, "epochs": 2.0, "seed": "mix"}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"), **MIX).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fitted, grades_of, scored

    docs = _table(spark, sf_dir, "documents")
    model = fitted(docs, grades_of(_table(spark, sf_dir, "labels")))
    return scored(docs, model).withColumn("kept", F.col("p_top") >= 0.5)


#: The rules of the contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the document it shows; that document's
    labels are the page's: bad is low quality or toxic."""
    from .url_filters import judged_urls, path_of

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})", 1).alias("n")).where("n <> ''").select("page_id", F.col("n").cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") <= 0) | (F.col("toxic") > 0), 1).otherwise(0)
    labels = shown.join(_table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return judged_urls(pages, URL_RULES, labels)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digest of the contract: near_docs, for ids divisible by 100
    the number of documents whose fingerprint is within 3 bits, itself included."""
    from .common import written
    from .fingerprints import edited_fingerprints, neighbours

    prints = written(edited_fingerprints(_table(spark, sf_dir, "documents")), "prints")
    asked = prints.where("doc_id % 100 = 0").select("fingerprint").distinct()
    classes = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    near = neighbours(prints, asked, 3).join(classes.withColumnRenamed("fingerprint", "near"), "near").groupBy("fingerprint").agg(F.sum("n").alias("near_docs"))
    asked = prints.where("doc_id % 100 = 0").join(near, "fingerprint")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_docs"]
    rest = prints.where("doc_id % 100 <> 0 or doc_id is null").withColumn("near_docs", F.lit(None).cast("long"))
    return asked.select(columns).union(rest.select(columns))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scanned

    return scanned(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotated

    return rotated(_table(spark, sf_dir, "conversations")).drop("mask")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import filled

    out = filled(_table(spark, sf_dir, "documents"), "char", seed="1", plain=10, spm=20)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scanned

    out = scanned(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic

    return periodic(_table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict:
    return {
        "op11_fill_middle": op11_fill_middle,
        "op12_secret_scan": op12_secret_scan,
        "op13_periodic_runs": op13_periodic_runs,
        "op1_mixing": op1_mixing,
        "op8_chat": op8_chat,
        "op7_quality": op7_quality,
        "op2_url_filter": op2_url_filter,
        "op3_fingerprints": op3_fingerprints,
        "op4_license_scan": op4_license_scan,
        "op5_decontamination": op5_decontamination,
        "op6_near_dedup": op6_near_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_token_output": op10_token_output,
    }


_MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM s),
c AS (
  SELECT *, sum(cap) OVER up - cap AS before, sum(weight) OVER () - sum(weight) OVER up + weight AS rest_weight
  FROM w WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (total - before) / rest_weight >= cap / weight AS clamped FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap ELSE weight * ((total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT clamped THEN weight END) OVER ()) END AS target
  FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * upto - size <= 2 * rest AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


_CHAT_SQL = r"""
WITH said AS (
  SELECT row_number() OVER () AS line, conv_id, CAST(turn AS BIGINT) AS turn, role, text, sum(length(coalesce(text, '')) + 32) OVER (PARTITION BY conv_id) > 1048576 AS cut
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role IS NOT NULL AND role <> 'system'),
m AS (
  SELECT s.conv_id, p.perspective, CASE WHEN cut THEN CAST(floor(coalesce(turn, 0) / 64) AS BIGINT) ELSE 0 END AS part, turn, role, text, line, coalesce(role = perspective, false) AS mine,
         '<|im_start|>' || CASE WHEN coalesce(role = perspective, false) THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || coalesce(role, 'unknown') END || chr(10) AS head,
         replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' AS body
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY part, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM m)
SELECT conv_id, perspective, part, count(*) AS n_messages, CAST(coalesce(sum(length(body)) FILTER (mine), 0) AS BIGINT) AS n_masked,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT), ',' ORDER BY start) FILTER (mine), '') AS mask_text
FROM o GROUP BY conv_id, perspective, part
"""


_LINES_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
o AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, min((doc_id, pos)) AS first, row_number() OVER (ORDER BY line) AS id, length(line) AS n FROM o GROUP BY line),
e AS (
  SELECT a.id AS u, b.id AS v FROM d a JOIN d b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.id <> b.id
  WHERE least(a.n, b.n) >= 10 AND levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 10)),
r(id, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON r.id = e.u),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
f AS (SELECT d.line, d.n, c.root, min(d.first) OVER (PARTITION BY coalesce(c.root, -d.id)) AS first FROM d LEFT JOIN c USING (id)),
m AS (SELECT l.doc_id, l.pos, f.n, f.root, (l.doc_id, l.pos) = f.first AS kept FROM l LEFT JOIN f USING (line))
SELECT doc_id, count(kept) AS n_lines, count(*) FILTER (kept) AS n_kept, CAST(coalesce(sum(n) FILTER (kept), 0) AS BIGINT) AS kept_chars,
       count(*) FILTER (root IS NOT NULL) AS n_near, CAST(min(pos) FILTER (NOT kept) AS BIGINT) AS first_dropped
FROM m GROUP BY doc_id
"""


def _url_sql() -> str:
    # Six levels of the tree; the operator goes as deep as the paths.
    out = [r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
v AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS e FROM u),
urls AS (
  SELECT page_id, host, path, list_transform(e, lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '*'
         WHEN regexp_matches(s, '^[0-9]+(\.[A-Za-z0-9]+)$') THEN '*' || regexp_extract(s, '^[0-9]+(\.[A-Za-z0-9]+)$', 1)
         WHEN length(s) >= 8 AND regexp_matches(s, '^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$') THEN '*' ELSE s END) AS segs
  FROM v),
known AS (
  SELECT page_id, max(CASE WHEN quality <= 0 OR toxic > 0 THEN 1 ELSE 0 END) AS bad
  FROM (SELECT page_id, regexp_extract(path, '/([0-9]{1,18})', 1) AS n FROM u) s JOIN labels l ON s.n <> '' AND TRY_CAST(s.n AS BIGINT) = l.doc_id GROUP BY page_id),
p0 AS (
  SELECT host, array_to_string(segs, '/') AS path_key, any_value(segs) AS segs, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad
  FROM urls LEFT JOIN known USING (page_id) GROUP BY host, path_key)"""]
    for k in range(1, 7):
        out.append(f""",
h{k} AS (SELECT *, array_to_string(segs[1:{k - 1}], '/') AS prefix, segs[{k}] AS child FROM p{k - 1}),
c{k} AS (SELECT host, prefix, child, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM h{k} WHERE child IS NOT NULL GROUP BY ALL),
j{k} AS (
  SELECT host, prefix, child, children >= 8 AND all_n < 4 * children AND n < 4 AND close AS variable, close AND labelled >= 5 AS alike
  FROM (SELECT *, abs(bad - labelled * share) <= 2.0 * sqrt(labelled * share * (1 - share)) + 1e-9 AS close FROM c{k} JOIN (SELECT host, prefix, count(*) AS children, sum(n) AS all_n, (sum(bad) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS share FROM c{k} GROUP BY ALL) USING (host, prefix))),
w{k} AS (SELECT host, prefix, child FROM (SELECT *, count(*) FILTER (alike) OVER (PARTITION BY host, prefix) AS alikes FROM j{k}) WHERE variable OR (alike AND alikes >= 2)),
p{k} AS (
  SELECT h.host, path_key, CASE WHEN w.child IS NOT NULL THEN list_concat(list_concat(segs[1:{k - 1}], ['*']), segs[{k + 1}:]) ELSE segs END AS segs, n, labelled, bad
  FROM h{k} h LEFT JOIN w{k} w ON h.host = w.host AND h.prefix = w.prefix AND h.child = w.child)""")
    out.append("""
, t AS (SELECT *, '/' || array_to_string(segs, '/') AS template FROM p6),
s AS (
  SELECT host, template, 1 - (bad + 5.0::DOUBLE * ((host_bad + 5.0::DOUBLE * share) / (host_labelled + 5.0::DOUBLE))) / (labelled + 5.0::DOUBLE) AS purity
  FROM (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM t GROUP BY ALL)
  JOIN (SELECT host, sum(labelled) AS host_labelled, sum(bad) AS host_bad FROM t GROUP BY ALL) USING (host),
       (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS share FROM t)),
r AS (
  SELECT page_id, host, path, template, purity,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM (SELECT *, array_to_string(segs, '/') AS path_key FROM urls) JOIN (SELECT host, path_key, template FROM t) USING (host, path_key) JOIN s USING (host, template))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN purity < 0.5 THEN 'block' ELSE 'allow' END AS verdict, template, purity
FROM r
""")
    return "".join(out)


_FILL_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS u, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS v,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (SELECT *, substr(text, 1, least(u, v)) AS a, substr(text, least(u, v) + 1, greatest(u, v) - least(u, v)) AS b, substr(text, greatest(u, v) + 1) AS c FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN least(u, v) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(u, v) - least(u, v) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _secret_sql() -> str:
    """Spans by the pieces between matches; windows one by one from the definition
    of entropy."""

    def spans(table: str, pattern: str) -> str:
        # 2 * i + 1 .. : pieces and matches take turns, so a match starts where the
        # pieces up to it and the matches before it end.
        return f"""SELECT key, i, sum(gap) OVER w + sum(n) OVER w - n AS start, sum(gap) OVER w + sum(n) OVER w AS stop, m AS text
  FROM (SELECT key, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, length(unnest(ms)) AS n, length(unnest(list_slice(ps, 1, len(ms)))) AS gap
        FROM (SELECT key, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM {table}))
  WINDOW w AS (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING)"""

    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    classes = [
        ("hexrun", 3, "[0-9A-Fa-f]{20,}", "3.2::DOUBLE", True, ["[0-9]", "[A-Fa-f]"]),
        ("base32run", 4, "[A-Z2-7]{20,}", "3.5::DOUBLE", False, ["[2-7]", "[A-Z]"]),
        ("base64run", 5, "[A-Za-z0-9+/_-]{20,}", "3.9::DOUBLE", False, ["[0-9]", "[A-Z]", "[a-z]"]),
    ]
    out = [f"""
WITH t AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text FROM documents),
assign AS ({spans("t", assign)}),
access AS ({spans("t", "AKIA[A-Z0-9]+")}),
hex AS ({spans("t", "[0-9a-f]+")}),
all0 AS (
  SELECT key, 0 AS k, start, stop FROM assign WHERE length(regexp_extract(text, '{assign}', 2)) >= 6
  UNION ALL SELECT key, 1, start, stop FROM access WHERE stop - start >= 20 UNION ALL SELECT key, 2, start, stop FROM hex WHERE stop - start >= 24),
c0 AS ({spans("t", "[A-Za-z0-9+/_-]{20,}")}),
c AS (
  SELECT c0.key AS doc, row_number() OVER () AS key, start, c0.text FROM c0 JOIN t ON t.key = c0.key
  WHERE NOT regexp_matches(c0.text, '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}$')
    AND NOT regexp_matches(c0.text, '^[/_+-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([/_+-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_+-]*$')
    AND NOT regexp_matches(lower(c0.text), 'abcdefgh|01234567|12345678|qwertyui|example|placeholder|changeme|dummy|redacted|x{{8}}')
    AND NOT coalesce(start >= 7 AND substr(t.text, CAST(start AS BIGINT) - 6, 7) = 'base64,', false))"""]
    for before, (name, k, pattern, bits, folded, needs) in enumerate(classes):
        char = "lower(substr(r.text, CAST(w.o + x.j AS BIGINT), 1))" if folded else "substr(r.text, CAST(w.o + x.j AS BIGINT), 1)"
        need = " AND ".join(f"regexp_matches(substr(r.text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)), '{x}')" for x in needs)
        out.append(f"""
{name}_r AS ({spans("c", pattern)}),
{name}_w AS (SELECT key, i, start, text, unnest(range(0, CAST(length(text) - 19 AS BIGINT))) AS o FROM {name}_r),
{name}_h AS (
  SELECT key, i, o FROM (
    SELECT w.key, w.i, w.o, {char} AS ch, count(*) AS n FROM {name}_w w JOIN {name}_r r ON r.key = w.key AND r.i = w.i CROSS JOIN range(1, 21) x(j) GROUP BY ALL)
  GROUP BY key, i, o
  HAVING sum(round(n * log2(n) * 1048576)) <= floor((log2(20) - {bits}) * 20 * 1048576)),
{name}_g AS (SELECT *, sum(CASE WHEN o > last + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY key, i ORDER BY o) AS grp FROM (SELECT *, lag(o) OVER (PARTITION BY key, i ORDER BY o) AS last FROM {name}_h)),
{name}_s AS (
  SELECT c.doc AS key, {k} AS k, c.start + r.start + a AS start, c.start + r.start + b AS stop
  FROM (SELECT key, i, min(o) AS a, max(o) + 20 AS b FROM {name}_g GROUP BY key, i, grp) g JOIN {name}_r r ON r.key = g.key AND r.i = g.i JOIN c ON c.key = g.key WHERE {need}),
all{before + 1} AS (
  SELECT key, k, start, stop FROM all{before} UNION ALL
  SELECT key, k, start, stop FROM {name}_s s WHERE NOT EXISTS (SELECT 1 FROM all{before} b WHERE b.key = s.key AND b.start < s.stop AND s.start < b.stop))""")
    show = "string_agg(['assign', 'access', 'hex', 'hexrun', 'base32run', 'base64run'][k + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k)"
    last = f"""
SELECT t.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce({show} FILTER (k < 3), '')) AS base_sha256, coalesce({show} FILTER (k IS NOT NULL), '') AS spans
FROM t LEFT JOIN all3 s ON s.key = t.key GROUP BY t.key, t.doc_id"""
    return ",".join(out) + last


def oracles() -> dict[str, str]:
    return {"op1_mixing": _MIXING_SQL, "op2_url_filter": _url_sql(), "op8_chat": _CHAT_SQL, "op9_line_dedup": _LINES_SQL, "op11_fill_middle": _FILL_SQL, "op12_secret_scan": _secret_sql()}
