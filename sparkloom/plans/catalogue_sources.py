"""Readers, writers, streams and users' own modules: what a query writes from its tables
it reads again, and the twin says from the tables what must come back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extend
from ..sources import annotations, files, io
from ..sources.scratch import work_folder
from ..streaming import windows
from ..streaming.loader import Loader, step_writer
from .common import query, r6, spread

QUERIES: dict = {}


def _folder(df: DataFrame, name: str) -> str:
    return work_folder(df.sparkSession, name)


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _orders(read):
    return read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


# --------------------------------------------------------------- tables and lines


def _lines(read, bad: bool) -> str:
    """Orders as JSON lines with blank ones between, and some that are no objects."""
    df = _orders(read)
    line = F.to_json(F.struct("*"))
    if bad:
        line = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit('{"o_orderkey": '), "o_orderkey")).when(F.col("o_orderkey") % 50 == 1, F.concat(F.lit("["), "o_orderkey", F.lit("]"))).otherwise(line)
    lines = df.select(F.when(F.col("o_orderkey") % 10 == 3, F.concat(line, F.lit("\n  \n"))).otherwise(line).alias("value"))
    path = _folder(df, "lines") + "/rows.jsonl"
    lines.write.text(path)
    return path


@query(QUERIES, _ORDERS)
def jsonl_rows(read):
    spark = read("orders").sparkSession
    return io.read_jsonl(spark, _lines(read, False), "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query(QUERIES, """SELECT CASE WHEN o_orderkey % 50 = 0 THEN '{"o_orderkey": ' || o_orderkey ELSE '[' || o_orderkey || ']' END AS text FROM orders WHERE o_orderkey % 50 < 2""")
def jsonl_bad_lines(read):
    return io.bad_lines(read("orders").sparkSession, _lines(read, True)).select("text")


@query(QUERIES, "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY o_orderstatus")
def parquet_folders(read):
    """A folder of folders, searched through."""
    df = _orders(read)
    path = _folder(df, "folders")
    for k in range(3):
        df.where(F.col("o_orderkey") % 3 == k).write.parquet(f"{path}/a{k % 2}/part{k}.parquet")
    return io.read_table(df.sparkSession, path, columns=["o_orderstatus", "o_custkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"))


@query(QUERIES, f"{_ORDERS} WHERE o_orderkey % 5 < 2")
def parquet_shards(read):
    """The first two shards by name."""
    df = _orders(read)
    path = _folder(df, "shards") + "/in"
    df.withColumn("shard", F.concat(F.lit("train-0"), F.col("o_orderkey") % 5)).write.partitionBy("shard").parquet(path)
    return io.read_shards(df.sparkSession, path, 2, "shard=train-*")


@query(QUERIES, f"{_ORDERS} UNION ALL {_ORDERS} WHERE o_orderkey % 2 = 0")
def nested_tables(read):
    """Fields of a struct column of two tables."""
    df = _orders(read).select(F.struct(F.struct("*").alias("row")).alias("data"))
    path = _folder(df, "nested")
    df.write.parquet(f"{path}/a.parquet")
    df.where("data.row.o_orderkey % 2 = 0").write.parquet(f"{path}/b.parquet")
    return io.read_table(df.sparkSession, [f"{path}/a.parquet", f"{path}/b.parquet"], key="data.row")


@query(QUERIES, _ORDERS)
def json_records(read):
    """A column of JSON objects, parsed."""
    df = _orders(read)
    path = _folder(df, "records") + "/r.parquet"
    df.select(F.to_json(F.struct("*")).alias("record_json"), F.lit("not read").alias("other")).write.parquet(path)
    return io.read_records(df.sparkSession, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query(QUERIES, """SELECT item_id, md5(text || chr(10) || '"' || item_id || '",' || chr(9)) AS text, kind FROM benchmark, (VALUES ('csv'), ('tsv')) k(kind)""")
def quoted_texts(read):
    """Texts with quotes, separators and line ends through csv and tsv."""
    df = read("benchmark").select("item_id", F.concat("text", F.lit('\n"'), "item_id", F.lit('",\t')).alias("text"))
    path, out = _folder(df, "quoted"), []
    for kind in ("csv", "tsv"):
        io.write_table(df, f"{path}/t.{kind}")
        out.append(io.read_table(df.sparkSession, f"{path}/t.{kind}", "item_id long, text string").select("item_id", F.md5(F.col("text").cast("binary")).alias("text"), F.lit(kind).alias("kind")))
    return out[0].union(out[1])


@query(QUERIES, "SELECT 'page-' || item_id || '.md' AS name, md5('# ' || item_id || chr(10) || text || chr(10)) AS text FROM benchmark")
def markdown_pages(read):
    """Pages written as files, read whole."""
    df = read("benchmark").select(F.concat(F.lit("docs/page-"), "item_id", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "item_id", F.lit("\n"), "text", F.lit("\n")).cast("binary").alias("bytes"))
    path = _folder(df, "pages")
    files.write_files(df, path)
    return io.read_pages(df.sparkSession, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5(F.col("text").cast("binary")).alias("text"))


@query(QUERIES, f"SELECT * FROM ({_ORDERS} ORDER BY o_orderkey LIMIT 10) UNION ALL {_ORDERS} WHERE o_orderkey = 12")
def first_rows_and_lookup(read):
    df = _orders(read)
    return io.first_rows(df, 10, "o_orderkey").union(io.lookup(df, "o_orderkey", 12))


@query(QUERIES, "SELECT shard, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, o_orderkey % 4 AS shard FROM orders WHERE o_orderstatus <> 'F') GROUP BY shard")
def filtered_shards(read):
    """Kept rows in a folder for each file that they come from."""
    df = _orders(read)
    spark, path = df.sparkSession, _folder(df, "shards")
    for k in range(4):
        df.where(F.col("o_orderkey") % 4 == k).coalesce(1).write.parquet(f"{path}/in/s{k}")
    scan = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/in").select("*", "_metadata")
    io.write_filtered_shards(scan.where("o_orderstatus <> 'F'"), f"{path}/out")
    out = spark.read.parquet(f"{path}/out").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.min(F.col("o_orderkey") % 4).alias("k"), F.max(F.col("o_orderkey") % 4).alias("l"))
    return out.where("k = l").select(F.col("k").alias("shard"), "n", "keys")


@query(QUERIES, "SELECT o_orderkey % 3 AS step, o_orderkey, o_orderstatus FROM orders")
def rollout_steps(read):
    """Rollouts in a folder of JSON lines for each step, appended step by step."""
    df = _orders(read).select((F.col("o_orderkey") % 3).alias("step"), "o_orderkey", "o_orderstatus")
    path = _folder(df, "steps")
    for k in range(3):
        io.write_steps(df.where(F.col("step") == k), path)
    return df.sparkSession.read.schema("o_orderkey long, o_orderstatus string, step long").json(path).select("step", "o_orderkey", "o_orderstatus")


@query(QUERIES, f"""WITH m AS (SELECT o_orderstatus, avg(o_totalprice) AS price, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
 SELECT o_orderstatus, 'price' AS metric, {r6('price')} AS value FROM m UNION ALL SELECT o_orderstatus, 'n', n FROM m""")
def metric_rows(read):
    return io.flat_metrics(read("orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n")), ["o_orderstatus"])


@query(QUERIES, """SELECT '[' || string_agg('{"status": "' || s || '", "n": ' || n || ', "note": null}', ', ' ORDER BY s) || ']' AS summary FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)""")
def summary_report(read):
    df = read("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("note", F.lit(None).cast("string")).orderBy("status")
    return df.sparkSession.createDataFrame([(io.summary_json(df),)], "summary string")


@query(QUERIES, "SELECT c_custkey AS index, c_name AS question, c_custkey < 20 AS smoke FROM customer")
def checked_table(read):
    """A file known by its MD5 with a column of an old name, and its first rows apart."""
    df = read("customer").select("c_custkey", "c_name")
    spark, path = df.sparkSession, _folder(df, "checked")
    io.write_with_smoke(df, f"{path}/all.json", f"{path}/smoke.json", 20, "c_custkey")
    body = df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: F.concat(r["c_custkey"], F.lit("\t"), r["c_name"])), "\n").alias("b"))
    files.write_files(body.select(F.lit("t.tsv").alias("path"), F.concat(F.lit("index\tquery\n"), "b", F.lit("\n")).cast("binary").alias("bytes")), path)
    table = io.read_checked(spark, f"{path}/t.tsv", io.file_md5(spark, f"{path}/t.tsv"), {"query": "question"}, "index long, query string")
    smoke = io.read_table(spark, f"{path}/smoke.json", "c_custkey long, c_name string").select(F.col("c_custkey").alias("k"), F.lit(True).alias("s"))
    return table.join(smoke, F.col("index") == F.col("k"), "left").select("index", "question", F.coalesce("s", F.lit(False)).alias("smoke"))


# ------------------------------------------------------------ caches and streams


@query(QUERIES, f"SELECT s_suppkey, {r6('s_acctbal * 2')} AS twice, s_suppkey % 2 = 0 AS first_run FROM supplier")
def resumed_map(read):
    """A map over a part of the keys, then over all: what is in the cache is not done again."""
    df = read("supplier").select("s_suppkey", "s_acctbal")
    cache = _folder(df, "cache") + "/c"
    work = lambda first: lambda rows: rows.select("s_suppkey", (F.col("s_acctbal") * 2).alias("twice"), F.lit(first).alias("first_run"))
    io.mapped_once(df.where("s_suppkey % 2 = 0"), "s_suppkey", cache, work(True)).count()
    return io.mapped_once(df, "s_suppkey", cache, work(False))


@query(QUERIES, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 100")
def filled_batch(read):
    """Generated rows kept until a batch is full; the stream starts again on another checkpoint."""
    df = read("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    path = _folder(df, "until")
    df.write.parquet(f"{path}/in")
    for run in range(2):
        stream = df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/in")
        windows.run_until_full(stream, f"{path}/out", 100, f"{path}/checkpoint{run}", lambda rows: rows.where("c_acctbal > 0"), ["c_custkey"])
    return df.sparkSession.read.parquet(f"{path}/out").select("c_custkey", "c_mktsegment")


@query(QUERIES, """WITH c AS (SELECT c_custkey, count(*) OVER () AS n FROM customer)
 SELECT epoch, count(*) AS rows, count(DISTINCT c_custkey) AS customers, sum(c_custkey)::BIGINT AS keys, CAST(ceil(any_value(n) / ceil(any_value(n) / 6.0)) AS BIGINT) AS steps FROM c, range(2) e(epoch) GROUP BY epoch""")
def resumed_steps(read):
    """Two epochs of training steps, stopped and taken up again: every row once in each."""
    df = read("customer").select(F.col("c_custkey").alias("pos"), "c_mktsegment")
    path = _folder(df, "steps")
    size = -(-df.count() // 6)
    for stop in (1, 2, None):
        Loader(df, f"{path}/state", size, epochs=2, seed=7).run(step_writer(f"{path}/out"), at_once=3, stop_after=stop)
    out = df.sparkSession.read.parquet(f"{path}/out")
    return out.groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pos").alias("customers"), F.sum("pos").alias("keys"), F.countDistinct("step").alias("steps"))


# --------------------------------------------------------------- files and images


@query(QUERIES, """WITH f AS (SELECT 'n' || s_nationkey || '/' || s_suppkey || '.bin' AS name, repeat(s_name || ';', 1 + CAST(s_suppkey % 40 AS INTEGER)) AS body FROM supplier)
 SELECT name, length(body)::BIGINT AS size, md5(body) AS md5, (SELECT count(*) FROM f) AS written, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 0) AS skipped FROM f""")
def written_files(read):
    """Cells as files: two thirds are there when all are written, the rest has another size."""
    df = read("supplier").select(F.concat(F.lit("n"), "s_nationkey", F.lit("/"), "s_suppkey", F.lit(".bin")).alias("path"), F.expr("repeat(concat(s_name, ';'), cast(1 + s_suppkey % 40 as int))").cast("binary").alias("bytes"), "s_suppkey")
    root = _folder(df, "files")
    spark = df.sparkSession
    first = files.write_files(df.withColumn("bytes", F.when(F.col("s_suppkey") % 3 == 0, F.lit("short").cast("binary")).otherwise(F.col("bytes"))), root)
    second = files.extracted(df, root)
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))
    return got.select(name.alias("name"), F.col("length").alias("size"), F.md5("content").alias("md5"), F.lit(first["written"]).alias("written"), F.lit(second["skipped"]).alias("skipped"))


@query(QUERIES, """SELECT item_id AS index, CASE WHEN item_id % 4 = 1 THEN item_id - 1 ELSE item_id END || '.jpg' AS image_path, md5((SELECT text FROM benchmark b WHERE b.item_id = CASE WHEN a.item_id % 4 = 1 THEN a.item_id - 1 ELSE a.item_id END)) AS md5 FROM benchmark a""")
def localised_images(read):
    """Base64 images moved to files; some rows name the row whose image they show."""
    df = read("benchmark").select(F.col("item_id").alias("index"), F.when(F.col("item_id") % 4 == 1, (F.col("item_id") - 1).cast("string")).otherwise(F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")).alias("image"))
    root = _folder(df, "images")
    out = files.localised(df, root)
    got = df.sparkSession.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"))
    return out.select("index", F.element_at(F.split("image_path", "/"), -1).alias("image_path")).join(got, F.col("image_path") == F.col("name")).select("index", "image_path", "md5")


# Boxes of parts, an archive for each size: some end before they begin, some leave the
# picture, some are no boxes.
_BOX = """CASE id % 7 WHEN 0 THEN '5,' || k || ',4,9,0.5,' || name WHEN 1 THEN id || ',1,' || (id + k) || ',20,1,"' || name || '"' WHEN 2 THEN name WHEN 3 THEN '1,2,3,' || k || ',0.25,' WHEN 4 THEN '-1,0,10,' || k || ',0,###' WHEN 5 THEN '1,2,3,4,1x5,' || name
 ELSE ' ' || k || ' , 1, ' || (k + 5) || ' ,9, 0.75 ,' || name || ', more' END"""


@query(QUERIES, f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_size AS k FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY k, id % 2 ORDER BY id) AS line,
   CASE id % 7 WHEN 0 THEN [5, k, 4, 9] WHEN 1 THEN [id, 1, id + k, 20] WHEN 3 THEN [1, 2, 3, k] WHEN 4 THEN [-1, 0, 10, k] WHEN 6 THEN [k, 1, k + 5, 9] END AS box FROM p),
 e AS (SELECT *, CASE WHEN id % 7 = 2 THEN 'format' WHEN box[3] < box[1] THEN 'xmax before xmin' WHEN box[4] < box[2] THEN 'ymax before ymin' WHEN id % 7 = 5 THEN 'confidence' WHEN least(box[1], box[2]) < 0 OR greatest(box[1], box[3]) > 1000 OR greatest(box[2], box[4]) > 30 THEN 'outside of the picture' END AS error FROM b)
 SELECT k AS archive, 'gt_' || id % 2 AS name, line, error, CASE WHEN error IS NULL THEN array_to_string(list_transform(box, lambda x: CAST(x AS INTEGER)), ',') END AS points, CASE WHEN error IS NULL THEN CASE id % 7 WHEN 1 THEN name WHEN 3 THEN '' WHEN 4 THEN '###' ELSE name || ', more' END END AS transcription FROM e""")
def annotation_lines(read):
    """Boxes with confidence and text from ZIP archives, each bad line with its error."""
    import io as bytes_io
    import zipfile

    df = read("part").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS k").selectExpr("id", "k", "id % 2 AS half", f"{_BOX} AS text")
    bodies = df.groupBy("k", "half").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda r: r["text"]), "\r\n").alias("body")).groupBy("k").agg(F.collect_list(F.struct("half", "body")).alias("bodies"))

    @F.pandas_udf("binary")
    def zipped(entries):
        def one(rows):
            out = bytes_io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("readme.md", "not read")
                for r in rows:
                    z.writestr(f"gt_{r['half']}.txt", r["body"])
            return out.getvalue()

        return entries.map(one)

    archives = bodies.select(F.concat("k", F.lit(".zip")).alias("path"), zipped("bodies").alias("content"))
    lines = annotations.archive_lines(archives, r"(gt_\d)\.txt")
    out = annotations.annotations(lines, transcription=True, confidence=True, width=1000, height=30)
    shown = F.array_join(F.transform("points", lambda x: x.cast("int").cast("string")), ",")
    return out.select(F.split("path", r"\.")[0].cast("int").alias("archive"), "name", "line", "error", F.when(F.col("error").isNull(), shown).alias("points"), "transcription")


@query(QUERIES, f"""WITH p AS (SELECT p_partkey AS id, (p_partkey % 10)::DOUBLE AS x, (p_size % 10)::DOUBLE AS y, (1 + p_partkey % 4)::DOUBLE AS w, (1 + p_size % 3)::DOUBLE AS h FROM part),
 i AS (SELECT *, greatest(0, least(x + w, 8) - greatest(x, 3)) * greatest(0, least(y + h, 6) - greatest(y, 2)) AS shared FROM p)
 SELECT id, {r6("shared / (w * h + 20 - shared)")} AS box, {r6("shared / (w * h + 20 - shared)")} AS corners FROM i""")
def box_overlaps(read):
    """Overlap of boxes as polygons, given as boxes and as corners in either direction."""
    df = spread(read("part").select("p_partkey", "p_size")).selectExpr("p_partkey AS id", "double(p_partkey % 10) AS x", "double(p_size % 10) AS y", "double(1 + p_partkey % 4) AS w", "double(1 + p_size % 3) AS h")
    fixed = F.array(*[F.lit(v) for v in (3.0, 2.0, 8.0, 6.0)])
    box = F.expr("array(x, y, x + w, y + h)")
    turned = F.expr("array(x, y, x, y + h, x + w, y + h, x + w, y)")
    return df.select("id", annotations.overlap(annotations.corners(box), annotations.corners(fixed)).alias("box"), annotations.overlap(turned, annotations.corners(fixed)).alias("corners"))


# ------------------------------------------------------------- users' own modules


@query(QUERIES, f"""WITH p AS (SELECT item_id, text AS gold, CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 40) ELSE text || ' more' END AS said FROM benchmark),
 w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(gold, '\\s+'), lambda x: x <> '')) AS g, list_distinct(list_filter(string_split_regex(said, '\\s+'), lambda x: x <> '')) AS s FROM p)
 SELECT item_id, {r6("len(list_intersect(g, s))::DOUBLE / len(g) + CASE WHEN item_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END")} AS score FROM w""")
def user_scores(read):
    """Rows scored by a function of a file that is shipped to the tasks."""
    df = read("benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("source"), F.when(F.col("item_id") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.concat("text", F.lit(" more"))).alias("said"), F.col("text").alias("gold"))
    scorer = extend.user_scorer(df.sparkSession, os.path.join(os.path.dirname(__file__), "sample_scorer.py"), "score", bonus=0.5)
    return df.select("item_id", scorer("source", "said", "gold").alias("score"))


class _Parts(extend.Dataset):
    """Parts as questions about their brand: the hooks of a dataset."""

    def __init__(self, table: DataFrame):
        self.table = table
        super().__init__(table.sparkSession, "parts")

    @classmethod
    def supported(cls):
        return ["parts"]

    def load(self, name):
        return self.table

    def post_build(self, data):
        return data.where("p_size > 5").select(F.col("p_partkey").alias("index"), F.concat(F.lit("Brand of "), "p_name", F.lit("?")).alias("question"), F.col("p_brand").alias("answer"), F.when(F.col("p_size") % 2 == 0, F.concat("p_partkey", F.lit(".jpg"))).alias("image_path"))

    def evaluate(self, predictions):
        both = predictions.join(self.data, "index")
        return both.groupBy("answer").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("answer")).cast("double")).alias("acc"))


@query(QUERIES, f"""WITH d AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#1' ELSE p_brand END AS said FROM part WHERE p_size > 5)
 SELECT p_brand AS answer, count(*) AS n, {r6("avg((said = p_brand)::INTEGER)")} AS acc, sum(1 + (p_size % 2 = 0)::INTEGER)::BIGINT AS messages FROM d GROUP BY p_brand""")
def dataset_hooks(read):
    """A dataset's table, prompts and report through its hooks."""
    parts = _Parts(read("part"))
    said = parts.data.select("index", F.when(F.col("index") % 3 == 0, "Brand#1").otherwise(F.col("answer")).alias("prediction"))
    messages = parts.prompts(parts.data).groupBy(F.col("answer").alias("brand")).agg(F.sum(F.size("messages")).alias("messages"))
    return parts.evaluate(said).join(messages, F.col("answer") == F.col("brand")).drop("brand")
