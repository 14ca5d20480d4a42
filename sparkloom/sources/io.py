"""Readers and writers of the tables that the operators take."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import is_object

_FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "orc": "orc", "txt": "text"}


def read_table(spark: SparkSession, path: str | list[str], schema: str | None = None, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """A table by its suffix, or the rows of several; parquet folders are searched
    through, and one without any fails.  ``key``: the name of a struct column, or
    dotted names, whose fields are the table."""
    if not isinstance(path, str):
        tables = [read_table(spark, p, schema, columns, key) for p in path]
        if not tables:
            raise ValueError("no paths")
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    if suffix not in _FORMATS:
        raise ValueError(f"no reader for .{suffix}")
    reader = spark.read.format(_FORMATS[suffix])
    if schema:
        reader = reader.schema(schema)
    if suffix in ("csv", "tsv"):
        reader = reader.options(header=True, sep="\t" if suffix == "tsv" else ",", multiLine=True, escape='"')
    if suffix == "parquet":
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path)
    if key:
        df = df.select(f"{key}.*")
    return df.select(*columns) if columns else df


def file_md5(spark: SparkSession, path: str) -> str:
    """MD5 of a file as Spark reads it; it must fit a row."""
    found = spark.read.format("binaryFile").load(path).select(F.md5("content")).take(2)
    if len(found) != 1:
        raise ValueError(f"{path} is not one file")
    return found[0][0]


def read_checked(spark: SparkSession, path: str, md5: str | None = None, renamed: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """A table whose file has the MD5 ``md5``; another file is an error.  Columns of old
    names get their new ones."""
    if md5 is not None and (found := file_md5(spark, path)) != md5:
        raise ValueError(f"{path} has MD5 {found}, not {md5}")
    return read_table(spark, path, schema).withColumnsRenamed(renamed or {})


def read_shards(spark: SparkSession, path: str, n: int, pattern: str = "train-*.parquet") -> DataFrame:
    """The first ``n`` files of a folder that fit ``pattern``, by name."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    names = sorted(f.getPath().toString() for f in found or [])[:n]
    if not names:
        raise ValueError(f"no {pattern} in {path}")
    return spark.read.parquet(*names)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text or Markdown files, a row for each."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with a key; none fails."""
    out = df.where(F.col(key) == F.lit(value))
    if out.isEmpty():
        raise KeyError(value)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines. Strict: any bad or blank line fails the query; else blank
    lines go and a bad line fails with its file and text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    if not strict:
        lines = lines.where("trim(value) <> ''")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    # An object only: from_json gives a struct of nulls for anything else.
    good = is_object(F.col("value"))
    return lines.select(F.when(good, parsed).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": bad JSON line: "), F.substring("value", 1, 200)))).alias("r")).select("r.*")


def read_records(spark: SparkSession, path: str, schema: str, column: str = "record_json") -> DataFrame:
    """One column of JSON objects of a parquet table, parsed; nulls and other
    than objects fail the query."""
    text = spark.read.parquet(path).select(column)
    good = is_object(F.col(column))
    return text.select(F.when(good, F.from_json(column, schema)).otherwise(F.raise_error(F.lit(f"{column} is not an object"))).alias("r")).select("r.*")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def first_rows(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first n rows by position; fewer are an error."""
    out = df.orderBy(pos).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return out


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of the lines of JSON files that hold no object; a file
    must fit a row."""
    pages = read_pages(spark, path)
    lines = pages.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where("trim(text) <> ''").where(~is_object(F.col("text"))).select("path", (F.col("line") + 1).alias("line"), "text")


def output_name(path: str, suffix: str, kind: str = "jsonl") -> str:
    """The name of a result beside its input: the input's without its ending, an
    underscore, ``suffix`` and the ending of ``kind``."""
    folder, _, name = path.rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return (folder + "/" if folder else "") + f"{stem}_{suffix}.{kind}"


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "error", refuse_empty: bool = False) -> None:
    """By suffix or kind; csv and tsv quote every field."""
    if refuse_empty and df.isEmpty():
        raise ValueError("an empty table is not written")
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in _FORMATS:
        raise ValueError(f"no writer for {kind}")
    writer = df.write.mode(mode).format(_FORMATS[kind])
    if kind in ("csv", "tsv"):
        writer = writer.options(header=True, sep="\t" if kind == "tsv" else ",", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if kind == "parquet":
        writer = writer.option("compression", "zstd")
    writer.save(path)


def write_with_smoke(df: DataFrame, path: str, smoke: str, rows: int, order: str) -> None:
    """JSON lines of a table, and of its first ``rows`` rows by ``order`` in a folder of
    their own, which tests of what reads them take."""
    for kept, at in ((df, path), (df.orderBy(order).limit(rows), smoke)):
        kept.write.mode("overwrite").json(at)


def write_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """Rollouts as JSON lines, a folder for each step."""
    df.write.mode("append").partitionBy(step).json(path)


#: Rows of the largest summary.
LONGEST_SUMMARY = 10_000


def summary_json(df: DataFrame, most: int = LONGEST_SUMMARY) -> str:
    """A small aggregate as one JSON text; more than ``most`` rows are refused."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a summary of more than {most} rows")
    return json.dumps([json.loads(r[0]) for r in rows], ensure_ascii=False)


def flat_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, metric, value) of a wide metric table."""
    names = [c for c in df.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(*keys, F.inline(pairs))


def write_filtered_shards(df: DataFrame, path: str) -> None:
    """Rows of a filtered file scan, in a folder for each input file they come from
    (shard=<file name>), as Parquet under zstd.  ``df`` must hold the scan's
    ``_metadata`` column, which is left out."""
    df.withColumn("shard", F.col("_metadata.file_name")).drop("_metadata").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def mapped_once(df: DataFrame, key: str, cache: str, fn) -> DataFrame:
    """``fn(rows)`` for the rows whose key is not yet in the Parquet cache; its result,
    which has the key, is appended to the cache, and the cache's rows for ``df``'s keys come
    back.  Run again after a failure it goes on where it stopped; a key that two runs
    added at once is read once."""
    spark = df.sparkSession
    new = df
    try:
        new = df.join(spark.read.parquet(cache).select(key).distinct(), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    fn(new).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).dropDuplicates([key]).join(df.select(key).distinct(), key, "left_semi")
