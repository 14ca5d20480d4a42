"""What the catalogue's modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


NUDGE = 1.23e-8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows over all cores, before work that is long for each row: a table of few bytes
    is read by one task or two, and a small shuffle is joined to as few."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def rounded(df: DataFrame) -> DataFrame:
    """Double columns with six digits and no negative zero; the nudge keeps values
    that end in an exact half from rounding by their last bit."""
    return df.select(*[(F.round(F.col(f"`{c}`") + F.lit(NUDGE), 6) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(into: dict, sql: str | None = None):
    """Decorator: registers ``fn(read)`` by its name, where ``read(name)`` gives
    a table; ``sql`` is the twin."""

    def add(fn):
        def run(spark, sf_dir):
            return rounded(fn(lambda name: table(spark, sf_dir, name)))

        run.__doc__ = fn.__doc__
        into[fn.__name__] = (run, sql)
        return fn

    return add


def responses(read, *more) -> DataFrame:
    """Responses (uid, pos, score, length) of lineitem, and ``more`` columns."""
    return read("lineitem").select(*more, F.col("l_orderkey").alias("uid"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("length"), F.col("l_suppkey").alias("tie"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))


RESPONSES = "r AS (SELECT l_orderkey AS uid, CAST(l_linenumber AS BIGINT) AS pos, l_discount AS score, l_quantity AS length, l_suppkey AS tie, l_extendedprice AS price, l_tax AS tax FROM lineitem)"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE}::DOUBLE, 6) + 0.0::DOUBLE"
