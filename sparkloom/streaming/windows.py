"""Event-time windows and trace aggregates, for streams and batches alike."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    return sliding(df, ts, size, None, by, value, late)


def sliding(df: DataFrame, ts: str, size: str, step: str | None, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and sum by window; ``late`` sets the watermark of a stream."""
    if late:
        df = df.withWatermark(ts, late)
    w = F.window(ts, size, step) if step else F.window(ts, size)
    return df.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Runs of events of a key with gaps shorter than ``gap``."""
    if late:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def run_until_full(stream: DataFrame, sink: str, wanted: int, checkpoint: str, keep: Callable[[DataFrame], DataFrame], order: list[str] | None = None) -> None:
    """Micro-batches are filtered by ``keep`` and appended until ``wanted`` rows are
    in ``sink``; later ones are passed over unread.  The rows there count, also after a
    restart or from another checkpoint; a batch that is replayed overwrites its own folder
    with the same rows, those first by ``order`` (columns without ties; else by a hash
    of all columns)."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    full = threading.Event()

    def rows_but(spark, folder):
        try:
            return spark.read.parquet(sink).where(F.col("batch") != folder).count()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0

    def add(batch, number):
        if full.is_set():
            return
        folder = f"q{run}-{number}"
        room = wanted - rows_but(batch.sparkSession, folder)
        if room > 0:
            kept = keep(batch)
            if kept.count() > room:
                kept = kept.orderBy(*(order or [F.xxhash64(*kept.columns)])).limit(room)
            kept.write.mode("overwrite").parquet(f"{sink}/batch={folder}")
            room -= batch.sparkSession.read.parquet(f"{sink}/batch={folder}").count()
        if room <= 0:
            full.set()

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
