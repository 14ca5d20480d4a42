"""Training steps in a seeded order, read as a stream whose position survives restarts.

The stream is a Python data source of step numbers: its offset is how many steps were
given, which Structured Streaming keeps in the checkpoint.  The rows of a step are read
by Spark from a table of the epoch in its shuffled order, written once when the epoch
begins, with the step's block as its folder, so a step reads a few row groups.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.batch import shuffled_rank

#: Steps in one folder of an epoch's table.
BLOCK = 256


class StepSource(DataSource):
    """``training_steps``: (epoch, step) of the first ``until`` steps of epochs of
    ``steps``, ``at_once`` of them in a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "training_steps"

    def schema(self) -> str:
        return "epoch long, step long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StepReader(*(int(self.options[k]) for k in ("steps", "at_once", "until")))


class _StepReader(SimpleDataSourceStreamReader):
    def __init__(self, steps: int, at_once: int, until: int):
        self.steps, self.at_once, self.until = steps, at_once, until

    def initialOffset(self) -> dict:
        return {"given": 0}

    def read(self, start: dict):
        end = {"given": max(start["given"], min(start["given"] + self.at_once, self.until))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([divmod(i, self.steps) for i in range(start["given"], end["given"])])


class Loader:
    """Reads ``df`` in ``epochs`` orders and in steps of ``size`` rows.

    ``pos`` is a column without repeats or nulls; an epoch's order is that of a hash of
    it, ``seed`` and the epoch.  ``drop_last`` leaves out rows that don't fill a step.
    ``folder`` keeps the position, the settings and the table of the current epoch; a
    loader that is made again on the same folder goes on where the last one stopped.
    Other settings, or a table with another number of rows or other positions, are
    refused.  An empty table has no steps.
    """

    def __init__(self, df: DataFrame, folder: str, size: int, epochs: int = 1, seed: int = 0, pos: str = "pos", drop_last: bool = False):
        self.df, self.folder, self.size, self.epochs, self.seed, self.pos = df, folder.rstrip("/"), size, epochs, seed, pos
        self.spark: SparkSession = df.sparkSession
        rows, known, mark = df.agg(F.count(F.lit(1)), F.count(pos), F.bit_xor(F.xxhash64(pos))).first()
        if known != rows:
            raise ValueError(f"{pos} has nulls")
        self.steps = rows // size if drop_last else -(-rows // size)
        settings = json.dumps({"rows": rows, "positions": mark, "size": size, "epochs": epochs, "seed": seed, "drop_last": drop_last})
        at = f"{self.folder}/settings"
        if self._exists(at):
            held = self.spark.read.text(at).first()[0]
            if held != settings:
                raise ValueError(f"{self.folder} holds the position of another reading: {held}")
        else:
            self.spark.createDataFrame([(settings,)], "value string").coalesce(1).write.mode("overwrite").text(at)

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, folder: str) -> bool:
        """Whether a folder was written to its end."""
        files, at = self._hadoop(f"{folder}/_SUCCESS")
        return files.exists(at)

    def epoch_table(self, epoch: int) -> DataFrame:
        """The table in the order of an epoch with ``step`` and ``rank``, written unless it
        is there; that of the epoch before goes."""
        at = f"{self.folder}/epoch-{epoch}"
        if not self._exists(at):
            names = [c for c in self.df.columns if c in ("step", "rank", "block", "total")]
            if names:
                raise ValueError(f"columns of these names are the loader's: {', '.join(names)}")
            rows = shuffled_rank(self.df, self.seed * 1_000_003 + epoch, self.pos).drop("total")
            rows = rows.withColumn("step", F.floor(F.col("rank") / self.size).cast("long")).where(F.col("step") < self.steps)
            rows = rows.withColumn("block", F.floor(F.col("step") / BLOCK).cast("long"))
            # Rows of a few steps lie together, in order: a step reads few row groups.
            rows = rows.repartitionByRange("rank").sortWithinPartitions("rank")
            rows.write.mode("overwrite").partitionBy("block").parquet(at)
        files, before = self._hadoop(f"{self.folder}/epoch-{epoch - 1}")
        if epoch and files.exists(before):
            files.delete(before, True)
        return self.spark.read.parquet(at)

    def rows_of(self, epoch: int, step: int) -> DataFrame:
        """The rows of a step, in no order of their own; ``rank`` gives it."""
        return self.epoch_table(epoch).where((F.col("block") == step // BLOCK) & (F.col("step") == step)).drop("block")

    def position(self) -> int:
        """Steps that were given and used up, as the checkpoint has it."""
        commits, offsets = f"{self.folder}/checkpoint/commits", f"{self.folder}/checkpoint/offsets"
        files, at = self._hadoop(commits)
        if not files.exists(at):
            return 0
        done = [int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit()]
        if not done:
            return 0
        lines = [r[0] for r in self.spark.read.text(f"{offsets}/{max(done)}").collect()]  # a version, a header, an offset
        return json.loads(lines[-1])["given"]

    def run(self, consume: Callable[[DataFrame, int, int], None], at_once: int = 1, stop_after: int | None = None) -> int:
        """Gives ``consume(rows, epoch, step)`` the steps that are left, one after the
        other, and returns the position.  A step whose micro-batch didn't end, because
        the driver was lost or ``consume`` failed, is given again on the next run:
        ``consume`` should overwrite what it writes for a step (see ``step_writer``).
        ``stop_after``: so many micro-batches, then stop."""

        def each(batch: DataFrame, number: int) -> None:
            for epoch, step in sorted(tuple(r) for r in batch.collect()):  # at_once rows at most
                consume(self.rows_of(epoch, step), epoch, step)

        at, end = self.position(), self.steps * self.epochs
        if at >= end:
            return at
        until = end if stop_after is None else min(end, at + stop_after * at_once)
        self.spark.dataSource.register(StepSource)
        steps = self.spark.readStream.format("training_steps").options(steps=self.steps, at_once=at_once, until=until).load()
        query = steps.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return self.position()


def step_writer(path: str) -> Callable[[DataFrame, int, int], None]:
    """Writes each step to its own folder (epoch=, step=), over what a lost run left."""

    def write(rows: DataFrame, epoch: int, step: int) -> None:
        rows.drop("step").write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}/step={step}")

    return write
