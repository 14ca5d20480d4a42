"""What users add: functions and classes in a file of their own, datasets, metrics.

A file is shipped to the executors as a Spark artifact under a name that its content
gives, so tasks import what the driver checked, also after the file was changed.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import os
import shutil
import sys
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shipped_module(spark: SparkSession, file: str):
    """The module in ``file``, importable in tasks under the name it has here.  A file that
    is missing or can't be loaded is an error here, before any task runs."""
    if not os.path.exists(file):
        raise FileNotFoundError(f"no file {file}")
    with open(file, "rb") as f:
        body = f.read()
    name = f"user_{os.path.splitext(os.path.basename(file))[0]}_{hashlib.sha256(body).hexdigest()[:12]}"
    if name in sys.modules:
        return sys.modules[name]
    folder = tempfile.mkdtemp(prefix="artifact-")  # the driver's copy, from where it is uploaded
    at = os.path.join(folder, f"{name}.py")
    shutil.copyfile(file, at)
    spec = importlib.util.spec_from_file_location(name, at)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        del sys.modules[name]
        raise RuntimeError(f"{file} can't be loaded: {e}") from e
    spark.addArtifacts(at, pyfile=True)
    return module


def member(spark: SparkSession, file: str, name: str):
    module = shipped_module(spark, file)
    if not hasattr(module, name):
        raise AttributeError(f"no {name} in {file}")
    return getattr(module, name)


def user_scorer(spark: SparkSession, file: str, name: str, **fixed) -> Callable[[Column, Column, Column], Column]:
    """A function of (source, text, gold) columns from ``name`` in ``file``, called with
    data_source, solution_str, ground_truth and the ``fixed`` arguments for each row; a
    number, or a dictionary whose score counts.  Rows reach it in Arrow batches."""
    fn = member(spark, file, name)
    if not callable(fn):
        raise TypeError(f"{name} in {file} is no function")
    module, arguments = fn.__module__, dict(fixed)

    def score(source, text, gold):
        call = getattr(importlib.import_module(module), name)

        def one(s, t, g):
            out = call(data_source=s, solution_str=t, ground_truth=g, **arguments)
            return float(out["score"] if isinstance(out, dict) else out)

        import pandas as pd

        return pd.Series([one(*row) for row in zip(source, text, gold, strict=True)], dtype="float64")

    return F.pandas_udf(score, T.DoubleType())


class Dataset(ABC):
    """A benchmark: its names and the hooks from its table to its report.  All take and
    return DataFrames, so rows stay where they are."""

    #: Path of the table of each name.
    TABLES: dict[str, str] = {}

    def __init__(self, spark: SparkSession, name: str):
        if name not in self.supported():
            raise ValueError(f"{type(self).__name__} has no {name}: {', '.join(self.supported())}")
        self.spark, self.name = spark, name
        self.data = self.post_build(self.load(name))

    @classmethod
    def supported(cls) -> list[str]:
        return list(cls.TABLES)

    def load(self, name: str) -> DataFrame:
        """The table of a name."""
        from ..sources.io import read_table

        return read_table(self.spark, self.TABLES[name])

    def post_build(self, data: DataFrame) -> DataFrame:
        """What is done to the table once it is loaded."""
        return data

    def prompts(self, data: DataFrame) -> DataFrame:
        """``data`` with ``messages``: its images by their paths, then its question."""
        images = F.col("image_path") if "image_path" in data.columns else F.array().cast("array<string>")
        if "image_path" in data.columns and not isinstance(data.schema["image_path"].dataType, T.ArrayType):
            images = F.array("image_path")
        shown = F.transform(F.filter(images, lambda p: p.isNotNull()), lambda p: F.struct(F.lit("image").alias("type"), p.alias("value")))
        return data.withColumn("messages", F.concat(shown, F.array(F.struct(F.lit("text").alias("type"), F.col("question").alias("value")))))

    @abstractmethod
    def evaluate(self, predictions: DataFrame) -> DataFrame:
        """The report of a table of predictions."""


#: Datasets by class name, metrics by name.
DATASETS: dict[str, type[Dataset]] = {}
METRICS: dict[str, Callable[..., Column]] = {}


def _registered(into: dict, name: str, what):
    if into.get(name, what) is not what:
        raise ValueError(f"{name} is registered already")
    into[name] = what
    return what


def register_dataset(cls: type[Dataset]) -> type[Dataset]:
    """Class decorator; a second class of one name is an error."""
    if not issubclass(cls, Dataset):
        raise TypeError(f"{cls.__name__} is no Dataset")
    return _registered(DATASETS, cls.__name__, cls)


def dataset(spark: SparkSession, name: str) -> Dataset:
    """The dataset of a name, of the one registered class that has it."""
    having = [c for c in DATASETS.values() if name in c.supported()]
    if len(having) != 1:
        raise ValueError(f"{name} is a dataset of {', '.join(c.__name__ for c in having) or 'no class'}")
    return having[0](spark, name)


def dataset_class(spark: SparkSession, file: str, name: str) -> type[Dataset]:
    """A dataset class from a user's file."""
    cls = member(spark, file, name)
    if not (isinstance(cls, type) and issubclass(cls, Dataset)):
        raise TypeError(f"{name} in {file} is no Dataset")
    return cls


def register_metric(name: str):
    """Decorator for a function of columns that gives a column."""
    return lambda fn: _registered(METRICS, name, fn)


def metrics_of(df: DataFrame, names: list[str], *columns: str, by: list[str] | None = None) -> DataFrame:
    """Means of registered metrics of two or more columns, by group."""
    lacking = [n for n in names if n not in METRICS]
    if lacking:
        raise ValueError(f"no metric {', '.join(lacking)}")
    scored = df.select(*(by or []), *[METRICS[n](*map(F.col, columns)).alias(n) for n in names])
    return scored.groupBy(*(by or [])).agg(*[F.avg(n).alias(n) for n in names])
