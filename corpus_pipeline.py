"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import short_batches, written
from sparkloom.llm.decontamination import decontaminated
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.near_dedup import deduplicated
from sparkloom.llm.quality import fitted, grades_of, selected
from sparkloom.llm.queries import MIX
from sparkloom.llm.token_output import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives the highest grade with probability
    0.5 or more; it is fitted on the labels of the documents it is given."""
    model = fitted(docs, grades_of(short_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")))
    return selected(docs, model, 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group (five-word shingles,
    similarity 0.8)."""
    short_batches(spark)
    return deduplicated(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, short_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; documents come back as often as it repeats them."""
    return mixed_documents(docs, **MIX)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens and
    ids_crc32 of each document."""
    import public_tokenizers

    short_batches(spark)
    path = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path, digest=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token output", token_output),
]

#: A classifier that is fitted can't be said in SQL; tests/llm/test_cases.py
#: compares each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
