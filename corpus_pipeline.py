"""A training-data pipeline over ``documents``: language, exact copies, near copies, mix, tokens.

Each stage works on all that its predecessor kept, read back from Parquet.

Defined results: null text counts as empty, is in no language and goes with the first stage; null and repeated ids are documents like any other,
told apart by their texts; rows that repeat an id and its text are copies; an empty table gives no rows; other columns, whatever their
names, pass through all stages but the last, which returns doc_id, ids, n_tokens and decoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import stages
from corpuslens.llm.common import checkpoint_dir
from corpuslens.llm.queries import piece_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.tokenised(docs, piece_model())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]
#: Mixture inference, signatures and encoding are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again, and goes once the next has been written. The
    last one's rows stay there for the reader of the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            _delete(spark, before)
        before = f"{home}/{name}"
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
