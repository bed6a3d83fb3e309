"""The ``opN`` queries: thin digests over whole tables of what the operators of this subpackage return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import ann, exact_dedup, languages, mixing, near, pieces, quality, secrets, substring_dedup, suffix_dedup
from corpuslens.llm.common import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The public model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_table(spark, sf_dir, "documents")).drop("text_key", "class_key")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # a ledger of its own, so that the query scans all; a later scan would go on from its folder
    ledger = secrets.update(docs, f"{checkpoint_dir(spark)}/secrets-{uuid.uuid4().hex}")
    return secrets.digest(secrets.findings(docs, ledger))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents"), model or piece_model(), decode=True))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = languages.remainder("doc_id", 5) == 0
    model = languages.learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out))
    return languages.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_mix_sources,
        op3_substring_dedup,
        op4_ngram_jaccard,
        op5_secret_scan,
        op6_nearest_vectors,
        op7_suffix_dedup,
        op8_sentencepiece,
        op9_quality,
        op10_language_id,
    )
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op2_mix_sources": mixing.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op5_secret_scan": secrets.ORACLE,
    "op6_nearest_vectors": ann.ORACLE,
}
