"""Typed tables: schema-checked reads, digest-checked reads, JSON-lines snapshots, a content-addressed cache, and publishing with a manifest.

A table is a Parquet directory. A run is published when its manifest, written last, exists: it names the tables, their rows and digests.
Only manifests and schemas are handled on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.operators.guards import require

MANIFEST = "manifest.json"


def differences(found: StructType, wanted: StructType) -> list[str]:
    """What keeps a schema from being the wanted one: missing, unexpected, repeated, mistyped columns."""
    have, want = {f.name: f for f in found}, {f.name: f for f in wanted}
    out = [f"missing {n}" for n in want if n not in have] + [f"unexpected {n}" for n in have if n not in want]
    out += [f"repeated {n}" for n in have if sum(f.name == n for f in found) > 1]
    return out + [f"{n} is {have[n].dataType.simpleString()}, not {f.dataType.simpleString()}" for n, f in want.items() if n in have and have[n].dataType.simpleString() != f.dataType.simpleString()]


def not_null(schema: StructType) -> dict[str, Column]:
    return {f"{f.name} is set": F.col(f.name).isNotNull() for f in schema if not f.nullable}


def read_strict(spark: SparkSession, path: str, schema: StructType, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """A Parquet table whose columns are exactly those of the schema and whose rows keep its rules."""
    df = spark.read.parquet(path)
    wrong = differences(df.schema, schema)
    if wrong:
        raise ValueError(f"{path}: " + ", ".join(wrong))
    return require(df.select(*(f.name for f in schema)), not_null(schema) | dict(rules or {}))


def digest(df: DataFrame) -> dict[str, int | str]:
    """Rows and an order-free digest of a table: the sum of row hashes."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")
    got = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest")).first()
    return {"rows": got.rows, "digest": got.digest}


def _read_text(spark: SparkSession, path: str) -> str | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def publish(spark: SparkSession, home: str, tables: Mapping[str, DataFrame], facts: Mapping[str, object]) -> dict:
    """Writes all tables into a folder of this attempt, then the manifest that names it: a reader sees all tables of one attempt or none, whatever
    crashed before. A published run is never written again."""
    if _read_text(spark, f"{home}/{MANIFEST}") is not None:
        raise FileExistsError(f"{home} is published")
    entries, attempt = {}, f"tables-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{home}/{attempt}/{name}.parquet")
        entries[name] = digest(spark.read.parquet(f"{home}/{attempt}/{name}.parquet"))
    manifest = {"facts": dict(facts), "tables": entries, "folder": attempt}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{home}/{MANIFEST}")
    return manifest


def manifest(spark: SparkSession, home: str) -> dict:
    text = _read_text(spark, f"{home}/{MANIFEST}")
    if text is None:
        raise FileNotFoundError(f"{home} is not published")
    return json.loads(text)


def read_verified(spark: SparkSession, home: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A published table that still has the rows and digest of its manifest."""
    published = manifest(spark, home)
    if name not in published["tables"]:
        raise KeyError(f"{home} has no table {name}")
    path = f"{home}/{published['folder']}/{name}.parquet"
    df = spark.read.parquet(path) if schema is None else read_strict(spark, path, schema)
    if digest(df) != published["tables"][name]:
        raise ValueError(f"{name} differs from its manifest")
    return df


def latest(runs: DataFrame) -> DataFrame:
    """The latest of the runs (run_id, made_at); ties to the greater id."""
    return runs.orderBy(F.desc("made_at"), F.desc("run_id")).limit(1)


# The columns of a snapshot record.
RECORD = "uuid string, handle string, program_key string, collection_uuid string, harvested_at string, metadata map<string, array<struct<value: string, language: string, authority: string, confidence: bigint, place: bigint>>>"


def write_snapshot(records: DataFrame, path: str) -> None:
    """JSON lines without identity-number fields; never overwritten."""
    safe = records.withColumn("metadata", F.map_filter("metadata", lambda k, v: ~k.endswith(".dni")))
    safe.write.mode("errorifexists").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Records of a snapshot; a repeated item or one under two programs is refused."""
    df = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    twice = df.groupBy("uuid").agg(F.count("*").alias("n")).filter("n > 1").count()
    if twice:
        raise ValueError(f"{twice} items are repeated")
    return df


def cache_key(*parts: Column) -> Column:
    """SHA-256 of what a cached value depends on."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))), 256)


def not_cached(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """One row for each key that the cache lacks."""
    return rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def pending(inputs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs that the log of finished work doesn't hold under the same keys (item, digest, settings): what a resumed job has to do."""
    return inputs.join(done.select(*keys), list(keys), "left_anti")


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One lower-case lemma a line; # starts a comment."""
    from corpuslens.functions.text import nfc

    word = F.lower(nfc(F.trim(F.regexp_replace("value", "#.*$", ""))))
    return spark.read.text(path).select(word.alias("lemma")).filter("lemma <> ''").distinct()


def symmetric(pairs: DataFrame, programs: Sequence[str], low: int = 0, high: int = 2) -> DataFrame:
    """Both directions of a table (source, target, score) that has every unordered pair once, within the scale."""
    n = len(programs)
    seen = require(pairs, {"known": F.col("source").isin(list(programs)) & F.col("target").isin(list(programs)), "scale": F.col("score").between(low, high), "different": F.col("source") != F.col("target")})
    if seen.select(F.least("source", "target"), F.greatest("source", "target")).distinct().count() != n * (n - 1) // 2 or seen.count() != n * (n - 1) // 2:
        raise ValueError("each pair of programs is wanted exactly once")
    return seen.select("source", "target", "score").union(seen.select("target", "source", "score"))
