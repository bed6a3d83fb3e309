"""What several operators share: lineage cuts, buckets, bitmaps of keys, joins with hot keys, a hash."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a bitmap for each of its keys, and its bits at most: 2^20 rows of 16 bytes are broadcast then, whatever the input.
KEY_BITS, MOST_BITS = 16, 1 << 26
#: Stored bytes of the input for each hash bucket; from MANY buckets on both grow with the square root, so that rows of messages stay packed.
BUCKET_BYTES, MANY = 4 << 20, 1 << 14
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only on one machine, as in tests, may a temporary folder stand in for it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless they are fewer: a batch of texts is held by the JVM and by the worker, and Spark's
    own ten thousand rows of long texts fill both."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there; the shuffle files of the plan are deleted once it is written."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    small_batches(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


def stored_bytes(df: DataFrame, text: str = "text") -> int:
    """How large the table is: what its files take if it is read from files, else the bytes of its texts, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return df.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0


def buckets(df: DataFrame, text: str = "text") -> int:
    """How many hash buckets messages are dealt to: by the size of the table, and no fewer than the cluster's shuffle width."""
    wanted = stored_bytes(df, text) / BUCKET_BYTES
    if wanted > MANY:
        wanted = math.sqrt(wanted * MANY)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(wanted))


def dealt(df: DataFrame, key: str, n: int, *also: str):
    """``df`` by groups of the bucket number ``key`` (and the columns ``also``), with a partition for each of the ``n`` buckets."""
    return df.repartitionById(n, F.col(key)).groupBy(key, *also)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, name: str = "maybe", most: int = MOST_BITS) -> DataFrame:
    """``df`` with the column ``name``: false only where ``key`` is surely not in the column ``key`` of ``keys``.

    The keys are counted and make a bitmap of KEY_BITS bits each, which is broadcast; ``df`` is not moved. Too many keys for ``most`` bits are
    joined instead, as groups whose hot ones are salted; then ``df`` is shuffled, and the column is exact.
    """
    bits = 1 << max(20, (KEY_BITS * keys.count() - 1).bit_length())
    if bits > most:
        known = keys.select(F.col(key).alias("known__")).distinct()
        groups = df.groupBy(key).agg(F.count("*").alias("rows__")).join(known, F.col(key) == F.col("known__"), "left")
        return join_groups(df, groups.select(key, "rows__", F.col("known__").isNotNull().alias(name)), key, "rows__").drop("rows__").withColumn(name, F.coalesce(name, F.lit(False)))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = keys.select(slot.alias("slot__")).select(F.shiftrightunsigned("slot__", 6).alias("word__"), F.expr("shiftleft(1L, cast(slot__ & 63 as int))").alias("mask__"))
    bitmap = marks.groupBy("word__").agg(F.bit_or("mask__").alias("mask__"))
    asked = df.withColumn("slot__", slot).join(F.broadcast(bitmap), F.shiftrightunsigned("slot__", 6) == F.col("word__"), "left")
    return asked.withColumn(name, F.coalesce(F.expr("shiftrightunsigned(mask__, cast(slot__ & 63 as int)) & 1L"), F.lit(0)) == 1).drop("slot__", "word__", "mask__")


#: Keys that hold one in so many of all rows are hot; there are as many at most, whatever the input. With many tasks there may be more.
HOT, HOT_PER_TASK = 1000, 4


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of their group. ``groups`` has one row for each key, ``n`` counts its rows.

    Hot keys are matched by broadcast, and their rows, which then match nothing else, are dealt at random; so no task gets more than its share
    and a quarter more.
    """
    cols = [c for c in groups.columns if c != key]
    most = max(HOT, HOT_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = groups.agg(F.sum(n).alias("total__"))
    hot = groups.crossJoin(F.broadcast(total)).filter(F.col(n) * most >= F.col("total__")).select(F.col(key).alias("hk__"), F.struct(*cols).alias("hot__"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hk__"), "left")
    dealt = marked.withColumn("salt__", F.when(F.col("hk__").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)) + 1))
    other = groups.select(F.col(key).alias("gk__"), F.least(F.col(n), F.lit(0)).cast("long").alias("gs__"), F.struct(*cols).alias("g__"))
    joined = dealt.join(other, (F.col(key) == F.col("gk__")) & (F.col("salt__") == F.col("gs__")), "left")
    return joined.select(*rows.columns, *(F.when(F.col("hk__").isNotNull(), F.col(f"hot__.{c}")).otherwise(F.col(f"g__.{c}")).alias(c) for c in cols))


def trim() -> None:
    """Gives freed memory back to the system: a worker lives on from task to task, and what one stage freed is not there for the next."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that trims after each of them."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            trim()

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        trim()

    return trimmed


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function over groups that trims after a large one."""

    def trimmed(table: pa.Table) -> pa.Table:
        large = table.nbytes > 1 << 20
        out = run(table)
        del table
        if large:
            trim()
        return out

    return trimmed


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a uint64 array (splitmix64's constants)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
