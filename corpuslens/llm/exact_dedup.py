"""Exact dedup, native: group by a 128-bit content hash, then compare bytes inside the groups.

Only hashes and ids are shuffled for all rows. Texts move only for rows whose hash may be shared, which a bitmap tells (of bounded size;
with more shared hashes than it can tell apart, the texts move once); there min and max of the texts of a group, pre-aggregated on the map side, are equal exactly when all its bytes are.
A group with two or more texts is a hash collision and is grouped anew by the text itself. So a group of any size costs
one row a task, and the (hash, id) rows of a hot group, which a broadcast of bounded size matches, are dealt at random.

Defined results: null text counts as empty; null ids never stay unless the whole group has none; rows that repeat an id and its text
all count in ``group_size`` and share one decision; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import cut_lineage, join_groups, maybe_in, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits of the content, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id (largest id of equal texts), group_size, kept, text_sha256."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("t"))
    rows = rows.withColumn("h", hasher(F.encode("t", "UTF-8")))
    slim = rows.select("id", "h", F.unhex(F.sha2("t", 256)).alias("sha"))
    groups = cut_lineage(rows.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("keep")))

    suspects = maybe_in(rows, "h", groups.filter("n > 1").select("h")).filter("maybe").select("id", "h", "t")
    collided = cut_lineage(suspects.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("h"))
    mixed = suspects.join(collided, "h", "left_semi")
    by_text = mixed.groupBy("h", "t").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
    apart = mixed.join(by_text, ["h", "t"]).select("id", "keep", "n", F.unhex(F.sha2("t", 256)).alias("sha"))

    marked = groups.join(collided.withColumn("mixed", F.lit(True)), "h", "left")
    together = join_groups(slim, marked, "h", "n").filter("mixed is null").select("id", "keep", "n", "sha")
    return together.union(apart).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
