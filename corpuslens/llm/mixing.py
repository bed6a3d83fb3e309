"""Mixing sources to target weights by weighted fair queueing, native.

Each source shares the budget by its weight until it has been repeated ``repeats`` times; what it can't use is shared anew (water
filling). A source's documents come in the order of a hash of their ids and texts, once per pass. A copy's virtual finish time is the
source's cumulative words divided by the source's target, so that each source meets its target at time 1. The copies of all
sources, in order of finish time, are cut where their words reach the budget.

Neither the running sum of a source nor the global order is made in one task: a source is dealt to CHUNKS ranges of the hash, whose
totals give the offsets, and the finish times fall into BINS ranges; the one that holds the cut is parted in BINS again, and only the
range of these that holds it is sorted. The hash is of id and text, so null and repeated ids are spread too.

Defined results: null text has size 0 and is taken 0 words; null source is a source, last in order; documents are taken whole, 0 to
``repeats`` times, so a source misses its target by less than one of its documents or so; rows that repeat an id count as documents, and
those that repeat its text too stand in any order among themselves; an empty table gives no rows; other columns are not looked at. One row per source must fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import WORD, cut_lineage, text_or_empty

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
CHUNKS, BINS, LEVELS = 4096, 8192, 2


def text_key() -> Column:
    return F.sha2(text_or_empty(), 256)


def _bins(v: Column) -> list[Column]:
    """The range of a finish time, the range within it, and so on: in order of the times."""
    out, rest = [], v
    for depth in range(LEVELS):
        scaled = F.least(rest * BINS, F.lit(float(BINS << (1 - min(depth, 1)))))
        out.append(F.floor(scaled).cast("long"))
        rest = scaled - F.floor(scaled)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, keep_text_key: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; and times, the whole copies taken; and text_key, if asked for."""
    also = ["text_key"] * keep_text_key
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_or_empty())
    rows = docs.select("doc_id", "source", *(text_key().alias(x) for x in also), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.md5(name).alias("key"))
    rows = rows.withColumn("chunk", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * CHUNKS / 65536).cast("int"))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))

    by_name = W.orderBy(F.col("source").asc_nulls_last())
    before = W.orderBy("full_at", "nth").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("full_at", "nth").rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1)
    sources = (
        sums.groupBy("source")
        .agg(F.sum("chunk_size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", pick)
        .withColumn("most", (F.col("source_size") * repeats).cast("double"))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("full", F.col("left") * F.col("weight") >= F.col("most") * F.sum("weight").over(after))
        .withColumn("used", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0)))
        .withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(every), F.lit(0.0)))
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.try_divide(F.col("weight") * (F.col("budget") - F.col("used")), F.col("open"))))
        .select("source", "nth", "source_size", "target", "budget")
    )
    so_far = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    same = sums.withColumn("offset", F.coalesce(F.sum("chunk_size").over(so_far), F.lit(0))).alias("c").join(sources.alias("s"), F.expr("c.source <=> s.source")).select("c.source", "chunk", "offset", "nth", "source_size", "target", "budget")
    in_chunk = W.partitionBy("source_", "chunk_").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    timed = rows.withColumnsRenamed({"source": "source_", "chunk": "chunk_"}).join(same, F.expr("source_ <=> source and chunk_ = chunk")).withColumn("cum", F.col("offset") + F.sum("size").over(in_chunk))
    for p in range(repeats):
        timed = timed.withColumn(f"v{p}", F.try_divide((F.col("cum") + p * F.col("source_size")).cast("double"), F.col("target")))
    timed = cut_lineage(timed.select("doc_id", *also, "key", "size", "nth", "source_size", "target", "budget", *(f"v{p}" for p in range(repeats))))

    copy = lambda p: F.struct(F.col(f"v{p}").alias("v"), "nth", "key", "doc_id", "size", F.lit(p).alias("pass"))
    copies = timed.filter("size > 0").select("budget", F.explode(F.array(*(copy(p) for p in range(repeats)))).alias("copy"))
    copies = copies.withColumn("bins", F.array(*_bins(F.col("copy.v"))))
    edge: list[int] = []
    start = 0
    for depth in range(LEVELS):  # the range that holds the cut, then the range within it
        inside = copies.filter(F.slice("bins", 1, depth) == F.array(*map(F.lit, edge))) if edge else copies
        sums = inside.groupBy(F.col("bins")[depth].alias("bin")).agg(F.sum("copy.size").alias("words"), F.max("budget").alias("budget"))
        ends = sums.withColumn("end", F.lit(start) + F.sum("words").over(W.orderBy("bin")))
        found = ends.filter(F.col("end") > F.col("budget")).orderBy("bin").select("bin", (F.col("end") - F.col("words")).alias("start")).first()
        if found is None:  # the budget takes every copy
            break
        edge, start = [*edge, found["bin"]], found["start"]
    at_edge = F.array(*map(F.lit, edge)).cast("array<bigint>")
    run = F.lit(start) + F.sum("copy.size").over(W.orderBy("copy").rowsBetween(W.unboundedPreceding, 0))
    cut = copies.filter(F.col("bins") == at_edge).withColumn("run", run).filter(F.col("run") <= F.col("budget")).groupBy().agg(F.max("copy").alias("last"))
    told = timed.join(F.broadcast(cut), how="cross")

    def taken(p: int):
        bins = F.array(*_bins(F.col(f"v{p}")))
        within = F.when(bins < at_edge, 1).when((bins == at_edge) & (copy(p) <= F.col("last")), 1).otherwise(0) if edge else F.lit(1)
        return F.when(F.col("size") == 0, 0).otherwise(within)

    times = sum((taken(p) for p in range(1, repeats)), taken(0)).cast("long")
    return told.select("doc_id", *also, "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * times).alias("taken"), times.alias("times"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM d GROUP BY source),
s1 AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(source_size * 2 AS DOUBLE) AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, budget - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
  sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_w FROM s1),
s3 AS (SELECT *, remaining * weight >= most * after_w AS filled FROM s2),
s4 AS (SELECT *, CASE WHEN filled THEN most ELSE weight * (budget - coalesce(sum(most) FILTER (filled) OVER (), 0)) / nullif(sum(weight) FILTER (NOT filled) OVER (), 0) END AS target FROM s3),
c AS (SELECT d.*, s4.nth, s4.source_size, s4.target, s4.budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
v AS (SELECT *, CAST(cum + p * source_size AS DOUBLE) / nullif(target, 0) AS v FROM c, (VALUES (0), (1)) AS passes(p) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY v, nth, key, doc_id, size, p ROWS UNBOUNDED PRECEDING) AS run FROM v),
t AS (SELECT doc_id, CAST(sum(CASE WHEN run <= budget THEN 1 ELSE 0 END) AS BIGINT) AS times FROM r GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, coalesce(c.target, 0) AS target, c.size * coalesce(t.times, 0) AS taken, coalesce(t.times, 0) AS times FROM c LEFT JOIN t USING (doc_id)
"""
