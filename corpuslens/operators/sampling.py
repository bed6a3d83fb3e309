"""Stratified sampling and assignment. Random order is the order of SHA-256 of a key and the id, which any engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators.running import numbered


def hash_order(seed: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)), 256)


def allocate(sizes: DataFrame, total: int, floor: int = 0) -> DataFrame:
    """Quotas (stratum, size) -> quota that sum to ``total``: min(floor, size) first, then largest remainders, ties to the smaller stratum;
    everything if there is no more. One row per stratum."""
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    base = sizes.withColumn("base", F.least(F.lit(floor), F.col("size"))).withColumn("rest", F.col("size") - F.col("base"))
    base = base.withColumn("open", F.least(F.lit(total), F.sum("size").over(every)) - F.sum("base").over(every)).withColumn("all", F.sum("rest").over(every))
    part = base.withColumn("whole", F.coalesce(F.expr("cast(rest * open div all as bigint)"), F.lit(0))).withColumn("over", F.coalesce(F.col("rest") * F.col("open") % F.nullif(F.col("all"), F.lit(0)), F.lit(0)))
    part = part.withColumn("missing", F.col("open") - F.sum("whole").over(every)).withColumn("nth", F.row_number().over(W.orderBy(F.desc("over"), "stratum")))
    return part.select("stratum", "size", (F.col("base") + F.col("whole") + (F.col("nth") <= F.col("missing")).cast("int")).cast("long").alias("quota"))


def draw(rows: DataFrame, quotas: DataFrame, id_col: str, seed: str) -> DataFrame:
    """The first ``quota`` rows of each stratum in hash order: draw_order from 1."""
    order = W.partitionBy("stratum").orderBy(hash_order(seed, "stratum", id_col), id_col)
    most = quotas.agg(F.max("quota")).first()[0] or 0
    # the bound lets each task keep only its first rows of a stratum before the shuffle
    ranked = rows.withColumn("draw_order", F.row_number().over(order)).filter(F.col("draw_order") <= int(most)).withColumn("draw_order", F.col("draw_order").cast("long"))
    return ranked.join(quotas.select("stratum", "quota"), "stratum").filter(F.col("draw_order") <= F.col("quota")).drop("quota")


def round_robin(rows: DataFrame, pool: str, id_col: str, groups: int, seed: str) -> DataFrame:
    """Deals rows, shuffled within pools, to groups one after the other, going on from pool to pool."""
    placed = numbered(rows, pool, hash_order(seed, pool, id_col), id_col, "place__")
    return placed.withColumn("dealt", (F.col("place__") - 1) % groups + 1).drop("place__")


def disjoint(pools: Sequence[tuple[str, DataFrame, int]], id_col: str, seed: str) -> DataFrame:
    """Draws from one pool after the other without replacement: (pool, id)."""
    taken: DataFrame | None = None
    for name, rows, n in pools:
        left = rows.select(id_col).distinct() if taken is None else rows.select(id_col).distinct().join(taken, id_col, "left_anti")
        found = left.orderBy(hash_order(f"{seed}:{name}", id_col), id_col).limit(n).withColumn("pool", F.lit(name))
        taken = found if taken is None else taken.unionByName(found)
    if taken is None:
        raise ValueError("no pools")
    return taken


def composition(rows: DataFrame, drawn: DataFrame, quotas: DataFrame, id_col: str) -> DataFrame:
    counts = drawn.groupBy("stratum").agg(F.count(id_col).alias("drawn"))
    return rows.groupBy("stratum").agg(F.count("*").alias("candidates")).join(quotas.select("stratum", "quota"), "stratum", "left").join(counts, "stratum", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
