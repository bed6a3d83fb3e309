"""Running sums, ranks, quantiles and cuts in the order of a numeric column, without a task that sees all rows.

The column's approximate quantiles part the order into ranges, one for each shuffle partition. A range has a window of its own, and what the
ranges before it add up to, a row for each range, is broadcast. Equal values are in one range, so a value that fills one is one task's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = "range__"


def parted(df: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """``df`` with the number of the range that the value is in, rising with the value; null is in the first."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts: list = []
    if n > 1:
        cuts = sorted(set(df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] or []))
    bounds = F.array(*map(F.lit, cuts))
    return df.withColumn(RANGE, F.size(F.filter(bounds, lambda c: c <= F.col(order))) if cuts else F.lit(0))


def running(df: DataFrame, order: str, sums: Mapping[str, str], by: Sequence[str] = (), descending: bool = False, n: int | None = None) -> DataFrame:
    """``df``, whose values of ``order`` are distinct (in each group), with the sums of columns up to each row: new name to column."""
    parts = parted(df, order, n)
    up = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    within = W.partitionBy(*by, RANGE).orderBy(up(order)).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*by).orderBy(up(RANGE)).rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy(*by, RANGE).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    before = totals.select(*by, RANGE, *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before__") for name in sums))
    own = parts.withColumns({f"{name}_own__": F.sum(c).over(within) for name, c in sums.items()})
    keys = [F.col(f"o.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*by, RANGE)]
    together = keys[0]
    for k in keys[1:]:
        together &= k
    return own.alias("o").join(F.broadcast(before).alias("b"), together).select(*(f"o.{c}" for c in df.columns), *((F.col(f"{name}_own__") + F.col(f"{name}_before__")).alias(name) for name in sums))


def _holding(parts: DataFrame, place: int, descending: bool = False) -> tuple[int, int] | None:
    """The range that holds the row at ``place`` (from 0) of the order, and the rows before that range."""
    ends = parts.groupBy(RANGE).agg(F.count("*").alias("n"))
    up = W.orderBy(F.desc(RANGE) if descending else F.asc(RANGE)).rowsBetween(W.unboundedPreceding, 0)
    found = ends.withColumn("end", F.sum("n").over(up)).filter(F.col("end") > place).orderBy("end").first()
    return None if found is None else (found[RANGE], found["end"] - found["n"])


def quantile(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """One row with the exact quantile, interpolated linearly; null if there is no value. Only the ranges that hold its neighbours are sorted."""
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    parts = parted(rows, "v")
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([(None,)], f"{name} double")
    at = share * (n - 1)
    ends = []
    for place in (int(at), min(int(at) + 1, n - 1)):
        number, before = _holding(parts, place)
        ends.append(parts.filter(F.col(RANGE) == number).groupBy("v").agg(F.count("*").alias("m")).withColumn("end", F.sum("m").over(W.orderBy("v"))).filter(F.col("end") > place - before).orderBy("v").first()["v"])
    return df.sparkSession.createDataFrame([(ends[0] + (ends[1] - ends[0]) * (at - int(at)),)], f"{name} double")


def best(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows with the greatest scores, ties to the smaller ``tie``, in no order. Only the range that holds the cut is sorted."""
    parts = parted(df, score)
    found = _holding(parts, k, descending=True)
    if k <= 0:
        return df.limit(0)
    if found is None:
        return df
    number, before = found
    edge = parts.filter(F.col(RANGE) == number).orderBy(F.desc(score), tie).limit(k - before)
    return parts.filter(F.col(RANGE) > number).union(edge).select(*df.columns)


def numbered(df: DataFrame, group: str, order: Column, tie: str, name: str, n: int | None = None) -> DataFrame:
    """``df`` with its places from 1, by group and within it by a hexadecimal hash, which is parted by its leading digits."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = F.conv(F.substring(F.col("order__"), 1, 8), 16, 10).cast("long")
    parts = df.withColumn("order__", order).withColumn(RANGE, F.floor(digits * n / (1 << 32)).cast("int"))
    totals = parts.groupBy(group, RANGE).agg(F.count("*").alias("n__"))
    before = totals.withColumn("before__", F.coalesce(F.sum("n__").over(W.orderBy(group, RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = parts.withColumn("own__", F.row_number().over(W.partitionBy(group, RANGE).orderBy("order__", tie)))
    keys = F.col(f"o.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col(f"o.{RANGE}") == F.col(f"b.{RANGE}"))
    return own.alias("o").join(F.broadcast(before).alias("b"), keys).select(*(f"o.{c}" for c in df.columns), (F.col("own__") + F.col("before__")).cast("long").alias(name))
