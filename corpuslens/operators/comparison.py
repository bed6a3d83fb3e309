"""Two representations over the same labelled pairs: a threshold for each by cross-validation, intervals of their F1, and whether one is higher."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import agreement as A
from corpuslens.operators.guards import require


def valid_pairs(scored: DataFrame, scores: list[str]) -> DataFrame:
    """Pairs whose scores are finite and whose labels are 0 or 1; two rows at least."""
    rules = {f"{s} is finite": F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) for s in scores} | {"labels are 0 or 1": F.col("label").isin(0, 1)}
    if scored.limit(2).count() < 2:
        raise ValueError("two pairs are wanted at least")
    return require(scored, rules)


def verdict(low: Column, high: Column) -> Column:
    """first_higher, second_higher, or tie if the interval holds or touches 0; null without an interval."""
    return F.when(low.isNull() | high.isNull(), None).when(low > 0, "first_higher").when(high < 0, "second_higher").otherwise("tie")


def calibrated(scored: DataFrame, score: str, id_col: str, folds: int, seed: str, tie: str = "highest_tau") -> DataFrame:
    """One row: tau (the best F1 of all pairs), its F1 there, the F1 pooled over held-out folds, and the least and greatest tau of the folds."""
    rows = A.with_folds(scored.select(id_col, F.col(score).alias("score"), "label"), id_col, seed, folds)
    held, pooled = A.cross_validated(rows, folds, tie)
    best = A.best_point(A.pr_curve(rows), tie=tie).select("tau", F.col("f1").alias("f1_at_tau"))
    span = held.agg(F.min("tau").alias("least_tau"), F.max("tau").alias("most_tau"))
    return best.crossJoin(pooled.select(F.col("f1").alias("pooled_f1"))).crossJoin(span).select(F.lit(score).alias("representation"), "*")


@dataclass(frozen=True)
class Difference:
    """F1 of the first minus that of the second, each at its own threshold, over the same resamples."""

    first: str
    second: str
    first_f1: float | None
    second_f1: float | None
    low: float | None
    high: float | None
    verdict: str | None
    undefined: int

    @property
    def value(self) -> float | None:
        return None if self.first_f1 is None or self.second_f1 is None else self.first_f1 - self.second_f1


def compare(scored: DataFrame, id_col: str, first: str, second: str, *, folds: int = 5, resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> tuple[DataFrame, DataFrame, Difference]:
    """(calibration of each, intervals of each and of the difference, the difference) of two score columns."""
    if first == second:
        raise ValueError("two representations are wanted")
    rows = valid_pairs(scored, [first, second])
    table = calibrated(rows, first, id_col, folds, str(seed)).unionByName(calibrated(rows, second, id_col, folds, str(seed)))
    taus = {r.representation: r.tau for r in table.collect()}
    intervals = A.bootstrap(rows, id_col, taus, resamples, seed, confidence)
    told = intervals.withColumn("verdict", F.when(F.col("measure") == "difference", verdict(F.col("low"), F.col("high"))))
    got = told.filter("measure = 'difference'").first()
    f1 = {n: A.confusion(rows.select(F.col(n).alias("score"), "label"), F.lit(taus[n])).first()["f1"] for n in (first, second)}
    return table, told, Difference(first, second, f1[first], f1[second], got["low"], got["high"], got["verdict"], got["undefined"])
