"""Declarative selection of a configuration from a table of runs: seed summaries, choices, gates and lexicographic decisions.

The summaries are Spark aggregates over all runs; what decides is at most one row per configuration, collected for the rules below.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seed_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds of each metric; null if any seed leaves it undefined."""
    cols: list[Column] = [F.count("*").alias("seeds")]
    for m in metrics:
        whole = F.count(m) == F.count("*")
        cols += [F.when(whole, F.avg(m)).alias(f"{m}_mean"), F.when(whole, F.stddev_samp(m)).alias(f"{m}_sd")]
    return runs.groupBy(*by).agg(*cols)


def choose(summary: DataFrame, by: Sequence[str], parameter: str, metric: str, eligible: Column | None = None, fallback: Column | None = None) -> DataFrame:
    """The parameter with the greatest metric for each group, ties to the smaller; if none is eligible the first by ``fallback``, marked.
    ``at_bound`` says that the choice is at an end of the sweep."""
    ok = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    order = [F.desc("ok"), F.when(F.col("ok"), -F.round(metric, 12)).otherwise(fallback if fallback is not None else F.lit(0.0)).asc_nulls_last(), F.col(parameter)]
    w = W.partitionBy(*by)
    ranked = summary.withColumn("ok", ok).withColumn("nth", F.row_number().over(w.orderBy(*order)))
    bound = (F.col(parameter) == F.min(parameter).over(w)) | (F.col(parameter) == F.max(parameter).over(w))
    return ranked.withColumn("at_bound", bound).filter("nth = 1").select(*by, parameter, F.col(f"{metric}").alias(metric), F.col("ok").alias("eligible"), "at_bound")


@dataclass(frozen=True)
class Candidate:
    """One configuration: name, means and deviations by metric; None is undefined."""

    name: str
    mean: dict[str, float | None]
    sd: dict[str, float | None] = field(default_factory=dict)


@dataclass(frozen=True)
class Decision:
    """Who won, by which step, and why each step did not decide."""

    winner: str | None
    step: str
    reasons: tuple[str, ...]


def beats(first: Candidate, second: Candidate, metric: str, higher: bool = True) -> bool:
    """The difference of means is strictly greater than the larger deviation."""
    a, b = first.mean.get(metric), second.mean.get(metric)
    if a is None or b is None:
        return False
    return (a - b if higher else b - a) > max(first.sd.get(metric) or 0.0, second.sd.get(metric) or 0.0)


def gates(c: Candidate, most_noise: float, least_ari: float, needed: Sequence[str]) -> tuple[str, ...]:
    """Names of the gates that a candidate fails; bounds are inclusive."""
    failed = [f"{m} undefined" for m in needed if c.mean.get(m) is None]
    if (c.mean.get("noise") or 0.0) > most_noise:
        failed.append("noise")
    if (ari := c.mean.get("ari")) is None or ari < least_ari:
        failed.append("ari")
    return tuple(failed)


def decide(first: Candidate, second: Candidate, check: Callable[[Candidate], tuple[str, ...]], metrics: Sequence[tuple[str, bool]], fallback: str) -> Decision:
    """Gates, then one metric after the other, then the fallback. If both fail the gates nobody wins."""
    failed = {c.name: check(c) for c in (first, second)}
    reasons = [f"{n} fails {', '.join(f)}" for n, f in failed.items() if f]
    passed = [c for c in (first, second) if not failed[c.name]]
    if not passed:
        return Decision(None, "gates", tuple(reasons))
    if len(passed) == 1:
        return Decision(passed[0].name, "gates", tuple(reasons))
    for metric, higher in metrics:
        for a, b in ((first, second), (second, first)):
            if beats(a, b, metric, higher):
                return Decision(a.name, metric, tuple(reasons))
        reasons.append(f"{metric} doesn't tell them apart")
    return Decision(fallback, "fallback", tuple(reasons))


def flips(decision: Decision, alternatives: dict[str, Decision]) -> dict[str, bool]:
    """Which alternates of the rules would choose another winner."""
    return {name: d.winner != decision.winner for name, d in alternatives.items()}


def matched_k(mean_clusters: float) -> int:
    return int(mean_clusters + 0.5)


def medoid(pairs: DataFrame) -> DataFrame:
    """The run with the greatest mean agreement (run_a, run_b, ari) with the others; ties to the first seed."""
    both = pairs.select(F.col("run_a").alias("run"), "ari").union(pairs.select("run_b", "ari"))
    return both.groupBy("run").agg(F.avg("ari").alias("mean_ari")).orderBy(F.desc(F.round("mean_ari", 12)), "run").limit(1)


def beats_baseline(winner: Candidate, baselines: Sequence[Candidate], metric: str = "npmi") -> bool:
    """The winner's metric is greater than each baseline's, at all the numbers of topics that are compared."""
    own = winner.mean.get(metric)
    return own is not None and bool(baselines) and all((b := c.mean.get(metric)) is not None and own > b for c in baselines)


def steady(values: Sequence[float], cap: float) -> bool:
    """The coefficient of variation over seeds is at most the cap."""
    mean = sum(values) / len(values)
    sd = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5 if len(values) > 1 else 0.0
    return mean != 0 and sd / abs(mean) <= cap


def accepted(f1: float | None, floor: float = 0.70) -> bool:
    return f1 is not None and f1 >= floor
