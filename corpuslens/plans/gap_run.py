"""All gap rules over all runs of a topic map: one table of gaps and one of their members, support across runs, sensitivity; and the rebuild that
verifies saved tables.

Inputs: labels (run, id, label), rows (id, vec), metadata (id, program, year), npmi (run, topic, npmi), affinity (source, target, score).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators import gaps as G
from corpuslens.operators.search import centroids

GAPS = "gap_id string, run int, rule string, topics array<bigint>, source string, target string, evidence map<string,double>"


@dataclass(frozen=True)
class Settings:
    quantile: float = 0.25
    nearest: int = 3
    most_bridges: int = 2
    least_count: int = 5
    least_share: float = 0.05
    rare: float = 0.02
    least_affinity: int = 1
    excluded: tuple = ()
    split_year: int = 2000
    decline_count: int = 5
    least_decline: float = 0.02
    least_runs: int = 3
    least_overlap: float = 0.5


@dataclass(frozen=True)
class Result:
    """cuts (one row), gaps (GAPS), members (gap_id, run, rule, part, id), support (gap_id, support, stable), sensitivity."""

    cuts: DataFrame
    gaps: DataFrame
    members: DataFrame
    support: DataFrame
    sensitivity: DataFrame


def _row(found: DataFrame, rule: str, topics: list[str], evidence: Sequence[str], source: str | None = None, target: str | None = None) -> DataFrame:
    name = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    facts = F.map_from_arrays(F.array(*map(F.lit, evidence)), F.array(*(F.col(c).cast("double") for c in evidence)))
    return found.select(F.col("run").cast("int").alias("run"), F.lit(rule).alias("rule"), F.array(*(F.col(t).cast("bigint") for t in topics)).alias("topics"), name(source).alias("source"), name(target).alias("target"), facts.alias("evidence"))


def rules(labels: DataFrame, rows: DataFrame, metadata: DataFrame, npmi: DataFrame, affinity: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(cuts, gaps) of rules a to d over all runs. Rule b needs a run's centroids, so it goes run by run; the others take all runs at once."""
    sizes = G.topic_sizes(labels)
    cuts = G.small_topic_cuts(sizes, npmi, s.quantile)
    small = G.small_coherent(sizes, npmi, cuts).crossJoin(F.broadcast(cuts))
    out = _row(small, "a", ["topic"], ["size", "npmi", "size_cut", "npmi_floor"])
    for run in [r.run for r in labels.select("run").distinct().orderBy("run").collect()]:
        pairs = G.interstitial(rows, centroids(rows, labels.filter(F.col("run") == run).select("id", "label")), s.nearest, s.most_bridges)
        out = out.unionByName(_row(pairs.withColumn("run", F.lit(run)), "b", ["t", "u"], ["rank", "cos", "bridge_docs"]))
    moved = G.transferable(labels, metadata.select("id", "program"), affinity, list(s.excluded), least_count=s.least_count, least_share=s.least_share, rare=s.rare, least_affinity=s.least_affinity)
    out = out.unionByName(_row(moved, "c", ["topic"], ["source_n", "source_share", "target_share", "score"], "source", "target"))
    fell = G.declines(labels, metadata.select("id", "year"), s.split_year, s.decline_count, s.least_decline)
    out = out.unionByName(_row(fell, "d", ["topic"], ["early_n", "late_n", "early_share", "late_share"]))
    nth = F.row_number().over(W.partitionBy("run", "rule").orderBy("topics", "source", "target"))
    return cuts, out.withColumn("gap_id", F.format_string("G-%d-%s-%d", "run", "rule", nth)).select(*(c.split()[0] for c in GAPS.split(", ")))


def members(gaps: DataFrame, labels: DataFrame) -> DataFrame:
    """gap_id, run, rule, match_key, part (topic, or first_topic and second_topic), id: the documents of each gap's topics."""
    parts = gaps.select("gap_id", "run", "rule", F.concat_ws(">", "source", "target").alias("match_key"), F.posexplode("topics").alias("at", "label"))
    named = parts.withColumn("part", F.when(F.col("rule") != "b", "topic").when(F.col("at") == 0, "first_topic").otherwise("second_topic"))
    return named.join(labels.select("run", "label", "id"), ["run", "label"]).select("gap_id", "run", "rule", "match_key", "part", "id")


def support(members_: DataFrame, reference: int, s: Settings) -> DataFrame:
    """In how many runs each gap of the reference run has a counterpart: equal rule and match key, and enough shared members. A gap of two topics is
    as like another as the weaker topic under the better matching."""
    size = members_.groupBy("gap_id", "part").agg(F.count("*").alias("size"))
    mine, others = members_.filter(F.col("run") == reference), members_.filter(F.col("run") != reference)
    both = mine.alias("a").join(others.alias("b"), F.expr("a.rule = b.rule and a.match_key = b.match_key and a.id = b.id"))
    shared = both.groupBy(F.col("a.gap_id").alias("gap_id"), F.col("a.part").alias("part"), F.col("b.gap_id").alias("other"), F.col("b.part").alias("other_part"), F.col("b.run").alias("run")).agg(F.count("*").alias("n"))
    joined = shared.join(size, ["gap_id", "part"]).join(size.withColumnsRenamed({"gap_id": "other", "part": "other_part", "size": "other_size"}), ["other", "other_part"])
    like = joined.withColumn("j", F.col("n").cast("double") / (F.col("size") + F.col("other_size") - F.col("n")))
    cell = lambda p, q: F.coalesce(F.max(F.when((F.col("part") == p) & (F.col("other_part") == q), F.col("j"))), F.lit(0.0))
    pair = G.pair_overlap(cell("first_topic", "first_topic"), cell("first_topic", "second_topic"), cell("second_topic", "first_topic"), cell("second_topic", "second_topic"))
    best = like.groupBy("gap_id", "other", "run").agg(F.greatest(cell("topic", "topic"), pair).alias("overlap")).filter(F.col("overlap") >= s.least_overlap)
    runs = best.groupBy("gap_id").agg(F.countDistinct("run").alias("runs"))
    own = mine.select("gap_id").distinct()
    counted = own.join(runs, "gap_id", "left").withColumn("support", F.coalesce("runs", F.lit(0)) + 1)
    return counted.select("gap_id", "support", (F.col("support") >= s.least_runs).alias("stable"))


def run(labels: DataFrame, rows: DataFrame, metadata: DataFrame, npmi: DataFrame, affinity: DataFrame, reference: int, s: Settings = Settings()) -> Result:
    """The whole gap run."""
    cuts, gaps = rules(labels, rows, metadata, npmi, affinity, s)
    own = members(gaps, labels)
    sizes = G.topic_sizes(labels)
    variants = {
        "primary": G.small_coherent(sizes, npmi, cuts),
        "literal_share": G.literal_small(sizes, labels.select("id").distinct().count()),
        "without_floor": sizes.crossJoin(F.broadcast(cuts)).filter("size <= size_cut").select("run", "topic", "size"),
    }
    return Result(cuts, gaps, own, support(own, reference, s), G.sensitivity(variants, sizes))


def verify(saved: Result, labels: DataFrame, rows: DataFrame, metadata: DataFrame, npmi: DataFrame, affinity: DataFrame, reference: int, s: Settings) -> list[str]:
    """What of saved tables the rules don't give again from their inputs; evidence is compared to nine digits. Empty if all agree."""
    again = run(labels, rows, metadata, npmi, affinity, reference, s)
    plain = lambda df: df.select(*(F.transform_values(c, lambda _, v: F.round(v, 9)).cast("string").alias(c) if c == "evidence" else F.col(c).cast("string").alias(c) for c in df.columns))
    out = []
    for name in ("gaps", "members", "support"):
        a, b = plain(getattr(saved, name)), plain(getattr(again, name))
        if a.exceptAll(b.select(*a.columns)).limit(1).count() or b.select(*a.columns).exceptAll(a).limit(1).count():
            out.append(f"{name} differ from what the rules give")
    return out


def facts(s: Settings) -> dict:
    return asdict(s)
