"""A map of an early period, to which the documents of a late period are assigned: the map, the assignment, its consistency with the map of all
documents, and the sample that experts see."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators import metrics, sampling, search, terms


@dataclass(frozen=True)
class EarlyMap:
    """labels (id, label), topics (label, term, rank), centroids (topic, centroid), threshold (one row), and the documents of each period."""

    labels: DataFrame
    topics: DataFrame
    centroids: DataFrame
    threshold: DataFrame
    early: DataFrame
    late: DataFrame


def fit(rows: DataFrame, years: DataFrame, sections: DataFrame, split_year: int, cluster: Callable[[DataFrame], DataFrame], *, vocabulary: DataFrame, top_n: int = 10, max_ngram: int = 1, percentile: float = 0.05) -> EarlyMap:
    """Clusters the vectors (id, vec) of documents before ``split_year`` by ``cluster`` (rows to id, label), with terms from their ``sections`` (doc,
    section, tokens) over a vocabulary (term) that is cut to the period. A map without a topic is refused."""
    dated = rows.join(years.select("id", "year"), "id")
    early, late = (dated.filter(c).select("id", "vec") for c in (F.col("year") < split_year, F.col("year") >= split_year))
    labels = cluster(early).select("id", "label").persist()
    if not labels.filter("label <> -1").limit(1).count():
        raise ValueError("the early map has no topic")
    own = terms.ngrams(sections.join(early.select(F.col("id").alias("doc")), "doc", "left_semi"), max_ngram)
    known = vocabulary.select("term").join(own.select("term").distinct(), "term", "left_semi")
    weights = terms.class_weights(own, labels.withColumnRenamed("id", "doc"), known)
    cents = search.centroids(early, labels)
    limit = search.atypical_threshold(search.member_similarities(early, labels, cents), percentile)
    return EarlyMap(labels, terms.top_terms(weights, top_n), cents, limit, early, late)


def assign_late(m: EarlyMap) -> DataFrame:
    """Late documents with their nearest topic: id, topic, sim, atypical."""
    found = search.assign(m.late, m.centroids).crossJoin(F.broadcast(m.threshold))
    return found.select("id", "topic", "sim", (F.round("sim", 9) < F.round("threshold", 9)).alias("atypical"))


def full_labels(labels: DataFrame, run: str, documents: DataFrame) -> DataFrame:
    """The labels of a run (run_id, id, label), once they cover exactly the documents (id)."""
    own = labels.filter(F.col("run_id") == run).select("id", "label")
    twice = own.groupBy("id").count().filter("count > 1").limit(1).count()
    if twice or own.select("id").exceptAll(documents.select("id")).limit(1).count() or documents.select("id").exceptAll(own.select("id")).limit(1).count():
        raise ValueError(f"the labels of {run} don't cover the documents")
    return own


def consistency(m: EarlyMap, assigned: DataFrame, full: DataFrame) -> DataFrame:
    """Agreement of the early map and of the late assignment with the map of all documents: period, noise, n, ari, nmi; for the late period also the
    share whose topic's counterpart is their topic there."""
    late = assigned.select("id", F.col("topic").alias("label"))
    agreement = metrics.counterpart_agreement(late, full, metrics.counterparts(metrics.contingency(m.labels, full))).select("agreement")
    out = None
    for period, own in (("early", m.labels), ("late", late)):
        for noise in ("own_label", "exclude_either"):
            cells = metrics.contingency(own, full, noise)
            row = metrics.adjusted_rand(cells).select(F.col("ari")).crossJoin(metrics.mutual_information(cells).select("nmi")).crossJoin(cells.agg(F.sum("n").alias("n")))
            row = row.select(F.lit(period).alias("period"), F.lit(noise).alias("noise"), "n", "ari", "nmi")
            row = row.crossJoin(agreement) if period == "late" else row.withColumn("agreement", F.lit(None).cast("double"))
            out = row if out is None else out.unionByName(row)
    return out


def expert_sample(assigned: DataFrame, programs: DataFrame, size: int, atypical_quota: int, floor: int, seed: str) -> DataFrame:
    """``size`` late documents (id, pool, program, draw_order, position): the atypical first up to their quota, the rest from the others; each pool over
    the programs with a floor; shown in an order of its own."""
    if not 0 <= atypical_quota <= size:
        raise ValueError("the quota of atypical documents is within the sample")
    rows = assigned.join(programs.select("id", "program"), "id").select("id", "program", F.when(F.col("atypical"), "atypical").otherwise("typical").alias("pool")).persist()
    have = {r.pool: r.n for r in rows.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    first = min(atypical_quota, have.get("atypical", 0))
    out = None
    for pool, quota in (("atypical", first), ("typical", min(size - first, have.get("typical", 0)))):
        own = rows.filter(F.col("pool") == pool).withColumnRenamed("program", "stratum")
        quotas = sampling.allocate(own.groupBy("stratum").agg(F.count("*").alias("size")), quota, floor)
        drawn = sampling.draw(own, quotas, "id", f"{seed}:{pool}").withColumnRenamed("stratum", "program")
        out = drawn if out is None else out.unionByName(drawn)
    return out.withColumn("position", F.row_number().over(W.orderBy(sampling.hash_order(f"{seed}:position", "id"), "id")).cast("long")).select("id", "pool", "program", "draw_order", "position")
