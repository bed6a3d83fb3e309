"""The index that a proposal is asked against: vectors, labels, centroids, threshold and gaps of a published run; the encoder that must be the one the
index was made with; and the answer."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import Counter, chunks, word_tokens
from corpuslens.operators import search, terms
from corpuslens.sources.strict import manifest, read_verified

#: Tables that a published run has.
TABLES = ("rows", "labels", "gaps")


@dataclass(frozen=True)
class Index:
    """Frames of one run, cached once and used by every query, and the facts of its manifest."""

    rows: DataFrame
    labels: DataFrame
    gaps: DataFrame
    centroids: DataFrame
    threshold: DataFrame
    saturation: DataFrame
    facts: Mapping[str, object]

    def release(self) -> None:
        for df in (self.rows, self.labels, self.gaps, self.centroids, self.threshold, self.saturation):
            df.unpersist()


def load(spark: SparkSession, home: str, percentile: float = 0.05) -> Index:
    """The published run at ``home``. Tables that differ from their manifest, or from each other, are refused."""
    facts = manifest(spark, home)["facts"]
    rows, labels, gaps = (read_verified(spark, home, name).persist() for name in TABLES)
    if rows.select("id").exceptAll(labels.select("id")).limit(1).count() or labels.select("id").exceptAll(rows.select("id")).limit(1).count():
        raise ValueError("vectors and labels are of different documents")
    topics = labels.filter("label <> -1").select(F.col("label").alias("topic")).distinct()
    if gaps.select(F.col("first").alias("topic")).union(gaps.select("second").filter("second is not null")).join(topics, "topic", "left_anti").limit(1).count():
        raise ValueError("a gap names a topic that the map lacks")
    cents = search.centroids(rows, labels).persist()
    limit = search.atypical_threshold(search.member_similarities(rows, labels, cents), percentile).persist()
    sizes = labels.filter("label <> -1").groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("size"))
    return Index(rows, labels, gaps, cents, limit, search.saturation(sizes).persist(), facts)


@dataclass(frozen=True)
class Encoder:
    """A model by name and revision, its token counter and limit, and the function from texts to vectors."""

    model: str
    revision: str
    limit: int
    encode: Callable[[list[str]], list[list[float]]]
    count: Counter = word_tokens


def matching(encoder: Encoder, index: Index) -> Encoder:
    """The encoder, if it is the one that the index was made with and its limit holds the index's longest chunk."""
    wanted = {k: index.facts.get(k) for k in ("model", "revision")}
    if wanted != {"model": encoder.model, "revision": encoder.revision}:
        raise ValueError(f"the index was made with {wanted['model']} at {wanted['revision']}")
    if int(index.facts.get("longest_chunk", 0)) > encoder.limit:
        raise ValueError("the encoder would cut the index's longest chunk")
    return encoder


def represent(spark: SparkSession, sections: Mapping[str, str], encoder: Encoder) -> DataFrame:
    """One row (id 0, vec): the sections of a proposal cut, encoded and pooled as documents are."""
    rows = spark.createDataFrame([(0, name, text) for name, text in sections.items() if text and text.strip()], "doc_id bigint, section string, text string")
    cut = chunks(rows, encoder.limit, encoder.count).orderBy("section", "chunk_index").select("section", "text").collect()
    if not cut:
        raise ValueError("the proposal has no text")
    vectors = encoder.encode([r.text for r in cut])
    frame = spark.createDataFrame([(0, r.section, [float(x) for x in v]) for r, v in zip(cut, vectors, strict=True)], "doc bigint, section string, vec array<double>")
    return terms.pool(frame).select(F.col("doc").alias("id"), "vec")


def answer(query: DataFrame, index: Index, *, k: int = 5, mmr_weight: float = 0.7, pool: int = 40, neighbours: int = 3, gaps: int = 3) -> dict[str, DataFrame]:
    """What the index says of one vector (id, vec): assignment (topic, sim, margin, atypical, quartile), similar, antecedents, neighbours, nearby gaps."""
    placed = search.assign(query, index.centroids).join(index.saturation.select("topic", "quartile"), "topic", "left").crossJoin(F.broadcast(index.threshold))
    topics = index.centroids.select(F.col("topic").alias("id"), F.col("centroid").alias("vec"))
    own = placed.select(F.col("topic").alias("own"))
    lines = search.scores(topics, query).crossJoin(F.broadcast(own)).filter("id <> own").orderBy(F.desc(F.round("score", 9)), "id").limit(neighbours)
    return {
        "assignment": placed.select("topic", "sim", "second", "margin", (F.round("sim", 9) < F.round("threshold", 9)).alias("atypical"), "quartile"),
        "similar": search.top_k(index.rows, query, k),
        "antecedents": search.mmr(index.rows, query, k, mmr_weight, pool),
        "neighbours": lines.select(F.col("id").alias("topic"), "score"),
        "gaps": search.nearby_gaps(index.centroids, index.gaps, query, gaps),
    }


#: Points that a figure shows at most.
POINTS = 20_000


def figure(points: DataFrame, title: str, most: int = POINTS) -> dict:
    """A scatter plot of the map (id, x, y, label) as a Vega-Lite description: noise grey below the topics. More points than a screen can show are
    refused, not thinned."""
    rows = points.select("id", "x", "y", "label").orderBy("label", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points are no figure")
    values = [{"id": r.id, "x": r.x, "y": r.y, "topic": "noise" if r.label == -1 else str(r.label)} for r in rows]
    topics = sorted({v["topic"] for v in values if v["topic"] != "noise"}, key=int)
    layer = lambda keep, colour: {"transform": [{"filter": keep}], "mark": {"type": "point", "filled": True}, "encoding": {"x": {"field": "x", "type": "quantitative"}, "y": {"field": "y", "type": "quantitative"}, "color": colour, "tooltip": [{"field": "id"}, {"field": "topic"}]}}
    return {
        "$schema": "https://vega.github.io/schema/vega-lite/v5.json",
        "title": title,
        "data": {"values": values},
        "layer": [layer("datum.topic == 'noise'", {"value": "#bbbbbb"}), layer("datum.topic != 'noise'", {"field": "topic", "type": "nominal", "scale": {"domain": topics}})],
    }
