"""Cosine search, centroids, assignment to the nearest centroid, outliers, saturation, diversity and neighbouring topics.

Vectors are frames (id, vec array<double>), labelings (id, label) with -1 for noise, centroids (topic, centroid). There are few centroids:
a frame of them is broadcast only up to ``CENTROIDS`` rows, and beyond it the join is dealt by topic blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.vectors import as_double, clipped, cosine, dot, norm, unit
from corpuslens.operators.blocks import Block, cells
from corpuslens.operators.running import quantile

NOISE = -1
CENTROIDS = 10_000


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), as_double(vec_col).alias("vec"))


def against_all(rows: DataFrame, few: DataFrame, limit: int = CENTROIDS) -> DataFrame:
    """Every row with every row of a small frame. The small side is counted before it is broadcast; a larger one goes block by block."""
    n = few.count()
    if n <= limit:
        return rows.crossJoin(F.broadcast(few))
    blocks = -(-n // limit)
    dealt = few.withColumn("block__", F.pmod(F.xxhash64(few.columns[0]), F.lit(blocks)))
    return rows.withColumn("block__", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(dealt, "block__").drop("block__")


def beside(rows: DataFrame, few: DataFrame, name: str, limit: int = CENTROIDS) -> DataFrame | None:
    """``rows`` with all of a small frame as an array of structs, so that what compares them needs no shuffle of the rows; None if there
    are too many."""
    if few.count() > limit:
        return None
    return rows.crossJoin(F.broadcast(few.agg(F.collect_list(F.struct(*few.columns)).alias(name))))


def nearest_two(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """id, and the two nearest topics as structs (neg, topic, sim), ties to the lower topic."""
    ordered = lambda topic, sim: F.struct((-F.round(sim, 9)).alias("neg"), topic.alias("topic"), sim.alias("sim"))
    near = beside(rows, cents, "cs")
    if near is not None:
        sims = F.transform("cs", lambda c: ordered(c["topic"], clipped(cosine(F.col("vec"), c["centroid"]))))
        return near.select("id", F.slice(F.array_sort(sims), 1, 2).alias("two"))
    sim = against_all(rows, cents).select("id", "topic", clipped(cosine("vec", "centroid")).alias("sim"))
    return sim.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(ordered(F.col("topic"), F.col("sim")))), 1, 2).alias("two"))


def scores(rows: DataFrame, query: DataFrame) -> DataFrame:
    """Cosine of each row with the one query (qvec)."""
    return rows.crossJoin(F.broadcast(query.select(F.col("vec").alias("qvec")).limit(1))).select("id", cosine("vec", "qvec").alias("score"), "vec")


def top_k(rows: DataFrame, query: DataFrame, k: int, exclude: object = None) -> DataFrame:
    """The k nearest rows, ties to the smaller id."""
    found = scores(rows, query)
    if exclude is not None:
        found = found.filter(F.col("id") != F.lit(exclude))
    return found.select("id", "score").orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def pair_cosines(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The cosine of each given pair (a, b); a pair of a row with itself is refused."""
    checked = pairs.withColumn("a", F.when(F.col("a") != F.col("b"), F.col("a")).otherwise(F.raise_error(F.lit("a pair of a row with itself")).cast("bigint")))
    left, right = rows.select(F.col("id").alias("a"), F.col("vec").alias("va")), rows.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return checked.join(left, "a").join(right, "b").select("a", "b", cosine("va", "vb").alias("score"))


def all_pairs(rows: DataFrame, blocks: int) -> DataFrame:
    """Each unordered pair a < b once, joined block by block on a key: a grid of blocks, none of which is the whole table."""
    dealt = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = dealt.select(F.col("id").alias("a"), F.col("vec").alias("va"), F.col("blk").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    right = dealt.select(F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("blk").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))
    return left.join(right, ["i", "j"]).filter("a < b").drop("i", "j")


def pair_summary(rows: DataFrame, labels: DataFrame, block: int = 512) -> DataFrame:
    """Pairs a < b by whether their labels are equal: same_topic, pairs, mean_score, max_score of their cosines. Blocks are multiplied and
    summed up where they meet, so no pair is a row."""
    tagged = rows.join(labels.select("id", F.xxhash64("label").alias("tag")), "id")

    def fold(a: Block, b: Block, same: bool) -> pa.Table:
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a.vecs, b.vecs))
        out = []
        for lo in range(0, len(x), 512):
            scores, equal = x[lo : lo + 512] @ y.T, a.tags[lo : lo + 512, None] == b.tags
            wanted = np.arange(lo, lo + len(scores))[:, None] < np.arange(len(y)) if same else np.ones(scores.shape, bool)
            for flag in (True, False):
                some = scores[wanted & (equal == flag)]
                if len(some):
                    out.append((flag, len(some), float(some.sum()), float(some.max())))
        return pa.table(dict(zip(("same_topic", "n", "total", "most"), zip(*out, strict=True) if out else [()] * 4, strict=True)), schema=pa.schema([("same_topic", pa.bool_()), ("n", pa.int64()), ("total", pa.float64()), ("most", pa.float64())]))

    parts = cells(tagged, block, fold, "same_topic boolean, n bigint, total double, most double")
    return parts.groupBy("same_topic").agg(F.sum("n").alias("pairs"), (F.sum("total") / F.sum("n")).alias("mean_score"), F.max("most").alias("max_score"))


def centroids(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Plain mean of the vectors of each label; noise has none."""
    long = rows.join(labels.filter(F.col("label") != NOISE), "id").select("label", F.posexplode("vec").alias("pos", "x"))
    per = long.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return per.groupBy(F.col("label").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def assign(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """Nearest topic of each row, its cosine, the runner-up's and the margin (null with one topic); ties to the lower topic."""
    best = nearest_two(rows, cents)
    second = F.try_element_at("two", F.lit(2))["sim"]
    return best.filter("size(two) > 0").select("id", F.col("two")[0]["topic"].alias("topic"), F.col("two")[0]["sim"].alias("sim"), second.alias("second"), (F.col("two")[0]["sim"] - second).alias("margin"))


def member_similarities(rows: DataFrame, labels: DataFrame, cents: DataFrame) -> DataFrame:
    return rows.join(labels.filter(F.col("label") != NOISE), "id").join(cents, F.col("label") == F.col("topic")).select("id", "topic", cosine("vec", "centroid").alias("sim"))


def atypical_threshold(members: DataFrame, percentile: float, per_topic: bool = False) -> DataFrame:
    if not per_topic:
        return quantile(members, "sim", percentile, "threshold")
    return members.groupBy("topic").agg(F.percentile("sim", F.lit(percentile)).alias("threshold"))


def saturation(sizes: DataFrame, boundary: str = "lower") -> DataFrame:
    """Quartile of each topic's size (topic, size) by value; null with a reason if there are no two sizes."""
    cuts = sizes.agg(F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"), F.countDistinct("size").alias("distinct_sizes"))
    above = (lambda c: F.col("size") > c) if boundary == "lower" else (lambda c: F.col("size") >= c)
    quartile = 1 + sum((above(F.col("cuts")[k]).cast("int") for k in range(1, 3)), above(F.col("cuts")[0]).cast("int"))
    joined = sizes.crossJoin(F.broadcast(cuts))
    equal = F.col("distinct_sizes") < 2
    return joined.select("topic", "size", F.when(~equal, quartile).cast("long").alias("quartile"), F.when(equal, F.lit("equal_sizes")).alias("undefined_reason"))


def mmr(rows: DataFrame, query: DataFrame, k: int, weight: float, pool_size: int, exclude: object = None) -> DataFrame:
    """Maximal marginal relevance over the ``pool_size`` most similar rows: rank, id, similarity, value.

    The first term of redundancy is 0; ties go to the greater similarity, then the smaller id. Only the pool, a bounded top-k, is
    ranked step by step, in one task.
    """
    found = scores(rows, query)
    if exclude is not None:
        found = found.filter(F.col("id") != F.lit(exclude))
    pool = found.orderBy(F.desc(F.round("score", 9)), "id").limit(pool_size)

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sim = frame["id"].to_numpy(), frame["score"].to_numpy()
        v = np.stack(frame["vec"].to_list())
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        closest, picked, out = np.zeros(len(ids)), np.zeros(len(ids), bool), []
        for step in range(min(k, len(ids))):
            value = weight * sim - (1 - weight) * closest
            at = min(np.flatnonzero(~picked), key=lambda i: (-round(value[i], 9), -round(sim[i], 9), ids[i]))
            out.append((step + 1, ids[at], sim[at], value[at]))
            picked[at] = True
            near = v @ v[at]
            closest = near if step == 0 else np.maximum(closest, near)
        return pd.DataFrame(out, columns=["rank", "id", "similarity", "value"])

    return pool.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(rank, "rank bigint, id bigint, similarity double, value double")


def topic_pairs(cents: DataFrame) -> DataFrame:
    """Cosine of each ordered pair of topics t <> u."""
    other = cents.select(F.col("topic").alias("u"), F.col("centroid").alias("cu"))
    return against_all(cents.select(F.col("topic").alias("t"), F.col("centroid").alias("ct")), other).filter("t <> u").select("t", "u", clipped(cosine("ct", "cu")).alias("cos"))


def nearest_topics(cents: DataFrame, n: int) -> DataFrame:
    by = W.partitionBy("t").orderBy(F.desc(F.round("cos", 9)), "u")
    return topic_pairs(cents).withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= n)


def nearby_gaps(cents: DataFrame, gaps: DataFrame, query: DataFrame, n: int) -> DataFrame:
    """The gaps (gap_no, first, second) nearest to the query: distance to the topic's centroid, or to the midpoint of a pair's."""
    one = gaps.join(cents.select(F.col("topic").alias("first"), F.col("centroid").alias("c1")), "first").join(cents.select(F.col("topic").alias("second"), F.col("centroid").alias("c2")), "second", "left")
    anchor = F.when(F.col("c2").isNull(), unit("c1")).otherwise(F.zip_with(unit("c1"), unit("c2"), lambda x, y: (x + y) / 2))
    far = one.withColumn("anchor", anchor).crossJoin(F.broadcast(query.select(F.col("vec").alias("qvec")).limit(1)))
    return far.select("gap_no", "first", "second", (1 - clipped(cosine("anchor", "qvec"))).alias("distance")).orderBy(F.round("distance", 9), "gap_no").limit(n)


__all__ = ["all_pairs", "assign", "atypical_threshold", "centroids", "dot", "member_similarities", "mmr", "nearby_gaps", "nearest_topics", "norm", "pair_cosines", "saturation", "scores", "top_k", "topic_pairs", "vectors"]
