"""Rules over a topic map that point at gaps, and how stable they are across runs.

Inputs: labels (run, id, label; -1 is noise), metadata (id, program, year), centroids per run, topic_npmi (run, topic, npmi), affinity (source,
target, score, both directions). Shares of a program count all its documents, noise included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.vectors import clipped, cosine, dot, norm, unit
from corpuslens.operators.running import quantile
from corpuslens.operators.search import NOISE, nearest_topics, nearest_two


def topic_sizes(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("label") != NOISE).groupBy("run", F.col("label").alias("topic")).agg(F.count("*").alias("size"))


def small_topic_cuts(sizes: DataFrame, npmi: DataFrame, quantile: float) -> DataFrame:
    """The first quartile of all runs' topic sizes, and the quantile of the defined coherences."""
    return sizes.agg(F.percentile("size", F.lit(0.25)).alias("size_cut")).crossJoin(npmi.agg(F.percentile("npmi", F.lit(quantile)).alias("npmi_floor")))


def small_coherent(sizes: DataFrame, npmi: DataFrame, cuts: DataFrame) -> DataFrame:
    """Topics of at most the cut in size and at least the floor in coherence; an undefined coherence fails."""
    joined = sizes.join(npmi, ["run", "topic"], "left").crossJoin(F.broadcast(cuts))
    return joined.filter((F.col("size") <= F.col("size_cut")) & (F.col("npmi") >= F.col("npmi_floor"))).select("run", "topic", "size", "npmi")


def literal_small(sizes: DataFrame, n: int) -> DataFrame:
    """Topics under 5 percent of the documents, in integers."""
    return sizes.filter(F.col("size") * 20 < n)


def bridges(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """How many documents lie between each pair of topics t < u: those whose two nearest centroids they are and that are nearer to the
    pair's midpoint direction than to either; an antipodal pair has none."""
    two = nearest_two(rows, cents).filter("size(two) = 2")
    pairs = two.select("id", F.least(F.col("two")[0]["topic"], F.col("two")[1]["topic"]).alias("t"), F.greatest(F.col("two")[0]["topic"], F.col("two")[1]["topic"]).alias("u"), F.col("two")[0]["sim"].alias("s1"), F.col("two")[1]["sim"].alias("s2"))
    other = cents.select(F.col("topic").alias("u"), F.col("centroid").alias("cu"))
    between = pairs.select("t", "u").distinct().join(cents.select(F.col("topic").alias("t"), F.col("centroid").alias("ct")), "t").join(other, "u").select("t", "u", clipped(cosine("ct", "cu")).alias("c"))
    root = F.sqrt(F.greatest(2 + 2 * F.col("c"), F.lit(0.0)))
    return pairs.join(between, ["t", "u"]).filter((root > 0) & (F.round((F.col("s1") + F.col("s2")) / root, 9) > F.round(F.greatest("s1", "s2"), 9))).groupBy("t", "u").agg(F.count("*").alias("bridge_docs"))


def interstitial(rows: DataFrame, cents: DataFrame, nearest: int, most: int) -> DataFrame:
    """Pairs of topics, one among the other's nearest, with at most ``most`` documents between them: t < u, rank, cosine, bridge_docs."""
    near = nearest_topics(cents, nearest).groupBy(F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u")).agg(F.min("rank").alias("rank"), F.first("cos").alias("cos"))
    return near.join(bridges(rows, cents), ["t", "u"], "left").withColumn("bridge_docs", F.coalesce("bridge_docs", F.lit(0))).filter(F.col("bridge_docs") <= most)


def transferable(labels: DataFrame, metadata: DataFrame, affinity: DataFrame, excluded: list, *, least_count: int, least_share: float, rare: float, least_affinity: int) -> DataFrame:
    """Topics present in a program and rare in a program close to it; programs without documents don't occur, excluded ones are no targets."""
    joined = labels.join(metadata, "id")
    size = metadata.groupBy("program").agg(F.count("*").alias("docs"))
    topics = labels.filter(F.col("label") != NOISE).select("run", F.col("label").alias("topic")).distinct()
    counts = joined.filter(F.col("label") != NOISE).groupBy("run", F.col("label").alias("topic"), "program").agg(F.count("*").alias("n"))
    grid = topics.crossJoin(size).join(counts, ["run", "topic", "program"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.col("n").cast("double") / F.col("docs"))
    source = grid.filter((F.col("n") >= least_count) & (F.col("share") >= least_share)).select("run", "topic", F.col("program").alias("source"), F.col("n").alias("source_n"), F.col("share").alias("source_share"))
    target = grid.filter((F.col("share") <= rare) & ~F.col("program").isin(excluded)).select("run", "topic", F.col("program").alias("target"), F.col("share").alias("target_share"))
    close = affinity.filter(F.col("score") >= least_affinity)
    return source.join(target, ["run", "topic"]).filter("source <> target").join(close, ["source", "target"])


def declines(labels: DataFrame, metadata: DataFrame, split: int, least_count: int, least_decline: float) -> DataFrame:
    """Topics whose share fell between the period before ``split`` and the period from it on, whose totals count all documents."""
    joined = labels.join(metadata, "id").withColumn("early", F.col("year") < split)
    totals = joined.groupBy("run").agg(F.count_if("early").alias("early_total"), F.count_if(~F.col("early")).alias("late_total"))
    per = joined.filter(F.col("label") != NOISE).groupBy("run", F.col("label").alias("topic")).agg(F.count_if("early").alias("early_n"), F.count_if(~F.col("early")).alias("late_n"))
    share = per.join(totals, "run").withColumn("early_share", F.try_divide(F.col("early_n").cast("double"), F.col("early_total"))).withColumn("late_share", F.try_divide(F.col("late_n").cast("double"), F.col("late_total")))
    return share.filter((F.col("early_n") >= least_count) & (F.round(F.col("early_share") - F.col("late_share"), 9) >= least_decline)).select("run", "topic", "early_n", "late_n", "early_share", "late_share")


def overlaps(members: DataFrame, reference: int) -> DataFrame:
    """Jaccard of the member sets of the reference run's gaps with the gaps of other runs of equal rule and match key: counts of shared members."""
    size = members.groupBy("gap_id").agg(F.count("*").alias("size"))
    mine, others = members.filter(F.col("run") == reference), members.filter(F.col("run") != reference)
    shared = mine.alias("a").join(others.alias("b"), F.expr("a.rule = b.rule and a.match_key = b.match_key and a.id = b.id")).groupBy(F.col("a.gap_id").alias("gap_id"), F.col("b.gap_id").alias("other"), F.col("b.run").alias("run")).agg(F.count("*").alias("both"))
    joined = shared.join(size, "gap_id").join(size.select(F.col("gap_id").alias("other"), F.col("size").alias("other_size")), "other")
    return joined.withColumn("jaccard", F.col("both").cast("double") / (F.col("size") + F.col("other_size") - F.col("both")))


def support(members: DataFrame, reference: int, least_runs: int, least_overlap: float) -> DataFrame:
    """In how many other runs each gap of the reference has a counterpart, and whether it is stable."""
    best = overlaps(members, reference).groupBy("gap_id", "run").agg(F.max("jaccard").alias("best"))
    runs = best.filter(F.col("best") >= least_overlap).groupBy("gap_id").agg(F.count("*").alias("support"))
    gaps = members.filter(F.col("run") == reference).select("gap_id").distinct()
    return gaps.join(runs, "gap_id", "left").withColumn("support", F.coalesce("support", F.lit(0)) + 1).withColumn("stable", F.col("support") >= least_runs)


def distant(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """Documents whose mean cosine distance to all centroids is strictly above its third quartile. The mean cosine is the product of the unit vector
    with the mean of the unit centroids, so that a row meets one vector, however many the topics; a repeated id has one mean."""
    each = cents.select(F.posexplode(unit("centroid")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    middle = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("middle"))
    near = rows.crossJoin(F.broadcast(middle)).filter("size(middle) > 0").select("id", (1 - dot("vec", "middle") / norm("vec")).alias("mean"))
    mean = near.groupBy("id").agg(F.avg("mean").alias("mean")).persist()
    cut = quantile(mean, "mean", 0.75, "cut")
    return mean.crossJoin(F.broadcast(cut)).filter(F.round("mean", 9) > F.round("cut", 9)).select("id", "mean")


def evidence(members: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per gap (members: gap_id, id): distinct documents, and its programs and years as sorted (key, n) arrays."""
    joined = members.select("gap_id", "id").distinct().join(metadata, "id")
    counted = lambda key, name: joined.groupBy("gap_id", key).agg(F.count("*").alias("n")).groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "n"))).alias(name))
    size = joined.groupBy("gap_id").agg(F.count("*").alias("theses"))
    return size.join(counted("program", "program_counts"), "gap_id").join(counted("year", "year_counts"), "gap_id")


def sensitivity(found: dict[str, DataFrame], sizes: DataFrame) -> DataFrame:
    """For each variant's topics (run, topic): gaps per run with the zero of runs that have none, and the overlap with the first variant."""
    runs = sizes.select("run").distinct()
    primary = next(iter(found.values())).select("run", "topic").distinct()
    out = None
    for name, topics in found.items():
        own = topics.select("run", "topic").distinct()
        n, p = (df.groupBy("run").agg(F.count("*").alias(c)) for df, c in ((own, "gaps"), (primary, "primary_gaps")))
        both = own.join(primary, ["run", "topic"], "left_semi").groupBy("run").agg(F.count("*").alias("both"))
        row = runs.join(n, "run", "left").join(p, "run", "left").join(both, "run", "left").fillna(0, ["gaps", "primary_gaps", "both"])
        row = row.select(F.lit(name).alias("variant"), "run", "gaps", F.try_divide(F.col("both").cast("double"), F.col("gaps") + F.col("primary_gaps") - F.col("both")).alias("jaccard"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no variants")
    return out


def pair_overlap(j11, j12, j21, j22):
    """Overlap of two gaps of two topics each: the weaker topic under the better matching."""
    return F.greatest(F.least(j11, j22), F.least(j12, j21))
