"""Internal clustering metrics, word coherence, agreement of labelings. Undefined values are null with a reason.

Everything is made of grouped sums; no distance matrix exists. Noise (-1) is left out of the internal metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.vectors import dot, norm, unit
from corpuslens.operators.search import NOISE, against_all, beside, centroids


def points(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Unit vectors of the points that are not noise: id, label, vec."""
    return rows.join(labels.filter(F.col("label") != NOISE), "id").select("id", "label", unit("vec").alias("vec"))


def _sums(pts: DataFrame) -> DataFrame:
    per = pts.select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return per.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))


def silhouette_points(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Cosine silhouette of each point, from the sums of each cluster's unit vectors: mean distance = 1 - v.S/n. Alone in a cluster: 0."""
    pts = points(rows, labels)
    sums = _sums(pts).select(F.col("label").alias("other"), "n", "total")
    # a point's own part of its cluster's sum is at distance 1 - |v|^2 = 0

    def mean(n: Column, total: Column, own: Column) -> Column:
        vs = dot(F.col("vec"), total)
        return F.when(own, F.when(n > 1, (n - vs) / (n - 1))).otherwise(1 - vs / n)

    near = beside(pts, sums, "cs")
    if near is not None:
        each = F.transform("cs", lambda c: F.struct((c["other"] == F.col("label")).alias("own"), mean(c["n"], c["total"], c["other"] == F.col("label")).alias("m")))
        pick = lambda own: F.transform(F.filter("each", lambda c: c["own"] == own), lambda c: c["m"])
        per = near.select("id", "label", each.alias("each")).select("id", "label", F.array_max(pick(True)).alias("a"), F.array_min(pick(False)).alias("b"))
    else:
        far = against_all(pts, sums).withColumn("own", F.col("other") == F.col("label")).withColumn("m", mean(F.col("n"), F.col("total"), F.col("own")))
        per = far.groupBy("id", "label").agg(F.max(F.when(F.col("own"), F.col("m"))).alias("a"), F.min(F.when(~F.col("own"), F.col("m"))).alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return per.select("id", "label", F.coalesce(F.when(F.col("b").isNotNull(), value), F.lit(0.0)).alias("silhouette"))


def silhouette(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """clusters, n_points, silhouette, undefined_reason."""
    s = silhouette_points(rows, labels).agg(F.countDistinct("label").alias("clusters"), F.count("*").alias("n_points"), F.avg("silhouette").alias("s"))
    reason = undefined_reason(F.col("clusters"), F.col("n_points"))
    return s.select("clusters", "n_points", F.when(reason.isNull(), F.col("s")).alias("silhouette"), reason.alias("undefined_reason"))


def undefined_reason(clusters: Column, n: Column) -> Column:
    return F.when(n == 0, "only_noise").when(clusters < 2, "one_cluster").when(clusters >= n, "every_point_alone")


def _squares(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def davies_bouldin(rows: DataFrame, labels: DataFrame) -> DataFrame:
    pts = points(rows, labels)
    cents = centroids(pts.select("id", "vec"), pts.select("id", "label"))
    spread = pts.join(cents, F.col("label") == F.col("topic")).groupBy("topic").agg(F.avg(F.sqrt(_squares("vec", "centroid"))).alias("s"), F.first("centroid").alias("centroid"))
    other = spread.select(F.col("topic").alias("u"), F.col("s").alias("su"), F.col("centroid").alias("cu"))
    ratio = against_all(spread, other).filter("topic <> u").withColumn("r", F.try_divide(F.col("s") + F.col("su"), F.sqrt(_squares("centroid", "cu"))))
    return ratio.groupBy("topic").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame, labels: DataFrame) -> DataFrame:
    pts = points(rows, labels)
    sums = _sums(pts)
    whole = sums.select(F.posexplode("total").alias("pos", "x"), "n").groupBy("pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    total = whole.agg(F.sum(F.col("x") * F.col("x")).alias("sq"), F.max("n").alias("n"))
    per = sums.agg(F.sum(dot("total", "total") / F.col("n")).alias("between"), F.count("*").alias("k"))
    energy = pts.agg(F.sum(dot("vec", "vec")).alias("all"))
    joined = per.crossJoin(total).crossJoin(energy)
    between, within = F.col("between") - F.col("sq") / F.col("n"), F.col("all") - F.col("between")
    return joined.select(F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def npmi(joint: Column, first: Column, second: Column, units: Column) -> Column:
    """-1 if never together, 1 if together in every unit, else pointwise mutual information over -log p."""
    j, a, b, u = (c.cast("double") for c in (joint, first, second, units))
    value = (F.ln(j / u) - F.ln(a / u) - F.ln(b / u)) / (-F.ln(j / u))
    return F.when(j == 0, -1.0).when(j == u, 1.0).otherwise(value)


def coherence_pairs(presence: DataFrame, units: DataFrame, terms: DataFrame) -> DataFrame:
    """NPMI of each pair of a topic's terms (topic, rank, term), by the units (unit, term) they occur in; null for an absent term.

    ``units`` has one row, n. Joint counts are a join within units of the topics' terms only.
    """
    wanted = presence.join(terms.select("term").distinct(), "term", "left_semi").distinct()
    single = wanted.groupBy("term").agg(F.count("*").alias("n_term"))
    joint = wanted.alias("x").join(wanted.alias("y"), F.expr("x.unit = y.unit and x.term < y.term")).groupBy(F.col("x.term").alias("lo"), F.col("y.term").alias("hi")).agg(F.count("*").alias("joint"))
    pairs = terms.alias("p").join(terms.alias("q"), F.expr("p.topic = q.topic and p.rank < q.rank")).select("p.topic", F.col("p.term").alias("term_a"), F.col("q.term").alias("term_b"))
    a, b = single.select(F.col("term").alias("term_a"), F.col("n_term").alias("n_a")), single.select(F.col("term").alias("term_b"), F.col("n_term").alias("n_b"))
    found = pairs.join(a, "term_a", "left").join(b, "term_b", "left").withColumn("lo", F.least("term_a", "term_b")).withColumn("hi", F.greatest("term_a", "term_b")).join(joint, ["lo", "hi"], "left").crossJoin(F.broadcast(units))
    known = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    return found.select("topic", "term_a", "term_b", F.when(known, npmi(F.coalesce("joint", F.lit(0)), F.col("n_a"), F.col("n_b"), F.col("n"))).alias("npmi"))


def coherence(pairs: DataFrame) -> DataFrame:
    """Mean NPMI of each topic; null with a reason if a term is absent."""
    per = pairs.groupBy("topic").agg(F.count("*").alias("pairs"), F.count("npmi").alias("known"), F.avg("npmi").alias("mean"))
    whole = F.col("pairs") == F.col("known")
    return per.select("topic", F.when(whole, F.col("mean")).alias("npmi"), F.when(~whole, "absent_terms").alias("undefined_reason"))


def contingency(first: DataFrame, second: DataFrame, noise: str = "own_label") -> DataFrame:
    """Cells (l1, l2, n) of two labelings (id, label). ``exclude_either`` drops points that either calls noise."""
    joined = first.select("id", F.col("label").alias("l1")).join(second.select("id", F.col("label").alias("l2")), "id")
    if noise == "exclude_either":
        joined = joined.filter((F.col("l1") != NOISE) & (F.col("l2") != NOISE))
    return joined.groupBy("l1", "l2").agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("double")


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """n_points, ari: 1 when both partitions are trivial alike, null without points."""
    a = cells.groupBy("l1").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = cells.groupBy("l2").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("ij"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"))
    joined = both.crossJoin(a).crossJoin(b)
    expected = F.try_divide(F.col("a") * F.col("b"), _pairs(F.col("n_points")))
    room = (F.col("a") + F.col("b")) / 2 - expected
    value = F.when(F.col("n_points") == 0, None).when(F.col("n_points") == 1, 1.0).when(room == 0, 1.0).otherwise(F.try_divide(F.col("ij") - expected, room))
    return joined.select("n_points", value.alias("ari"))


def mutual_information(cells: DataFrame) -> DataFrame:
    """NMI with the arithmetic mean of the entropies; 1 if both are trivial."""
    n = cells.agg(F.sum("n").cast("double").alias("total"))
    entropy = lambda side, name: cells.groupBy(side).agg(F.sum("n").alias("m")).crossJoin(n).agg((-F.sum(F.col("m") / F.col("total") * F.ln(F.col("m") / F.col("total")))).alias(name))
    rows, cols = (cells.groupBy(side).agg(F.sum("n").alias(name)) for side, name in (("l1", "r"), ("l2", "c")))
    mi = cells.join(rows, "l1").join(cols, "l2").crossJoin(n).agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("r") * F.col("c")))).alias("mi"))
    joined = mi.crossJoin(entropy("l1", "h1")).crossJoin(entropy("l2", "h2"))
    return joined.select(F.when((F.col("h1") == 0) & (F.col("h2") == 0), 1.0).otherwise(F.try_divide(2 * F.col("mi"), F.col("h1") + F.col("h2"))).alias("nmi"))


def counterparts(cells: DataFrame) -> DataFrame:
    """For each topic l1 the reference label most of its points have; ties to the lower label; noise is no counterpart of its own."""
    best = F.min_by("l2", F.struct(-F.col("n"), F.col("l2")))
    return cells.filter(F.col("l1") != NOISE).groupBy(F.col("l1").alias("topic")).agg(best.alias("counterpart"), F.max("n").alias("n_shared"))


def counterpart_agreement(assigned: DataFrame, reference: DataFrame, parts: DataFrame) -> DataFrame:
    """Share of points whose reference label is the counterpart of their assigned topic."""
    joined = assigned.select("id", F.col("label").alias("topic")).join(reference.select("id", F.col("label").alias("ref")), "id").join(parts, "topic", "left")
    agree = F.coalesce(F.col("ref") == F.col("counterpart"), F.lit(False)).cast("int")
    return joined.agg(F.count("*").alias("n_points"), F.sum(agree).alias("agreeing"), F.avg(agree.cast("double")).alias("agreement"))


__all__ = ["adjusted_rand", "calinski_harabasz", "coherence", "coherence_pairs", "contingency", "counterpart_agreement", "counterparts", "davies_bouldin", "mutual_information", "norm", "npmi", "points", "silhouette", "silhouette_points"]
