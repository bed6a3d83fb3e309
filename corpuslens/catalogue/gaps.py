"""Gap rules: three runs of the topic map over ``embeddings``; program is a fifth of the ids, year comes from the id, and the topics of events
by user group stand for programs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.catalogue.topic_map import _cents, _v, C
from corpuslens.operators import gaps
from corpuslens.registry import query
from corpuslens.tables import table

# The stand-in for the affinity of programs, 0 to 2, each unordered pair once.
AFFINITY = [(0, 1, 2), (0, 2, 1), (0, 3, 0), (0, 4, 1), (1, 2, 2), (1, 3, 1), (1, 4, 0), (2, 3, 2), (2, 4, 1), (3, 4, 2)]
L = "WITH r AS (SELECT unnest([0, 1, 2]) AS run), l AS (SELECT run, vec_id AS id, CASE WHEN vec_id % 10 = run THEN -1 WHEN vec_id % 11 = run THEN (label + 1) % 10 ELSE label END AS label FROM embeddings, r)"
S = L + ", s AS (SELECT run, label AS topic, count(*) AS size FROM l WHERE label <> -1 GROUP BY run, label), p AS (SELECT run, topic, CASE WHEN topic = 3 THEN NULL ELSE ((topic * 37 + run * 11) % 100) / 100.0::DOUBLE END AS npmi FROM s)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run"), F.col("vec_id").alias("id"), "label")
    label = F.when(F.col("id") % 10 == F.col("run"), -1).when(F.col("id") % 11 == F.col("run"), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("run", "id", label.cast("int").alias("label"))


def _npmi(sizes: DataFrame) -> DataFrame:
    value = F.when(F.col("topic") != 3, ((F.col("topic") * 37 + F.col("run") * 11) % 100) / F.lit(100.0))
    return sizes.select("run", "topic", value.alias("npmi"))


@query(S + ", c AS (SELECT quantile_cont(size, 0.25) AS size_cut, (SELECT quantile_cont(npmi, 0.25) FROM p) AS npmi_floor FROM s) SELECT round(size_cut, 6) AS size_cut, round(npmi_floor, 6) AS npmi_floor FROM c")
def gap_cuts(spark: SparkSession, d: str) -> DataFrame:
    sizes = gaps.topic_sizes(_runs(spark, d))
    return gaps.small_topic_cuts(sizes, _npmi(sizes), 0.25).select(F.round("size_cut", 6).alias("size_cut"), F.round("npmi_floor", 6).alias("npmi_floor"))


@query(S + ", c AS (SELECT quantile_cont(size, 0.25) AS size_cut, (SELECT quantile_cont(npmi, 0.25) FROM p) AS npmi_floor FROM s) SELECT run, topic, size, round(npmi, 6) AS npmi FROM s JOIN p USING (run, topic), c WHERE size <= size_cut AND npmi >= npmi_floor")
def gap_small_topics(spark: SparkSession, d: str) -> DataFrame:
    sizes = gaps.topic_sizes(_runs(spark, d))
    npmi = _npmi(sizes)
    return gaps.small_coherent(sizes, npmi, gaps.small_topic_cuts(sizes, npmi, 0.25)).withColumn("npmi", F.round("npmi", 6))


@query(S + " SELECT run, topic, size FROM s WHERE size * 20 < (SELECT count(*) * 2 FROM embeddings)")
def gap_literal_small(spark: SparkSession, d: str) -> DataFrame:
    return gaps.literal_small(gaps.topic_sizes(_runs(spark, d)), 2 * table(spark, d, "embeddings").count())


B = C + """, q AS (SELECT a.topic AS t, b.topic AS u, greatest(-1, least(1, list_cosine_similarity(a.centroid, b.centroid))) AS cos FROM c a JOIN c b ON a.topic <> b.topic), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(cos, 9) DESC, u) AS rank FROM q),
near AS (SELECT least(t, u) AS t, greatest(t, u) AS u, min(rank) AS rank, any_value(cos) AS cos FROM k WHERE rank <= 3 GROUP BY 1, 2), s AS (SELECT id, topic, list_cosine_similarity(vec, centroid) AS s FROM v, c), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, topic) AS n FROM s),
two AS (SELECT a.id, least(a.topic, b.topic) AS t, greatest(a.topic, b.topic) AS u, a.s AS s1, b.s AS s2 FROM o a JOIN o b ON a.id = b.id AND a.n = 1 AND b.n = 2), br AS (SELECT two.t, two.u, count(*) AS bridge_docs FROM two JOIN q ON two.t = q.t AND two.u = q.u WHERE round((s1 + s2) / sqrt(2 + 2 * cos), 9) > round(greatest(s1, s2), 9) GROUP BY two.t, two.u)"""


@query(B + " SELECT near.t, near.u, rank, round(cos, 6) AS cos, coalesce(bridge_docs, 0) AS bridge_docs FROM near LEFT JOIN br ON near.t = br.t AND near.u = br.u WHERE coalesce(bridge_docs, 0) <= 12")
def gap_interstitial(spark: SparkSession, d: str) -> DataFrame:
    return gaps.interstitial(_v(spark, d), _cents(spark, d), 3, 12).select("t", "u", "rank", F.round("cos", 6).alias("cos"), "bridge_docs")


@query(C + ", m AS (SELECT id, avg(1 - list_cosine_similarity(vec, centroid)) AS mean FROM v, c GROUP BY id), q AS (SELECT quantile_cont(mean, 0.75) AS cut FROM m) SELECT id AS vec_id, round(mean, 6) AS mean_distance FROM m, q WHERE round(mean, 9) > round(cut, 9)".replace(", m AS (SELECT id", ", mm AS (SELECT id").replace("FROM m)", "FROM mm)").replace("FROM m, q", "FROM mm, q"))
def gap_literal_distant(spark: SparkSession, d: str) -> DataFrame:
    return gaps.distant(_v(spark, d), _cents(spark, d)).select(F.col("id").alias("vec_id"), F.round("mean", 6).alias("mean_distance"))


AFF = "a0 AS (SELECT * FROM (VALUES " + ", ".join(map(str, AFFINITY)) + ") t(source, target, score)), a AS (SELECT * FROM a0 UNION ALL SELECT target, source, score FROM a0)"


@query(
    L
    + ", md AS (SELECT vec_id AS id, (vec_id * vec_id) % 5 AS program FROM embeddings), z AS (SELECT program, count(*)::DOUBLE AS docs FROM md GROUP BY program), t AS (SELECT DISTINCT run, label AS topic FROM l WHERE label <> -1), k AS (SELECT run, label AS topic, program, count(*) AS n FROM l JOIN md USING (id) GROUP BY ALL), g AS (SELECT t.run, t.topic, z.program, coalesce(n, 0) AS n, coalesce(n, 0) / docs AS share FROM t CROSS JOIN z LEFT JOIN k ON k.run = t.run AND k.topic = t.topic AND k.program = z.program), "
    + AFF
    + " SELECT x.run, x.topic, x.program AS source, y.program AS target, x.n AS source_n, round(x.share, 6) AS source_share, round(y.share, 6) AS target_share, score FROM g x JOIN g y ON x.run = y.run AND x.topic = y.topic AND x.program <> y.program JOIN a ON a.source = x.program AND a.target = y.program WHERE x.n >= 5 AND x.share >= 0.05 AND y.share <= 0.08 AND y.program NOT IN (2) AND score >= 1"
)
def gap_transferable(spark: SparkSession, d: str) -> DataFrame:
    metadata = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("vec_id") * F.col("vec_id")) % 5).alias("program"))
    close = spark.createDataFrame(AFFINITY + [(b, a, s) for a, b, s in AFFINITY], "source bigint, target bigint, score int")
    got = gaps.transferable(_runs(spark, d), metadata, close, [2], least_count=5, least_share=0.05, rare=0.08, least_affinity=1)
    return got.select("run", "topic", "source", "target", "source_n", F.round("source_share", 6).alias("source_share"), F.round("target_share", 6).alias("target_share"), "score")


@query(
    "WITH e AS (SELECT event_type AS topic, day(ts) < 16 AS early FROM events), t AS (SELECT count(*) FILTER (early) AS e, count(*) FILTER (NOT early) AS l FROM e), p AS (SELECT topic, count(*) FILTER (early) AS early_n, count(*) FILTER (NOT early) AS late_n FROM e GROUP BY topic) SELECT topic, early_n, late_n, round(early_n / e, 6) AS early_share, round(late_n / l, 6) AS late_share FROM p, t WHERE early_n >= 5 AND round(early_n / e - late_n / l, 9) >= 0.001"
)
def gap_temporal_decline(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    labels = events.select(F.lit(0).alias("run"), F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    names = labels.select("name").distinct().groupBy().agg(F.array_sort(F.collect_list("name")).alias("n")).select(F.posexplode("n").alias("label", "name"))
    metadata = events.select(F.col("event_id").alias("id"), F.dayofmonth("ts").alias("year"))
    got = gaps.declines(labels.join(F.broadcast(names), "name").select("run", "id", "label"), metadata, 16, 5, 0.001).join(names, F.col("topic") == F.col("label"))
    return got.select(F.col("name").alias("topic"), "early_n", "late_n", F.round("early_share", 6).alias("early_share"), F.round("late_share", 6).alias("late_share"))


@query(
    L
    + """, g AS (SELECT run, label AS topic, id FROM l WHERE label <> -1), z AS (SELECT run, topic, count(*) AS size FROM g GROUP BY ALL), b AS (SELECT x.topic, y.run, y.topic AS other, count(*)::DOUBLE AS shared FROM g x JOIN g y ON x.run = 0 AND y.run > 0 AND x.id = y.id GROUP BY ALL),
j AS (SELECT b.topic, b.run, max(shared / (zx.size + zy.size - shared)) AS best FROM b JOIN z zx ON zx.run = 0 AND zx.topic = b.topic JOIN z zy ON zy.run = b.run AND zy.topic = b.other GROUP BY ALL), s AS (SELECT topic, count(*) AS k FROM j WHERE best >= 0.68 GROUP BY topic)
SELECT 'G-0-' || z.topic AS gap_id, coalesce(k, 0) + 1 AS support, coalesce(k, 0) + 1 >= 3 AS stable FROM z LEFT JOIN s USING (topic) WHERE run = 0"""
)
def gap_support(spark: SparkSession, d: str) -> DataFrame:
    labels = _runs(spark, d).filter("label <> -1")
    members = labels.select(F.format_string("G-%d-%d", "run", "label").alias("gap_id"), "run", F.lit("a").alias("rule"), F.lit("").alias("match_key"), "id")
    return gaps.support(members, 0, 3, 0.68).select("gap_id", F.col("support").cast("long").alias("support"), "stable")


@query(
    L
    + """, m AS (SELECT 'G-0-' || label AS gap_id, id, (id * id) % 5 AS program, 2000 + id % 4 AS year FROM l WHERE run = 0 AND label <> -1), p AS (SELECT gap_id, string_agg(program || ':' || n, ',' ORDER BY program) AS programs FROM (SELECT gap_id, program, count(*) AS n FROM m GROUP BY ALL) GROUP BY gap_id),
y AS (SELECT gap_id, string_agg(year || ':' || n, ',' ORDER BY year) AS years FROM (SELECT gap_id, year, count(*) AS n FROM m GROUP BY ALL) GROUP BY gap_id) SELECT gap_id, (SELECT count(*) FROM m WHERE m.gap_id = p.gap_id) AS theses, programs, years FROM p JOIN y USING (gap_id)"""
)
def gap_evidence(spark: SparkSession, d: str) -> DataFrame:
    members = _runs(spark, d).filter("run = 0 and label <> -1").select(F.format_string("G-0-%d", "label").alias("gap_id"), "id")
    metadata = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("vec_id") * F.col("vec_id")) % 5).alias("program"), (F.col("vec_id") % 4 + 2000).alias("year"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["key"].cast("string"), x["n"].cast("string"))), ",")
    got = gaps.evidence(members, metadata)
    return got.select("gap_id", "theses", shown("program_counts").alias("programs"), shown("year_counts").alias("years"))


@query(
    S
    + """, c AS (SELECT quantile_cont(size, 0.25) AS size_cut, (SELECT quantile_cont(npmi, 0.25) FROM p) AS floor_ FROM s), f AS (SELECT 'primary' AS variant, run, topic FROM s JOIN p USING (run, topic), c WHERE size <= size_cut AND npmi >= floor_ UNION ALL SELECT 'no_floor', run, topic FROM s, c WHERE size <= size_cut UNION ALL SELECT 'twice_cut', run, topic FROM s JOIN p USING (run, topic), c WHERE size <= 2 * size_cut AND npmi >= floor_),
g AS (SELECT v.variant, r.run, count(f.topic) AS gaps, count(q.topic) AS shared FROM (SELECT unnest(['primary', 'no_floor', 'twice_cut']) AS variant) v CROSS JOIN r LEFT JOIN f ON f.variant = v.variant AND f.run = r.run LEFT JOIN (SELECT run, topic FROM f WHERE variant = 'primary') q ON q.run = f.run AND q.topic = f.topic GROUP BY ALL)
SELECT variant, run, gaps, coalesce(round(shared / nullif(gaps + (SELECT gaps FROM g h WHERE h.variant = 'primary' AND h.run = g.run) - shared, 0), 6), -1) AS jaccard FROM g"""
)
def gap_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    sizes = gaps.topic_sizes(_runs(spark, d))
    npmi = _npmi(sizes)
    cuts = gaps.small_topic_cuts(sizes, npmi, 0.25)
    found = {
        "primary": gaps.small_coherent(sizes, npmi, cuts),
        "no_floor": sizes.crossJoin(F.broadcast(cuts)).filter("size <= size_cut"),
        "twice_cut": gaps.small_coherent(sizes, npmi, cuts.withColumn("size_cut", F.col("size_cut") * 2)),
    }
    return gaps.sensitivity(found, sizes).withColumn("jaccard", F.coalesce(F.round("jaccard", 6), F.lit(-1.0)))
