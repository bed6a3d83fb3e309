"""Search, assignment, metrics and stability over ``embeddings``: label is the topic, runs are made by calling a tenth of the points noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.vectors import cosine, norm
from corpuslens.operators import metrics, search
from corpuslens.registry import query
from corpuslens.tables import table

V = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
C = (
    V
    + """, long AS (SELECT label, unnest(range(1, len(vec) + 1)) AS pos, unnest(vec) AS x FROM v WHERE label <> -1),
m AS (SELECT label, pos, avg(x) AS x FROM long GROUP BY label, pos),
c AS (SELECT label AS topic, list(x ORDER BY pos) AS centroid FROM m GROUP BY label)"""
)
SIM = C + ", s AS (SELECT id, label, topic, greatest(-1.0, least(1.0, list_cosine_similarity(vec, centroid))) AS sim FROM v, c)"
A = SIM + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, topic) AS rk, lead(sim) OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, topic) AS second FROM s)"


def _v(spark: SparkSession, d: str) -> DataFrame:
    return search.vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def _labels(spark: SparkSession, d: str, run: int | None = None) -> DataFrame:
    label = F.col("label") if run is None else F.when(F.col("vec_id") % 10 == run, -1).otherwise(F.col("label"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), label.cast("int").alias("label"))


def _one(spark: SparkSession, d: str) -> DataFrame:
    return _v(spark, d).filter("id = 0").select("vec")


def _cents(spark: SparkSession, d: str) -> DataFrame:
    return search.centroids(_v(spark, d), _labels(spark, d))


@query(V + " SELECT b.id AS vec_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM v a, v b WHERE a.id = 0 ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id LIMIT 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(_v(spark, d), _one(spark, d), 10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(V + " SELECT b.id AS vec_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM v a, v b WHERE a.id = 7 AND b.id <> 7 ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id LIMIT 25")
def nearest_documents(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d)
    return search.top_k(v, v.filter("id = 7"), 25, exclude=7).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(V + " SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS score FROM v a JOIN v b ON b.id = a.id + 1")
def pair_lookup(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d)
    pairs = v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return search.pair_cosines(v, pairs).select("a", "b", F.round("score", 6).alias("score"))


@query(V + " SELECT id AS vec_id, round(sqrt(list_sum([x * x FOR x IN vec])), 6) AS length, round(list_sum([x FOR x IN vec]) / sqrt(list_sum([x * x FOR x IN vec])), 6) AS unit_sum FROM v")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    from corpuslens.functions.vectors import unit

    total = F.aggregate(unit("vec"), F.lit(0.0), lambda s, x: s + x)
    return _v(spark, d).select(F.col("id").alias("vec_id"), F.round(norm("vec"), 6).alias("length"), F.round(total, 6).alias("unit_sum"))


@query(V + ", p AS (SELECT a.label AS la, b.label AS lb, list_cosine_similarity(a.vec, b.vec) AS s FROM v a JOIN v b ON a.id < b.id) SELECT la = lb AS same_topic, count(*) AS pairs, round(avg(s), 6) AS mean_score, round(max(s), 6) AS max_score FROM p GROUP BY la = lb")
def all_pairs_summary(spark: SparkSession, d: str) -> DataFrame:
    return search.pair_summary(_v(spark, d), _labels(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_score", "max_score")})


@query(C + " SELECT topic, unnest(range(1, len(centroid) + 1)) AS pos, round(unnest(centroid), 6) AS value FROM c")
def topic_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _cents(spark, d).select("topic", F.posexplode("centroid").alias("p", "x")).select("topic", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("value"))


@query(A + " SELECT id AS vec_id, topic, round(sim, 6) AS sim, round(second, 6) AS second, round(sim - second, 6) AS margin FROM r WHERE rk = 1")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    got = search.assign(_v(spark, d), _cents(spark, d))
    return got.select(F.col("id").alias("vec_id"), "topic", *(F.round(c, 6).alias(c) for c in ("sim", "second", "margin")))


@query(SIM + " SELECT id AS vec_id, topic, round(sim, 6) AS sim FROM s WHERE label = topic")
def member_similarity(spark: SparkSession, d: str) -> DataFrame:
    return search.member_similarities(_v(spark, d), _labels(spark, d), _cents(spark, d)).select(F.col("id").alias("vec_id"), "topic", F.round("sim", 6).alias("sim"))


@query(A + ", t AS (SELECT quantile_cont(sim, 0.05) AS threshold FROM s WHERE label = topic) SELECT id AS vec_id, r.topic, round(threshold, 6) AS threshold, round(sim, 9) < round(threshold, 9) AS atypical FROM r, t WHERE rk = 1")
def atypical_flag(spark: SparkSession, d: str) -> DataFrame:
    v, cents = _v(spark, d), _cents(spark, d)
    limit = search.atypical_threshold(search.member_similarities(v, _labels(spark, d), cents), 0.05)
    return search.assign(v, cents).crossJoin(F.broadcast(limit)).select(F.col("id").alias("vec_id"), "topic", F.round("threshold", 6).alias("threshold"), (F.round("sim", 9) < F.round("threshold", 9)).alias("atypical"))


@query(SIM + " SELECT topic, round(quantile_cont(sim, 0.05), 6) AS threshold FROM s WHERE label = topic GROUP BY topic")
def atypical_per_topic(spark: SparkSession, d: str) -> DataFrame:
    members = search.member_similarities(_v(spark, d), _labels(spark, d), _cents(spark, d))
    return search.atypical_threshold(members, 0.05, per_topic=True).select("topic", F.round("threshold", 6).alias("threshold"))


def _saturation_sql(op: str) -> str:
    return f"""WITH s AS (SELECT label AS topic, count(*) AS size FROM embeddings GROUP BY label), q AS (SELECT quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.5) AS b, quantile_cont(size, 0.75) AS c, count(DISTINCT size) AS n FROM s)
SELECT topic, size, CASE WHEN n > 1 THEN CAST(1 + (size {op} a)::INT + (size {op} b)::INT + (size {op} c)::INT AS BIGINT) END AS quartile, CASE WHEN n < 2 THEN 'equal_sizes' END AS undefined_reason FROM s, q"""


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("size"))


@query(_saturation_sql(">"))
def topic_saturation(spark: SparkSession, d: str) -> DataFrame:
    return search.saturation(_sizes(spark, d))


@query(_saturation_sql(">="))
def topic_saturation_upper(spark: SparkSession, d: str) -> DataFrame:
    return search.saturation(_sizes(spark, d), "upper")


@query(C + ", p AS (SELECT a.topic AS t, b.topic AS u, list_cosine_similarity(a.centroid, b.centroid) AS cos FROM c a JOIN c b ON a.topic <> b.topic), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(cos, 9) DESC, u) AS rank FROM p) SELECT t, u, round(cos, 6) AS cos, rank FROM r WHERE rank <= 3")
def neighbor_topics(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest_topics(_cents(spark, d), 3).select("t", "u", F.round("cos", 6).alias("cos"), "rank")


def _mmr_sql(k: int) -> str:
    steps = [V + ", p AS (SELECT b.id, b.vec, list_cosine_similarity(a.vec, b.vec) AS s FROM v a, v b WHERE a.id = 0 AND b.id <> 0 ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id LIMIT 40)"]
    steps.append("k1 AS (SELECT id, vec, s, 0.7::DOUBLE * s AS val FROM p ORDER BY round(0.7::DOUBLE * s, 9) DESC, round(s, 9) DESC, id LIMIT 1)")
    for i in range(2, k + 1):
        picked = " UNION ALL ".join(f"SELECT id, vec FROM k{j}" for j in range(1, i))
        steps.append(f"x{i} AS (SELECT p.id, p.vec, p.s, 0.7::DOUBLE * p.s - (1 - 0.7::DOUBLE) * (SELECT max(list_cosine_similarity(p.vec, q.vec)) FROM ({picked}) q) AS val FROM p WHERE p.id NOT IN (SELECT id FROM ({picked}) z))")
        steps.append(f"k{i} AS (SELECT * FROM x{i} ORDER BY round(val, 9) DESC, round(s, 9) DESC, id LIMIT 1)")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS rank, id AS vec_id, round(s, 6) AS similarity, round(val, 6) AS value FROM k{i}" for i in range(1, k + 1))


@query(_mmr_sql(5))
def mmr_antecedents(spark: SparkSession, d: str) -> DataFrame:
    got = search.mmr(_v(spark, d), _one(spark, d), 5, 0.7, 40, exclude=0)
    return got.select("rank", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), F.round("value", 6).alias("value"))


@query(
    C
    + """, u AS (SELECT topic, [x / sqrt(list_sum([y * y FOR y IN centroid])) FOR x IN centroid] AS c FROM c),
g AS (SELECT topic AS gap_no, topic AS first, CASE WHEN topic % 2 = 1 THEN topic - 1 END AS second FROM c),
a AS (SELECT gap_no, first, second, CASE WHEN second IS NULL THEN x.c ELSE [(x.c[i] + y.c[i]) / 2 FOR i IN range(1, len(x.c) + 1)] END AS anchor FROM g JOIN u x ON first = x.topic LEFT JOIN u y ON second = y.topic)
SELECT gap_no, first, coalesce(second, -1) AS second, round(1 - list_cosine_similarity(anchor, vec), 6) AS distance FROM a, v WHERE id = 0 ORDER BY round(1 - list_cosine_similarity(anchor, vec), 9), gap_no LIMIT 4"""
)
def nearby_gaps(spark: SparkSession, d: str) -> DataFrame:
    cents = _cents(spark, d)
    gaps = cents.select(F.col("topic").alias("gap_no"), F.col("topic").alias("first"), F.when(F.col("topic") % 2 == 1, F.col("topic") - 1).alias("second"))
    return search.nearby_gaps(cents, gaps, _one(spark, d), 4).select("gap_no", "first", F.coalesce("second", F.lit(-1)).alias("second"), F.round("distance", 6).alias("distance"))


UNIT = (
    V
    + """, u AS (SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE label END AS label, [x / sqrt(list_sum([y * y FOR y IN vec])) FOR x IN vec] AS vec FROM v),
w AS (SELECT * FROM u WHERE label <> -1)"""
)


@query(
    UNIT
    + """, dist AS (SELECT a.id, a.label, b.label AS other, avg(1 - list_inner_product(a.vec, b.vec)) FILTER (a.id <> b.id) AS m FROM w a, w b GROUP BY a.id, a.label, b.label),
s AS (SELECT id, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM dist GROUP BY id),
t AS (SELECT CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS sil FROM s)
SELECT (SELECT count(DISTINCT label) FROM w) AS clusters, count(*) AS n_points, round(avg(sil), 6) AS silhouette, CAST(NULL AS VARCHAR) AS undefined_reason FROM t"""
)
def silhouette_cosine(spark: SparkSession, d: str) -> DataFrame:
    return metrics.silhouette(_v(spark, d), _labels(spark, d, 0)).withColumn("silhouette", F.round("silhouette", 6))


UC = UNIT + ", l AS (SELECT label, unnest(range(1, len(vec) + 1)) AS pos, unnest(vec) AS x FROM w), m AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label)"


@query(UC + ", s AS (SELECT w.label, avg(list_distance(vec, c)) AS s, any_value(c) AS c FROM w JOIN c USING (label) GROUP BY w.label), r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return metrics.davies_bouldin(_v(spark, d), _labels(spark, d, 0)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(
    UC
    + """, g AS (SELECT pos, avg(x) AS x FROM l GROUP BY pos), gm AS (SELECT list(x ORDER BY pos) AS g FROM g),
b AS (SELECT sum(n * list_distance(c, g) ^ 2) AS b, count(*) AS k, sum(n) AS n FROM c JOIN (SELECT label, count(*) AS n FROM w GROUP BY label) USING (label), gm),
i AS (SELECT sum(list_distance(vec, c) ^ 2) AS w FROM w JOIN c USING (label)) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, i"""
)
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calinski_harabasz(_v(spark, d), _labels(spark, d, 0)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


RUNS = "WITH a AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 1 THEN -1 ELSE label END AS l1 FROM embeddings), b AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 2 THEN -1 WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l2 FROM embeddings), j AS (SELECT * FROM a JOIN b USING (id) {where}), n AS (SELECT l1, l2, count(*)::DOUBLE AS n FROM j GROUP BY l1, l2)"


def _second(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 10 == 2, -1).when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), label.cast("int").alias("label"))


def _ari_sql(where: str) -> str:
    return (
        RUNS.format(where=where)
        + """, s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM n), x AS (SELECT sum(m * (m - 1) / 2) AS a FROM (SELECT sum(n) AS m FROM n GROUP BY l1)), y AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM n GROUP BY l2)),
e AS (SELECT *, a * b / (t * (t - 1) / 2) AS e FROM s, x, y) SELECT CAST(t AS BIGINT) AS n_points, round((ij - e) / ((a + b) / 2 - e), 6) AS ari FROM e"""
    )


@query(_ari_sql(""))
def ari_two_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adjusted_rand(metrics.contingency(_labels(spark, d, 1), _second(spark, d))).select("n_points", F.round("ari", 6).alias("ari"))


@query(_ari_sql("WHERE l1 <> -1 AND l2 <> -1"))
def ari_without_noise(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adjusted_rand(metrics.contingency(_labels(spark, d, 1), _second(spark, d), "exclude_either")).select("n_points", F.round("ari", 6).alias("ari"))


@query(RUNS.format(where="") + ", t AS (SELECT sum(n) AS t FROM n), r AS (SELECT l1, sum(n) AS r FROM n GROUP BY l1), c AS (SELECT l2, sum(n) AS c FROM n GROUP BY l2), h1 AS (SELECT -sum(r / t * ln(r / t)) AS h FROM r, t), h2 AS (SELECT -sum(c / t * ln(c / t)) AS h FROM c, t), m AS (SELECT sum(n / t * ln(n * t / (r * c))) AS mi FROM n JOIN r USING (l1) JOIN c USING (l2), t) SELECT round(2 * mi / (h1.h + h2.h), 6) AS nmi FROM m, h1, h2")
def nmi_two_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mutual_information(metrics.contingency(_labels(spark, d, 1), _second(spark, d))).select(F.round("nmi", 6).alias("nmi"))


PART = RUNS.format(where="") + ", p AS (SELECT l1 AS topic, l2 AS counterpart, CAST(n AS BIGINT) AS n_shared, row_number() OVER (PARTITION BY l1 ORDER BY n DESC, l2) AS rk FROM n WHERE l1 <> -1)"


@query(PART + " SELECT topic, counterpart, n_shared FROM p WHERE rk = 1")
def topic_counterpart(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counterparts(metrics.contingency(_labels(spark, d, 1), _second(spark, d)))


@query(PART + " SELECT count(*) AS n_points, CAST(sum(coalesce(l2 = counterpart, false)::INT) AS BIGINT) AS agreeing, round(avg(coalesce(l2 = counterpart, false)::INT), 6) AS agreement FROM j LEFT JOIN (SELECT * FROM p WHERE rk = 1) q ON j.l1 = q.topic")
def counterpart_agreement(spark: SparkSession, d: str) -> DataFrame:
    first, second = _labels(spark, d, 1), _second(spark, d)
    parts = metrics.counterparts(metrics.contingency(first, second))
    return metrics.counterpart_agreement(first, second, parts).withColumn("agreement", F.round("agreement", 6))


@query(
    V
    + """, l AS (SELECT id, vec, CASE WHEN id % 10 = 3 THEN -1 ELSE label END AS label FROM v), f AS (SELECT label, unnest(range(1, len(vec) + 1)) AS pos, unnest(vec) AS x FROM l WHERE label <> -1),
m AS (SELECT label, pos, avg(x) AS x FROM f GROUP BY label, pos), c AS (SELECT label AS topic, list(x ORDER BY pos) AS centroid FROM m GROUP BY label),
r AS (SELECT id, topic, row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(vec, centroid), 9) DESC, topic) AS rk FROM l, c WHERE label = -1)
SELECT id AS vec_id, topic FROM r WHERE rk = 1"""
)
def noise_reassign(spark: SparkSession, d: str) -> DataFrame:
    v, labels = _v(spark, d), _labels(spark, d, 3)
    noise = v.join(labels.filter("label = -1"), "id").select("id", "vec")
    return search.assign(noise, search.centroids(v, labels)).select(F.col("id").alias("vec_id"), "topic")


def answer(spark: SparkSession, d: str, vector_id: int = 0) -> DataFrame:
    """Where a vector sits: nearest topic, outlier flag, saturation of the topic, and the closest vectors outside it."""
    v, labels = _v(spark, d), _labels(spark, d)
    cents = search.centroids(v, labels)
    one = v.filter(F.col("id") == vector_id)
    limit = search.atypical_threshold(search.member_similarities(v, labels, cents), 0.05)
    placed = search.assign(one, cents).join(search.saturation(_sizes(spark, d)), "topic", "left").crossJoin(F.broadcast(limit))
    similar = search.top_k(v, one, 5, exclude=vector_id).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id"))), lambda x: x["id"]).alias("ids"))
    diverse = search.mmr(v, one, 5, 0.7, 40, exclude=vector_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    told = placed.crossJoin(similar.withColumnRenamed("ids", "similar")).crossJoin(diverse.withColumnRenamed("ids", "antecedents"))
    return told.select(F.col("id").alias("vec_id"), "topic", F.round("sim", 6).alias("sim"), (F.col("sim") < F.col("threshold")).alias("atypical"), "quartile", F.concat_ws(",", "similar").alias("similar"), F.concat_ws(",", "antecedents").alias("antecedents"))


@query(
    _mmr_sql(5).replace(" SELECT CAST(1 AS BIGINT) AS rank", ", ant AS (SELECT CAST(1 AS BIGINT) AS rank", 1)
    + "), "
    + A.removeprefix(V + ", ")
    + """, t AS (SELECT quantile_cont(sim, 0.05) AS threshold FROM s WHERE label = topic), z AS (SELECT label AS topic, count(*) AS size FROM embeddings GROUP BY label), q AS (SELECT quantile_cont(size, 0.25) AS c1, quantile_cont(size, 0.5) AS c2, quantile_cont(size, 0.75) AS c3, count(DISTINCT size) AS k FROM z),
near AS (SELECT b.id, row_number() OVER (ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id) AS nth FROM v a, v b WHERE a.id = 0 AND b.id <> 0)
SELECT 0::BIGINT AS vec_id, r.topic, round(sim, 6) AS sim, sim < threshold AS atypical, CASE WHEN k >= 2 THEN CAST(1 + (size > c1)::INT + (size > c2)::INT + (size > c3)::INT AS BIGINT) END AS quartile, (SELECT string_agg(id, ',' ORDER BY nth) FROM near WHERE nth <= 5) AS similar, (SELECT string_agg(vec_id, ',' ORDER BY rank) FROM ant) AS antecedents FROM r, t, q, z WHERE r.id = 0 AND rk = 1 AND z.topic = r.topic"""
)
def proposal_answer(spark: SparkSession, d: str) -> DataFrame:
    return answer(spark, d)


@query(A + ", b AS (SELECT topic FROM r WHERE id = 0 AND rk = 1), n AS (SELECT topic, sim FROM r WHERE id = 0 AND rk > 1 ORDER BY rk LIMIT 3) SELECT (SELECT topic FROM b) AS assigned, topic AS neighbor, round(sim, 6) AS sim FROM n")
def alternative_lines(spark: SparkSession, d: str) -> DataFrame:
    """The topics next to a vector, after the one it is assigned to."""
    v, cents = _v(spark, d), _cents(spark, d)
    one = v.filter("id = 0")
    assigned = search.assign(one, cents).select(F.col("topic").alias("assigned"))
    sims = search.scores(cents.select(F.col("topic").alias("id"), F.col("centroid").alias("vec")), one)
    near = sims.crossJoin(F.broadcast(assigned)).filter("id <> assigned").orderBy(F.desc(F.round("score", 9)), "id").limit(3)
    return near.select("assigned", F.col("id").alias("neighbor"), F.round("score", 6).alias("sim"))


@query("WITH s AS (SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS topic, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY topic = -1, topic) AS BIGINT) AS line, CASE WHEN topic = -1 THEN 'Noise' ELSE 'Topic ' || topic END AS name, n, (2000 * n + sum(n) OVER ()) // (2 * sum(n) OVER ()) // 10 || '.' || (2000 * n + sum(n) OVER ()) // (2 * sum(n) OVER ()) % 10 || ' %' AS share FROM s")
def topic_table(spark: SparkSession, d: str) -> DataFrame:
    """Topics for display: noise last, with shares of all documents."""
    sizes = _labels(spark, d, 0).groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    name = F.when(F.col("topic") == -1, "Noise").otherwise(F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    line = F.row_number().over(W.orderBy(F.col("topic") == -1, "topic")).cast("long")
    tenths = F.expr("(2000 * n + total) div (2 * total)")
    return sizes.crossJoin(F.broadcast(total)).select(line.alias("line"), name.alias("name"), "n", F.format_string("%d.%d %%", F.floor(tenths / 10), tenths % 10).alias("share"))


@query(V + " SELECT CAST(row_number() OVER (ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.id) AS BIGINT) AS rank, b.id AS vec_id, b.label AS topic, round(list_cosine_similarity(a.vec, b.vec), 3) AS similarity FROM v a, v b WHERE a.id = 0 AND b.id <> 0 QUALIFY rank <= 8")
def similar_table(spark: SparkSession, d: str) -> DataFrame:
    """The most similar vectors with their topics, as a display table."""
    best = search.top_k(_v(spark, d), _one(spark, d), 8, exclude=0)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "id")).cast("long"))
    return ranked.join(_labels(spark, d), "id", "left").select("rank", F.col("id").alias("vec_id"), F.col("label").alias("topic"), F.round("score", 3).alias("similarity"))
