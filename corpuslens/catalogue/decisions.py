"""Sampling, agreement, thresholds, questionnaires, periods and guards. Quality and toxicity labels are two raters; text length is a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.catalogue.topic_map import C, _v
from corpuslens.operators import agreement as A
from corpuslens.operators import guards, sampling, search
from corpuslens.registry import query
from corpuslens.tables import table

PAIRS = "WITH s AS (SELECT d.doc_id, (n_chars // 100)::DOUBLE AS score, quality AS label FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = F.floor(F.col("n_chars") / 100).cast("double")
    return table(spark, d, "documents").select("doc_id", score.alias("score")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def _kappa_sql(weight: str) -> str:
    return f"""WITH n AS (SELECT quality + toxic AS a, CAST(doc_id % 3 AS INTEGER) AS b, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n), o AS (SELECT sum({weight} * n) AS o FROM n), r AS (SELECT a, sum(n) AS na FROM n GROUP BY a), c AS (SELECT b, sum(n) AS nb FROM n GROUP BY b), e AS (SELECT sum({weight} * na * nb) AS e FROM r, c)
SELECT CAST(t AS BIGINT) AS n, round(o / t, 6) AS observed, round(e / (t * t), 6) AS expected, round(1 - (o / t) / (e / (t * t)), 6) AS kappa FROM t, o, e"""


def _kappa(spark: SparkSession, d: str, weights: str) -> DataFrame:
    ratings = table(spark, d, "labels").select((F.col("quality") + F.col("toxic")).alias("a"), (F.col("doc_id") % 3).cast("int").alias("b"))
    return A.cohen(ratings, 3, weights).select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@query(_kappa_sql("(a <> b)::INT"))
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return _kappa(spark, d, "none")


@query(_kappa_sql("(abs(a - b) / 2.0::DOUBLE)"))
def cohen_kappa_linear(spark: SparkSession, d: str) -> DataFrame:
    return _kappa(spark, d, "linear")


@query(_kappa_sql("((a - b) * (a - b) / 4.0::DOUBLE)"))
def cohen_kappa_quadratic(spark: SparkSession, d: str) -> DataFrame:
    return _kappa(spark, d, "quadratic")


@query(
    "WITH r AS (SELECT doc_id AS item, unnest([quality, toxic, CAST(doc_id % 2 AS INTEGER)]) AS category FROM labels), p AS (SELECT item, category, count(*)::DOUBLE AS n FROM r GROUP BY ALL), i AS (SELECT item, sum(n * (n - 1)) / (3 * 2) AS p FROM p GROUP BY item), q AS (SELECT sum(n) / (SELECT sum(n) FROM p) AS q FROM p GROUP BY category), e AS (SELECT sum(q * q) AS pe FROM q) SELECT count(*) AS items, round(avg(p), 6) AS p, round(any_value(pe), 6) AS pe, round((avg(p) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM i, e"
)
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    raters = F.array(F.col("quality"), F.col("toxic"), (F.col("doc_id") % 2).cast("int"))
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("item"), F.posexplode(raters).alias("rater", "category"))
    return A.fleiss(rows).select("items", *(F.round(c, 6).alias(c) for c in ("p", "pe", "kappa")))


LEVELS = "WITH x AS (SELECT doc_id, [['low', 'mid', 'high'][1 + doc_id % 3], ['low', 'mid', 'high'][1 + (doc_id // 3) % 3], ['low', 'mid', 'high'][1 + quality + toxic]] AS v FROM labels)"


@query(LEVELS + " SELECT doc_id, v[1] = v[2] AS agreed, ['low', 'mid', 'high'][list_sort([list_position(['low', 'mid', 'high'], y) FOR y IN v])[2]] AS final_level FROM x")
def consensus_levels(spark: SparkSession, d: str) -> DataFrame:
    scale = ["low", "mid", "high"]
    pick = lambda k: F.element_at(F.array(*(F.lit(s) for s in scale)), (1 + k).cast("int"))
    first, second, third = pick(F.col("doc_id") % 3), pick(F.floor(F.col("doc_id") / 3) % 3), pick(F.col("quality") + F.col("toxic"))
    return table(spark, d, "labels").select("doc_id", (first == second).alias("agreed"), A.final_level([first, second, third], scale).alias("final_level"))


CURVE = PAIRS + ", g AS (SELECT score AS tau, sum(label) AS pos, count(*) AS n FROM s GROUP BY score), c AS (SELECT tau, sum(pos) OVER w AS tp, sum(n) OVER w - sum(pos) OVER w AS fp, sum(pos) OVER () - sum(pos) OVER w AS fn, sum(n) OVER () - sum(pos) OVER () - (sum(n) OVER w - sum(pos) OVER w) AS tn FROM g WINDOW w AS (ORDER BY tau DESC ROWS UNBOUNDED PRECEDING)), f AS (SELECT tau, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c)"
R6 = ("precision", "recall", "f1")


@query(CURVE + " SELECT * FROM f")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return A.pr_curve(_scored(spark, d)).withColumns({c: F.round(c, 6) for c in R6})


@query(CURVE + " SELECT * FROM f ORDER BY f1 DESC, tau DESC LIMIT 1")
def max_f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return A.best_point(A.pr_curve(_scored(spark, d))).withColumns({c: F.round(c, 6) for c in R6})


@query(PAIRS + " SELECT count(*) FILTER (score >= 20 AND label = 1) AS tp, count(*) FILTER (score >= 20 AND label = 0) AS fp, count(*) FILTER (score < 20 AND label = 1) AS fn, count(*) FILTER (score < 20 AND label = 0) AS tn FROM s")
def confusion_at(spark: SparkSession, d: str) -> DataFrame:
    return A.confusion(_scored(spark, d), F.lit(20.0)).select("tp", "fp", "fn", "tn")


CV = (
    PAIRS
    + """, h AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY sha256('cv:' || doc_id), doc_id) - 1) % 5 AS fold FROM s), k AS (SELECT unnest(range(5)) AS fold), t AS (SELECT k.fold, score, label FROM h JOIN k ON h.fold <> k.fold),
g AS (SELECT fold, score AS tau, sum(label) AS pos, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT fold, tau, sum(pos) OVER w AS tp, sum(n) OVER w AS pr, sum(pos) OVER (PARTITION BY fold) AS p FROM g WINDOW w AS (PARTITION BY fold ORDER BY tau DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT fold, tau, row_number() OVER (PARTITION BY fold ORDER BY round(2 * tp / (pr + p), 12) DESC, tau DESC) AS rk FROM c), x AS (SELECT h.fold, tau, count(*) FILTER (score >= tau AND label = 1) AS tp, count(*) FILTER (score >= tau AND label = 0) AS fp, count(*) FILTER (score < tau AND label = 1) AS fn FROM h JOIN b ON h.fold = b.fold AND rk = 1 GROUP BY ALL)"""
)


@query(CV + " SELECT fold, tau, tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM x")
def cv_threshold(spark: SparkSession, d: str) -> DataFrame:
    held, _ = A.cross_validated(A.with_folds(_scored(spark, d), "doc_id", "cv", 5), 5)
    return held.select("fold", "tau", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query(CV + " SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM x")
def cv_pooled_f1(spark: SparkSession, d: str) -> DataFrame:
    _, pooled = A.cross_validated(A.with_folds(_scored(spark, d), "doc_id", "cv", 5), 5)
    return pooled.select("tp", "fp", "fn", F.round("f1", 6).alias("f1"))


POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


@query(
    PAIRS.replace("quality AS label", "quality AS label, (n_chars // 100)::DOUBLE + d.doc_id % 7 AS other")
    + ", r AS (SELECT unnest(range(500)) AS resample), u AS (SELECT resample, score, other, label, ('0x' || substr(md5('42:' || resample || ':' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM s, r), w AS (SELECT *, "
    + " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in POISSON)
    + " AS w FROM u), f AS (SELECT resample, 2 * sum(w) FILTER (score >= 5 AND label = 1) / nullif(2 * sum(w) FILTER (score >= 5 AND label = 1) + sum(w) FILTER ((score >= 5) <> (label = 1)), 0) AS score, 2 * sum(w) FILTER (other >= 9 AND label = 1) / nullif(2 * sum(w) FILTER (other >= 9 AND label = 1) + sum(w) FILTER ((other >= 9) <> (label = 1)), 0) AS other FROM w GROUP BY resample), "
    "m AS (SELECT 'score' AS measure, score AS v FROM f UNION ALL SELECT 'other', other FROM f UNION ALL SELECT 'difference', score - other FROM f), q AS (SELECT measure, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, count(*) FILTER (v IS NULL) AS undefined FROM m GROUP BY measure) SELECT measure, round(low, 6) AS low, round(high, 6) AS high, undefined, CASE WHEN measure = 'difference' THEN low <= 0 AND high >= 0 END AS tie FROM q"
)
def bootstrap_f1(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of two scores' F1 and of their difference."""
    rows = _scored(spark, d).withColumn("other", F.col("score") + F.col("doc_id") % 7)
    got = A.bootstrap(rows, "doc_id", {"score": 5.0, "other": 9.0}, 500, 42)
    return got.select("measure", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "undefined", "tie")


ANS = "WITH a AS (SELECT user_id, event_type AS item, 1 + event_id % 5 AS value FROM events)"


@query(ANS + ", v AS (SELECT item, CASE WHEN item IN ('error') THEN 6 - value ELSE value END AS v FROM a) SELECT item, count(v) AS n, count(*) FILTER (v = 1) AS n1, count(*) FILTER (v = 2) AS n2, count(*) FILTER (v = 3) AS n3, count(*) FILTER (v = 4) AS n4, count(*) FILTER (v = 5) AS n5, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY item")
def likert_summary(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "events").select("user_id", F.col("event_type").alias("item"), (1 + F.col("event_id") % 5).alias("value"))
    return A.likert(answers, ["error"], 1, 5)


WIDE = "WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, avg(value) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id)"


@query(WIDE + " SELECT count(*) AS n, round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 6) AS alpha FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def cronbach_alpha(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda kind, name: F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(name)
    wide = table(spark, d, "events").groupBy("user_id").agg(mean("click", "a"), mean("view", "b"), mean("purchase", "c"))
    return A.cronbach(wide, ["a", "b", "c"]).select("n", F.round("alpha", 6).alias("alpha"))


W = "(2 * {n} * {p} + z * z {s} z * sqrt(z * z + 4 * {n} * {p} * (1 - {p}))) / (2 * ({n} + z * z))"


@query("WITH k AS (SELECT 1.959963984540054::DOUBLE AS z), p AS (SELECT event_type AS item, count(*) AS n, sum(event_id % 4)::DOUBLE / (count(*) * 3) AS v, count(*) * 3.0::DOUBLE AS m FROM events GROUP BY 1) SELECT item, n, round(v, 6) AS v, round(" + W.format(n="m", p="v", s="-") + ", 6) AS low, round(" + W.format(n="m", p="v", s="+") + ", 6) AS high FROM p, k")
def aiken_v(spark: SparkSession, d: str) -> DataFrame:
    ratings = table(spark, d, "events").select(F.col("event_type").alias("item"), (1 + F.col("event_id") % 4).alias("rating"))
    return A.aiken(ratings, 1, 4).withColumns({c: F.round(c, 6) for c in ("v", "low", "high")})


@query("WITH k AS (SELECT 1.959963984540054::DOUBLE AS z), p AS (SELECT lang, count(*) AS n, avg(quality)::DOUBLE AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, n, round(accuracy, 6) AS accuracy, round(" + W.format(n="n", p="accuracy", s="-") + ", 6) AS low, round(" + W.format(n="n", p="accuracy", s="+") + ", 6) AS high FROM p, k")
def accuracy_interval(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("accuracy"))
    return per.select("lang", "n", F.round("accuracy", 6).alias("accuracy"), *(F.round(c, 6).alias(n) for c, n in zip(A.wilson(F.col("accuracy"), F.col("n")), ("low", "high"), strict=True)))


def _alloc_sql(total: int, floor: int) -> str:
    return f"""WITH s AS (SELECT lang AS stratum, count(*) AS size FROM documents GROUP BY lang), b AS (SELECT *, least({floor}, size) AS base, size - least({floor}, size) AS rest FROM s), o AS (SELECT *, least({total}, sum(size) OVER ()) - sum(base) OVER () AS open, sum(rest) OVER () AS allrest FROM b),
p AS (SELECT *, rest * open // allrest AS whole, rest * open % allrest AS over FROM o), q AS (SELECT *, open - sum(whole) OVER () AS missing, row_number() OVER (ORDER BY over DESC, stratum) AS nth FROM p), quota AS (SELECT stratum, size, CAST(base + whole + (nth <= missing)::INT AS BIGINT) AS quota FROM q)"""


def _strata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("stratum"), "doc_id")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d).groupBy("stratum").agg(F.count("*").alias("size"))


@query(_alloc_sql(47, 0) + " SELECT * FROM quota")
def allocate_quota(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocate(_sizes(spark, d), 47)


@query(_alloc_sql(60, 10) + " SELECT * FROM quota")
def allocate_with_floor(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocate(_sizes(spark, d), 60, 10)


@query(_alloc_sql(47, 0) + ", r AS (SELECT lang AS stratum, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('draw:' || lang || ':' || doc_id), doc_id) AS draw_order FROM documents) SELECT stratum, doc_id, draw_order FROM r JOIN quota USING (stratum) WHERE draw_order <= quota")
def stratified_draw(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(_strata(spark, d), sampling.allocate(_sizes(spark, d), 47), "doc_id", "draw")


@query(_alloc_sql(47, 0) + " SELECT stratum, size AS candidates, quota, least(size, quota) AS drawn FROM quota")
def sample_composition(spark: SparkSession, d: str) -> DataFrame:
    rows, quotas = _strata(spark, d), sampling.allocate(_sizes(spark, d), 47)
    return sampling.composition(rows, sampling.draw(rows, quotas, "doc_id", "draw"), quotas, "doc_id")


@query("SELECT item_id, CAST(1 + (row_number() OVER (ORDER BY item_id % 3, sha256('deal:' || (item_id % 3) || ':' || item_id), item_id) - 1) % 4 AS BIGINT) AS dealt FROM benchmark")
def annotator_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).alias("pool"))
    return sampling.round_robin(rows, "pool", "item_id", 4, "deal").select("item_id", "dealt")


@query("WITH a AS (SELECT doc_id, 'long' AS pool FROM documents WHERE n_chars > 5000 ORDER BY sha256('s:long:' || doc_id), doc_id LIMIT 10), b AS (SELECT doc_id, 'german' AS pool FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY sha256('s:german:' || doc_id), doc_id LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b")
def sequential_pools(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sampling.disjoint([("long", docs.filter("n_chars > 5000"), 10), ("german", docs.filter("lang = 'de'"), 10)], "doc_id", "s")


EARLY = C.replace("FROM v WHERE label <> -1", "FROM v WHERE id % 5 <> 4")


@query(EARLY + ", m AS (SELECT quantile_cont(list_cosine_similarity(vec, centroid), 0.05) AS thr FROM v JOIN c ON label = topic WHERE id % 5 <> 4), r AS (SELECT id, topic, list_cosine_similarity(vec, centroid) AS s, row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(vec, centroid), 9) DESC, topic) AS rk FROM v, c WHERE id % 5 = 4) SELECT id AS vec_id, topic, round(s, 6) AS sim, round(s, 9) < round(thr, 9) AS atypical FROM r, m WHERE rk = 1".replace(", m AS", ", mm AS").replace("FROM r, m ", "FROM r, mm "))
def temporal_assign(spark: SparkSession, d: str) -> DataFrame:
    """A map of the early period, to which the late period is assigned."""
    v = _v(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    early, late = v.filter("id % 5 <> 4"), v.filter("id % 5 = 4")
    cents = search.centroids(early, labels)
    limit = search.atypical_threshold(search.member_similarities(early, labels, cents), 0.05)
    return search.assign(late, cents).crossJoin(F.broadcast(limit)).select(F.col("id").alias("vec_id"), "topic", F.round("sim", 6).alias("sim"), (F.round("sim", 9) < F.round("threshold", 9)).alias("atypical"))


@query("SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS period, count(*) AS n, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000 GROUP BY 1")
def period_split(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate")
    rows = table(spark, d, "orders").select(year.alias("y")).filter("y between 1995 and 2000")
    return rows.groupBy(F.when(F.col("y") < 1998, "early").otherwise("late").alias("period")).agg(F.count("*").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))


NEEDLE = r"WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS needle FROM benchmark), h AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS hay FROM documents)"


@query(NEEDLE + " SELECT doc_id, md5(needle) AS needle_md5 FROM h, n WHERE contains(hay, needle)")
def leak_search(spark: SparkSession, d: str) -> DataFrame:
    needles = table(spark, d, "benchmark").select(guards.folded(F.col("text")).alias("needle")).distinct()
    return guards.leaks(table(spark, d, "documents"), "doc_id", "text", needles).select(F.col("id").alias("doc_id"), F.md5("needle").alias("needle_md5"))


@query("SELECT 'length matches' AS rule, count(*) FILTER (n_chars <> length(text)) AS broken FROM documents UNION ALL SELECT 'known language', count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) FROM documents")
def rule_check(spark: SparkSession, d: str) -> DataFrame:
    return guards.check(table(spark, d, "documents"), {"length matches": F.col("n_chars") == F.length("text"), "known language": F.col("lang").isin("en", "fr", "de")})
