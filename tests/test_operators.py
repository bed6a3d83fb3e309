"""Hand-checked values of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from corpuslens.operators import agreement, gaps, guards, learn, metrics, profile, sampling, search, terms
from corpuslens.plans import selection
from corpuslens.sources import rest, strict
from corpuslens.streaming import assign as streams


def one(df):
    return df.first().asDict()


def plane(spark):
    return spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 4.0]), (2, [0.6, -0.8]), (3, [0.0, 2.0]), (4, [-1.0, 0.0])], "id bigint, vec array<double>")


def test_top_k_with_a_tie(spark):
    q = spark.createDataFrame([([1.0, 0.0],)], "vec array<double>")
    got = [(r.id, round(r.score, 9)) for r in search.top_k(plane(spark), q, 9).collect()]
    assert got == [(0, 1.0), (1, 0.6), (2, 0.6), (3, 0.0), (4, -1.0)]
    assert [r.id for r in search.top_k(plane(spark), q, 2, exclude=0).collect()] == [1, 2]


def test_pairs(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "a bigint, b bigint")
    assert {(r.a, r.b): round(r.score, 9) for r in search.pair_cosines(plane(spark), pairs).collect()} == {(0, 1): 0.6, (1, 2): -0.28}
    with pytest.raises(Exception, match="itself"):
        search.pair_cosines(plane(spark), spark.createDataFrame([(1, 1)], "a bigint, b bigint")).collect()
    for blocks in (1, 3):
        assert sorted((r.a, r.b) for r in search.all_pairs(plane(spark), blocks).collect()) == [(a, b) for a in range(5) for b in range(a + 1, 5)]


def test_assignment_ties_and_one_topic(spark):
    cents = spark.createDataFrame([(7, [0.0, 1.0]), (3, [1.0, 0.0])], "topic int, centroid array<double>")
    rows = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 5.0])], "id bigint, vec array<double>")
    got = {r.id: (r.topic, round(r.margin, 9)) for r in search.assign(rows, cents).collect()}
    assert got == {1: (3, 0.0), 2: (7, 1.0)}
    assert one(search.assign(rows.filter("id = 1"), cents.filter("topic = 7")))["margin"] is None


def test_blocks_give_what_a_broadcast_gives(spark):
    cents = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(7)], "topic int, centroid array<double>")
    wide = search.against_all(plane(spark), cents, limit=2).select("id", "topic").collect()
    assert sorted(map(tuple, wide)) == [(i, k) for i in range(5) for k in range(7)]


def test_saturation(spark):
    sizes = spark.createDataFrame([(k, 2 * k) for k in range(1, 9)], "topic int, size bigint")
    assert [r.quartile for r in search.saturation(sizes).orderBy("topic").collect()] == [1, 1, 2, 2, 3, 3, 4, 4]
    equal = search.saturation(sizes.withColumn("size", F.lit(5)))
    assert {(r.quartile, r.undefined_reason) for r in equal.collect()} == {(None, "equal_sizes")}


def test_npmi_values(spark):
    cases = [(0, 2, 3, 10, -1.0), (10, 10, 10, 10, 1.0), (3, 3, 3, 10, 1.0), (2, 4, 5, 10, 0.0), (2, 3, 2, 4, math.log(4 / 3) / math.log(2))]
    frame = spark.createDataFrame([c[:4] for c in cases], "j int, a int, b int, u int").withColumn("n", F.monotonically_increasing_id())
    got = [r.v for r in frame.select("n", metrics.npmi(*(F.col(c) for c in "jabu")).alias("v")).orderBy("n").collect()]
    assert got == pytest.approx([c[4] for c in cases], abs=1e-12)


def test_coherence(spark):
    presence = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "d")], "unit int, term string")
    wanted = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "d"), (2, 1, "a"), (2, 2, "zz")], "topic int, rank int, term string")
    got = {r.topic: (r.npmi, r.undefined_reason) for r in metrics.coherence(metrics.coherence_pairs(presence, spark.createDataFrame([(4,)], "n bigint"), wanted)).collect()}
    assert got[0][0] == pytest.approx(math.log(4 / 3) / math.log(2)) and got[1] == (-1.0, None) and got[2] == (None, "absent_terms")


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, label int")


def test_rand_and_information(spark):
    same = metrics.contingency(labels(spark, [0, 0, 1, 1]), labels(spark, [1, 1, 0, 0]))
    assert one(metrics.adjusted_rand(same)) == {"n_points": 4, "ari": 1.0} and one(metrics.mutual_information(same))["nmi"] == pytest.approx(1)
    trivial = metrics.contingency(labels(spark, [0, 0]), labels(spark, [3, 3]))
    assert one(metrics.adjusted_rand(trivial))["ari"] == 1.0 and one(metrics.mutual_information(trivial))["nmi"] == 1.0
    noisy = metrics.contingency(labels(spark, [-1, 0, 1]), labels(spark, [0, 0, -1]), "exclude_either")
    assert one(metrics.adjusted_rand(noisy))["n_points"] == 1


def test_internal_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    y = [i % 3 if i % 7 else -1 for i in range(40)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    keep = [i for i in range(40) if y[i] >= 0]
    u, z = x[keep] / np.linalg.norm(x[keep], axis=1, keepdims=True), np.array([y[i] for i in keep])
    far = 1 - u @ u.T
    sil = []
    for i in range(len(z)):
        a = far[i][(z == z[i]) & (np.arange(len(z)) != i)].mean()
        b = min(far[i][z == k].mean() for k in set(z) - {z[i]})
        sil.append((b - a) / max(a, b))
    assert one(metrics.silhouette(rows, labels(spark, y)))["silhouette"] == pytest.approx(np.mean(sil))
    c = np.stack([u[z == k].mean(axis=0) for k in range(3)])
    s = [np.linalg.norm(u[z == k] - c[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert one(metrics.davies_bouldin(rows, labels(spark, y)))["davies_bouldin"] == pytest.approx(db)
    between = sum((z == k).sum() * np.sum((c[k] - u.mean(axis=0)) ** 2) for k in range(3)) / 2
    within = sum(np.sum((u[z == k] - c[k]) ** 2) for k in range(3)) / (len(z) - 3)
    assert one(metrics.calinski_harabasz(rows, labels(spark, y)))["calinski_harabasz"] == pytest.approx(between / within)
    assert one(metrics.silhouette(rows, labels(spark, [0] * 40)))["undefined_reason"] == "one_cluster"


def test_bridges_on_a_circle(spark):
    turn = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    cents = spark.createDataFrame([(0, turn(0)), (1, turn(30)), (2, turn(90)), (3, turn(120))], "topic int, centroid array<double>")
    rows = spark.createDataFrame([(0, turn(14)), (1, turn(16)), (2, turn(105)), (3, turn(1)), (4, turn(29)), (5, turn(91))], "id bigint, vec array<double>")
    assert {(r.t, r.u): r.bridge_docs for r in gaps.bridges(rows, cents).collect()} == {(0, 1): 2, (2, 3): 1}
    assert sorted((r.t, r.u) for r in gaps.interstitial(rows, cents, 3, 1).collect()) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_size_cut_and_floor(spark):
    sizes = spark.createDataFrame([(0, k, s) for k, s in enumerate([16, 2, 14, 4, 12, 6, 10, 8])], "run int, topic int, size bigint")
    npmi = spark.createDataFrame([(0, 0, 0.4), (0, 1, None), (0, 2, 0.1), (1, 0, 0.3), (1, 1, 0.2)], "run int, topic int, npmi double")
    assert one(gaps.small_topic_cuts(sizes, npmi, 0.25)) == {"size_cut": 5.5, "npmi_floor": pytest.approx(0.175)}


def test_decline(spark):
    lab = spark.createDataFrame([(0, i, 0 if i < 10 or 100 <= i < 102 else 1) for i in range(200)], "run int, id bigint, label int")
    meta = spark.createDataFrame([(i, 0, 2000 + i // 100) for i in range(200)], "id bigint, program int, year int")
    got = one(gaps.declines(lab, meta, 2001, 3, 0.02))
    assert (got["topic"], round(got["early_share"], 9), round(got["late_share"], 9)) == (0, 0.1, 0.02)


def test_pr_curve_and_threshold(spark):
    scored = spark.createDataFrame(list(zip([0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [1, 1, 0, 1, 0, 0], strict=True)), "score double, label int")
    curve = agreement.pr_curve(scored)
    assert [r.f1 for r in curve.orderBy(F.desc("tau")).collect()] == pytest.approx([2 / 4, 4 / 5, 4 / 6, 6 / 7, 6 / 8, 6 / 9])
    best = one(agreement.best_point(curve))
    assert (best["tau"], best["tp"], best["fp"], best["fn"], best["tn"]) == (0.6, 3, 1, 0, 2)
    tied = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 1)], "score double, label int").unionAll(spark.createDataFrame([(0.3, 0)], "score double, label int"))
    assert one(agreement.best_point(agreement.pr_curve(tied)))["f1"] == pytest.approx(0.8)
    assert one(agreement.confusion(scored, F.lit(2.0)))["precision"] is None


def test_kappas(spark):
    r = spark.createDataFrame([(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15, "a int, b int")
    assert one(agreement.cohen(r, 2))["kappa"] == pytest.approx(0.4)
    same = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert one(agreement.cohen(same, 2))["undefined_reason"] == "chance_agreement_is_one"
    table = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    rows = [(i, n, c) for i, row in enumerate(table) for c, k in enumerate(row) for n in range(k)]
    assert one(agreement.fleiss(spark.createDataFrame(rows, "item int, rater int, category int")))["kappa"] == pytest.approx(0.20993, abs=1e-4)


def test_bootstrap_brackets_the_value(spark):
    rows = spark.createDataFrame([(i, float(i % 10), int(i % 10 >= 4) if i % 7 else 1 - int(i % 10 >= 4)) for i in range(300)], "id bigint, score double, label int")
    got = {r.measure: r for r in agreement.bootstrap(rows.withColumn("other", F.col("score")), "id", {"score": 4.0, "other": 4.0}, 200, 1).collect()}
    f1 = one(agreement.confusion(rows, F.lit(4.0)))["f1"]
    assert got["score"].low < f1 < got["score"].high and (got["difference"].low, got["difference"].high, got["difference"].tie) == (0.0, 0.0, True)


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 19), ("d", 1)], "stratum string, size bigint")
    quota = lambda total, floor=0: {r.stratum: r.quota for r in sampling.allocate(sizes, total, floor).collect()}
    assert quota(10) == {"a": 5, "b": 3, "c": 2, "d": 0}
    assert quota(1000) == {"a": 50, "b": 30, "c": 19, "d": 1}
    assert quota(10, 2) == {"a": 4, "b": 3, "c": 2, "d": 1} and sum(quota(10, 2).values()) == 10


def test_average_rank(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, 5.0)], "id int, s double")
    got = {r.id: r.percentile_rank for r in profile.average_rank(rows, "s", ["id"]).collect()}
    assert got == {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0}


def test_tfidf_by_hand(spark):
    sections = spark.createDataFrame([(0, 0, ["a", "a", "b"]), (1, 0, ["a", "c"]), (2, 0, ["z"]), (2, 1, [])], "doc int, section int, tokens array<string>")
    o = terms.ngrams(sections)
    vocab = terms.vocabulary(o, sections, 2)
    assert [(r.term, r.df, round(r.idf, 9)) for r in vocab.collect()] == [("a", 2, round(math.log(4 / 3) + 1, 9))]
    weights = terms.tfidf(o, vocab, ["doc"])
    assert {(r.doc, r.term): r.weight for r in weights.collect()} == {(0, "a"): 1.0, (1, "a"): 1.0}
    assert [r.doc for r in terms.zero_rows(sections, weights).collect()] == [2]


def test_selection_rules():
    a, b = selection.Candidate("a", {"sil": 0.5, "ari": 0.7, "noise": 0.1}, {"sil": 0.1}), selection.Candidate("b", {"sil": 0.35, "ari": 0.7, "noise": 0.3}, {"sil": 0.05})
    check = lambda c: selection.gates(c, 0.3, 0.65, ["sil"])
    assert selection.decide(a, b, check, [("sil", True)], "b").winner == "a"
    assert selection.decide(a, selection.Candidate("c", {"sil": 0.41, "ari": 0.7}), check, [("sil", True)], "c") == selection.Decision("c", "fallback", ("sil doesn't tell them apart",))
    low = selection.Candidate("low", {"sil": None, "ari": 0.1})
    assert selection.decide(a, low, check, [], "low").step == "gates" and selection.decide(low, low, check, [], "low").winner is None
    assert selection.matched_k(18.5) == 19


def test_seed_summary_is_undefined_with_a_seed(spark):
    runs = spark.createDataFrame([("x", 1, 0.5), ("x", 2, None), ("y", 1, 1.0), ("y", 2, 3.0)], "c string, seed int, m double")
    got = {r.c: (r.m_mean, r.m_sd) for r in selection.seed_summary(runs, ["c"], ["m"]).collect()}
    assert got["x"] == (None, None) and got["y"] == (2.0, pytest.approx(math.sqrt(2)))


def test_medoid(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 3, 0.8)], "run_a int, run_b int, ari double")
    assert one(selection.medoid(pairs))["run"] == 2


def test_density_labels():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), rng.uniform(-20, 20, (5, 2)) + 40])
    got = learn.density_labels(x, 8)
    assert len(set(got[:30])) == 1 and len(set(got[30:60])) == 1 and got[0] != got[30] and (got[60:] == -1).all()
    assert (learn.density_labels(x[:3], 8) == -1).all()


SCHEMA = StructType([StructField("id", LongType(), False), StructField("name", StringType()), StructField("x", DoubleType())])


def test_strict_tables(spark, tmp_path):
    home = f"{tmp_path}/run"
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "id bigint, name string, x double")
    strict.publish(spark, home, {"t": df}, {"seed": 7})
    assert strict.read_verified(spark, home, "t", SCHEMA).count() == 2 and strict.manifest(spark, home)["facts"] == {"seed": 7}
    with pytest.raises(FileExistsError):
        strict.publish(spark, home, {"t": df}, {})
    df.limit(1).write.mode("overwrite").parquet(f"{home}/{strict.manifest(spark, home)['folder']}/t.parquet")
    with pytest.raises(ValueError, match="differs"):
        strict.read_verified(spark, home, "t")
    df.withColumn("extra", F.lit(1)).drop("x").write.parquet(f"{tmp_path}/u")
    with pytest.raises(ValueError, match="missing x, unexpected extra"):
        strict.read_strict(spark, f"{tmp_path}/u", SCHEMA)
    spark.createDataFrame([(None, "a", 0.5)], "id bigint, name string, x double").write.parquet(f"{tmp_path}/v")
    with pytest.raises(ValueError, match="id is set"):
        strict.read_strict(spark, f"{tmp_path}/v", SCHEMA)


def test_snapshots(spark, tmp_path):
    rows = [("u1", "h", "p", "c", "2024", {"dc.title": [("T", None, None, -1, 0)], "person.dni": [("1", None, None, -1, 0)]})]
    strict.write_snapshot(spark.createDataFrame(rows, strict.RECORD), f"{tmp_path}/s")
    assert list(strict.read_snapshot(spark, f"{tmp_path}/s").first().metadata) == ["dc.title"]
    spark.createDataFrame(rows * 2, strict.RECORD).write.json(f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="repeated"):
        strict.read_snapshot(spark, f"{tmp_path}/twice")


def test_cache_and_resume(spark):
    rows = spark.createDataFrame([("m", "t1"), ("m", "t2"), ("m", "t1")], "model string, text string").withColumn("cache_key", strict.cache_key(F.col("model"), F.col("text")))
    cache = rows.filter("text = 't2'")
    assert [r.text for r in strict.not_cached(rows, cache).collect()] == ["t1"]
    assert strict.pending(rows, cache, ["model", "text"]).count() == 2


def test_affinity_is_complete(spark):
    pairs = spark.createDataFrame([("a", "b", 2), ("a", "c", 0), ("b", "c", 1)], "source string, target string, score int")
    assert strict.symmetric(pairs, ["a", "b", "c"]).count() == 6
    with pytest.raises(ValueError):
        strict.symmetric(pairs.limit(2), ["a", "b", "c"])


def test_rest_listing():
    import json
    import urllib.error

    calls = []

    def fetch(url):
        calls.append(url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        page = int(url[-1])
        return json.dumps({"total": 3, "items": [{"uuid": f"{page}{k}"} for k in range(2 if page == 0 else 1)]}).encode()

    assert [(c, p) for c, p, _ in rest.listing(fetch, "{collection}?p={page}", "x")] == [("x", 0), ("x", 0), ("x", 1)]
    with pytest.raises(ValueError, match="repeated"):
        list(rest.listing(lambda u: json.dumps({"total": 4, "items": [{"uuid": "1"}, {"uuid": "1"}]}).encode(), "{page}", "x"))
    with pytest.raises(urllib.error.HTTPError):
        rest.patient(lambda u: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "no", {}, None)), "u", 3)


def test_guards(spark):
    df = spark.createDataFrame([(1, "A  Secret\nname here"), (2, "nothing")], "id bigint, t string")
    needles = spark.createDataFrame([("secret name",), ("other",)], "needle string")
    assert [tuple(r) for r in guards.leaks(df, "id", "t", needles).collect()] == [(1, "secret name")]
    with pytest.raises(ValueError, match="positive"):
        guards.require(df, {"positive": F.col("id") > 1})
    many = spark.createDataFrame([(f"needle number {i} of a long row",) for i in range(2100)] + [("nothing",)], "needle string")
    hay = spark.createDataFrame([(1, "x needle number 77 of a long row y"), (2, "nothing"), (3, "needle number 78 of a")], "id bigint, t string")
    assert sorted(map(tuple, guards.leaks(hay, "id", "t", many).collect())) == [(1, "needle number 77 of a long row"), (2, "nothing")]


def test_streams(spark, tmp_path):
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "topic int, centroid array<double>")
    spark.createDataFrame([(1, [2.0, 1.0]), (2, [1.0, 3.0])], "id bigint, vec array<double>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, vec array<double>").parquet(f"{tmp_path}/in")
    streams.assign_stream(stream, cents, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {r.id: r.topic for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: 0, 2: 1}
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:07:00', 'a'").write.parquet(f"{tmp_path}/ev")
    events = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/ev")
    q = streams.window_counts(events, "ts", "k", "5 minutes", "1 minute").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("SELECT n FROM w").collect()) == [1, 1]


def test_distant_with_many_topics_and_a_repeated_id(spark):
    """An id that repeats has the mean over its rows; a row without a vector has none."""
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(1200, 16)), rng.normal(size=(1000, 16))
    ids = [*range(1199), 0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, None)], "id bigint, vec array<double>")
    cents = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "topic int, centroid array<double>")
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    mean = 1 - cos.mean(axis=1)
    per = np.array([(mean[0] + mean[-1]) / 2, *mean[1:-1]])
    got = gaps.distant(rows, cents).collect()
    assert {r.id for r in got} == set(np.flatnonzero(per > np.quantile(per, 0.75)).tolist()) and len(got) == 300
    assert all(abs(r["mean"] - per[r.id]) < 1e-9 for r in got)
