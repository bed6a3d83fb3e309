"""Plans of a study on small made-up inputs."""

import hashlib
import json
from collections import Counter, defaultdict
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import agreement, bands, comparison, corpus, guards, learn, pairs, running
from corpuslens.operators.comparison import Difference
from corpuslens.plans import commands, experiment, expert, gap_run, query_index, stage_two, temporal
from corpuslens.plans.selection import Candidate, gates
from corpuslens.queries import ORACLES, QUERIES
from corpuslens.sources import bundles, config, sheets, strict, topic_lists


def clouds(spark, n=40, seed=0, spread=0.15):
    """Three clouds of vectors around axes, in order of the ids."""
    rng = np.random.default_rng(seed)
    rows = [(i, (np.eye(4)[i % 3] + rng.normal(0, spread, 4)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>"), rows


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    frame = spark.createDataFrame([(int(v), int(v) % 7, float(v) ** 1.5) for v in values], "v int, m int, x double")
    got = {r.v: r.s for r in running.running(frame, "v", {"s": "m"}, n=9).collect()}
    assert got == {v: sum(k % 7 for k in range(v + 1)) for v in range(500)}
    down = {r.v: r.s for r in running.running(frame, "v", {"s": "m"}, descending=True, n=9).collect()}
    assert down[499] == 499 % 7 and down[0] == sum(k % 7 for k in range(500))
    for share in (0, 0.05, 0.5, 0.9973, 1):
        assert abs(running.quantile(frame, "x", share, "q").first()["q"] - np.quantile(values.astype(float) ** 1.5, share)) < 1e-9
    assert running.quantile(frame.filter("v < 0"), "x", 0.5, "q").first()["q"] is None
    assert sorted(r.v for r in running.best(frame, "m", "v", 80).collect()) == sorted(sorted(range(500), key=lambda v: (-(v % 7), v))[:80])
    assert running.best(frame, "m", "v", 0).count() == 0 and running.best(frame, "m", "v", 900).count() == 500
    dealt = running.numbered(frame, "m", F.sha2(F.col("v").cast("string"), 256), "v", "place", 5).collect()
    want = sorted(range(500), key=lambda v: (v % 7, hashlib.sha256(str(v).encode()).hexdigest(), v))
    assert [r.v for r in sorted(dealt, key=lambda r: r.place)] == want


def test_density_of_the_whole_table(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (3, 3, 0), (0, 4, 4))] + [rng.uniform(-2, 6, (15, 3))])
    rows = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    want = learn.density_labels(x, 8)
    got = {r.id: r.label for r in learn.density(rows, 8, block=64).collect()}
    assert [got[3 * i] for i in range(len(x))] == want.tolist() and len(set(want)) == 4
    assert {r.label for r in learn.density(rows.limit(5), 8).collect()} == {-1}


def test_neighbour_graph_keeps_clouds_apart(spark):
    rows, _ = clouds(spark, 90)
    got = learn.neighbour_graph(rows, 2, neighbours=8, block=32).collect()
    at = np.array([r.vec for r in sorted(got, key=lambda r: r.id)])
    middle = np.array([at[k::3].mean(axis=0) for k in range(3)])
    nearest = ((at[:, None] - middle) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == np.arange(90) % 3).mean() > 0.97


def test_sparse_baseline(spark):
    cells = [(d, f"{d % 2}-{t}", 0.5) for d in range(20) for t in range(4)]
    got = experiment.baseline(spark.createDataFrame(cells, "doc bigint, term string, weight double"), [2], 1, starts=2).collect()
    assert len({(r.doc % 2, r.label) for r in got}) == 2


def test_shares():
    assert pairs.shares({"a": 10, "b": 0, "c": 30}, 12, 2) == {"a": 4, "b": 0, "c": 8}
    assert pairs.shares({"a": 1, "b": 1}, 5) == {"a": 1, "b": 1}
    assert pairs.shares({"a": 3, "b": 3}, 3) == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        pairs.shares({"a": 9, "b": 9}, 3, 2)
    assert pairs.top_count(100, 0.07) == 7


PLAN = pairs.Plan({"x": 8, "y": 6}, 6, 10, 8, 1, 1, 0.1, 0.9, 0.99, "s")


def test_labeled_set(spark):
    """Universe, bands and draw against the definitions."""
    first, raw = clouds(spark, 30)
    second = first.select("id", F.slice("vec", 1, 2).alias("vec"))
    programs = spark.createDataFrame([(i, "pqr"[i % 3]) for i in range(30)], "id bigint, program string")
    every = pairs.universe({"x": first, "y": second}, programs, ["p", "q", "r"]).persist()
    rows = {(r.a, r.b): r for r in every.collect()}
    assert len(rows) == 435 and {r.total for r in rows.values()} == {435}
    vec = {i: np.array(v) for i, v in raw}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for name, part in (("x", slice(None)), ("y", slice(0, 2))):
        score = {k: round(cos(vec[k[0]][part], vec[k[1]][part]), 9) for k in rows}
        order = sorted(score.values())
        for k, r in rows.items():
            assert abs(r[f"score_{name}"] - score[k]) < 1e-8
        ranked = sorted(rows, key=lambda k: rows[k][f"score_{name}"])
        assert [rows[k][f"rank_{name}"] for k in ranked] == sorted(rows[k][f"rank_{name}"] for k in rows) and order
    middle = {(r.a, r.b) for r in pairs.mid_range(every, ["x", "y"], 0.9, 0.99).collect()}
    mean = {k: Fraction(r.rank_x + r.rank_y, 4 * 435) for k, r in rows.items()}
    assert middle == {k for k, m in mean.items() if Fraction(Decimal("0.9")) <= m < Fraction(Decimal("0.99"))}
    drawn = pairs.draw(every, PLAN).collect()
    assert len({(r.a, r.b) for r in drawn}) == len(drawn) == 8 + 30
    by = Counter((r.phase, r.pool, r.source) for r in drawn)
    assert by == {("pilot", "high", "x"): 2, ("pilot", "high", "y"): 2, ("pilot", "mid_range", None): 2, ("pilot", "random", None): 2, ("labeled", "high", "x"): 8, ("labeled", "high", "y"): 6, ("labeled", "mid_range", None): 6, ("labeled", "random", None): 10} or sum(n for (p, *_), n in by.items() if p == "pilot") == 8
    top = set(sorted(rows, key=lambda k: (-rows[k].score_x, k))[: pairs.top_count(435, 0.1)])
    assert {(r.a, r.b) for r in drawn if r.source == "x"} <= top and {(r.a, r.b) for r in drawn if r.pool == "mid_range"} <= middle
    assert [tuple(r) for r in pairs.draw(every, PLAN).collect()] == [tuple(r) for r in drawn]
    table = spark.createDataFrame(drawn)
    assert {r.n for r in pairs.ranges(table, every, ["x", "y"]).filter("phase = 'labeled' and pool = 'random'").collect()} == {10}
    scored = every.join(table.select("a", "b"), ["a", "b"]).select("a", "b", "score_x", "score_y")
    assert pairs.labeled_scores({"x": first, "y": second}, scored).count() == 38
    with pytest.raises(ValueError, match="those of the draw"):
        pairs.labeled_scores({"x": first}, scored.withColumn("score_x", F.col("score_x") + 0.1))
    with pytest.raises(ValueError, match="pairs left"):
        pairs.draw(every, pairs.Plan({"x": 80}, 1, 1, 4, 1, 1, 0.1, 0.9, 0.99, "s"))


@pytest.mark.parametrize("n", [1, 3, 330])
def test_bands_as_their_sql(spark, tmp_path, n):
    """Copies, opposite vectors, and rows that repeat an id, which make no pair with each other but one with every other row."""
    rng = np.random.default_rng(n)
    vecs = rng.normal(size=(n, 64)).astype(np.float32)
    vecs[n // 2 : n // 2 + 40] = vecs[0]
    vecs[-5:] = -vecs[0]
    rows = [(i if i % 50 else 7, v.tolist(), 0) for i, v in enumerate(vecs, 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(ORACLES["pair_universe"])
    names = [c[0] for c in found.description]
    got = {tuple(r) for r in QUERIES["pair_universe"](spark, str(tmp_path)).select(*names).collect()}
    assert got == set(found.fetchall()) and (n < 9 or len(got) == 4)


def test_bands_of_one_representation(spark):
    """Every score is listed where a bin holds many, and an unknown program stops the count."""
    angles = np.linspace(0, 0.001, 70)
    rows = spark.createDataFrame([(i, "pq"[i % 2], [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "id bigint, program string, x array<double>")
    got = bands.summary(rows, ["x"], ["p", "q"], 0.25, 0.5).collect()
    keys = {(i, j): int(np.floor(np.cos(angles[j] - angles[i]) * 1e9 + 0.5)) for i in range(70) for j in range(i + 1, 70)}
    rank = {k: 2 * sum(o < v for o in keys.values()) + sum(o == v for o in keys.values()) + 1 for k, v in keys.items()}
    name = lambda k: "between" if (k[0] + k[1]) % 2 else "pq"[k[0] % 2]
    middle = Counter(name(k) for k, v in rank.items() if 0.25 * 2 * len(keys) <= v < 0.5 * 2 * len(keys))
    assert {r.stratum: r.pairs for r in got} == Counter(map(name, keys)) and sum(abs(r.mid_range - middle[r.stratum]) for r in got) <= 2
    with pytest.raises(Exception, match="known one"):
        bands.summary(rows, ["x"], ["p"], 0.25, 0.5)


def test_binary_label(spark):
    assert [r[0] for r in spark.createDataFrame([("R",), ("P",), (None,)], "l string").select(pairs.binary_label(F.col("l"), "R")).collect()] == [1, 0, None]


def test_comparison(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(y + rng.normal(0, 0.2)), float(rng.normal()), y) for i in range(120) for y in [i % 2]]
    frame = spark.createDataFrame(rows, "pair_id int, good double, bad double, label int")
    table, intervals, d = comparison.compare(frame, "pair_id", "good", "bad", resamples=200)
    assert d.verdict == "first_higher" and d.low > 0 and d.value > 0.1
    assert {r.measure: r.verdict for r in intervals.collect()} == {"good": None, "bad": None, "difference": "first_higher"}
    assert table.count() == 2
    with pytest.raises(ValueError, match="labels"):
        comparison.compare(frame.withColumn("label", F.lit(2)), "pair_id", "good", "bad")


def candidates(npmi=(0.2, 0.1), noise=(0.1, 0.1)):
    return [Candidate(n, {"npmi": x, "ari": 0.8, "noise": z, "npmi_sensitivity": 0.1 if n == "m" else 0.4}, {"npmi": 0.01}) for n, x, z in zip(("m", "k"), npmi, noise, strict=True)]


def check(c):
    return gates(c, 0.4, 0.5, ["npmi"])


def test_stage_two():
    first, second = candidates()
    diff = lambda low, high, a=0.8, b=0.7, v="tie": Difference("m", "k", a, b, low, high, v, 0)
    tie = stage_two.close(first, second, diff(-0.1, 0.1), check, "k")
    assert (tie.decision.winner, tie.decision.step, tie.provisional.winner) == ("m", "npmi", "m")
    assert tie.flipped and tie.sensitivity == "k"
    won = stage_two.close(first, second, diff(-0.3, -0.1, 0.6, 0.8, "second_higher"), check, "m")
    assert (won.decision.winner, won.decision.step) == ("k", "f1") and not won.flipped
    against = stage_two.close(first, second, diff(0.1, 0.3, 0.6, 0.8, "first_higher"), check, "m")
    assert against.decision is None and "observed" in against.undefined_reason
    none = stage_two.close(first, second, diff(None, None, v=None), check, "m")
    assert none.decision is None and "no interval" in none.undefined_reason
    only = stage_two.close(*candidates(noise=(0.9, 0.1)), diff(None, None, v=None), check, "m")
    assert (only.decision.winner, only.decision.step) == ("k", "gates")
    with pytest.raises(ValueError):
        stage_two.provisional(first, second, check, "other")
    assert stage_two.from_record(stage_two.to_record(first)) == first
    for bad in ('{"name": "m", "mean": {}}', '{"name": "m", "mean": {"npmi": "x"}, "sd": {}}', "[]"):
        with pytest.raises(ValueError):
            stage_two.from_record(bad)


def gap_inputs(spark):
    rows, _ = clouds(spark, 60, spread=0.3)
    labels = spark.createDataFrame([(run, i, -1 if i % 20 == run else (i % 3 if i % 11 != run else (i + 1) % 3)) for run in range(3) for i in range(60)], "run int, id bigint, label int")
    meta = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else "a", 2000 + i // 30) for i in range(60)], "id bigint, program string, year int")
    npmi = spark.createDataFrame([(run, t, 0.1 * t) for run in range(3) for t in range(3)], "run int, topic int, npmi double")
    near = spark.createDataFrame([("a", "b", 2), ("b", "a", 2)], "source string, target string, score int")
    return labels, rows, meta, npmi, near


SETTINGS = gap_run.Settings(most_bridges=9, rare=0.05, split_year=2001, least_decline=0.0, least_runs=2)


def test_gap_run(spark):
    labels, rows, meta, npmi, near = gap_inputs(spark)
    got = gap_run.run(labels, rows, meta, npmi, near, 0, SETTINGS)
    gaps = [r.asDict() for r in got.gaps.collect()]
    assert {g["rule"] for g in gaps} == {"a", "b", "c", "d"} and len({g["gap_id"] for g in gaps}) == len(gaps)
    members = defaultdict(set)
    for r in got.members.collect():
        members[(r.gap_id, r.part)].add(r.id)
    own = defaultdict(set)
    for r in labels.collect():
        own[(r.run, r.label)].add(r.id)
    for g in gaps:
        parts = ["first_topic", "second_topic"] if g["rule"] == "b" else ["topic"]
        assert [members[(g["gap_id"], p)] for p in parts] == [own[(g["run"], t)] for t in g["topics"]]
    # support by the definition
    like = lambda a, b: len(a & b) / len(a | b)
    key = lambda g: (g["rule"], g["source"], g["target"])

    def overlap(g, h):
        m, n = ([members[(x["gap_id"], p)] for p in (["first_topic", "second_topic"] if x["rule"] == "b" else ["topic"])] for x in (g, h))
        return like(m[0], n[0]) if len(m) == 1 else max(min(like(m[0], n[0]), like(m[1], n[1])), min(like(m[0], n[1]), like(m[1], n[0])))

    want = {g["gap_id"]: 1 + sum(any(h["run"] == run and key(h) == key(g) and overlap(g, h) >= 0.5 for h in gaps) for run in (1, 2)) for g in gaps if g["run"] == 0}
    assert {r.gap_id: r.support for r in got.support.collect()} == want
    assert {r.variant for r in got.sensitivity.collect()} == {"primary", "literal_share", "without_floor"}


def test_saved_gaps_are_verified(spark):
    inputs = gap_inputs(spark)
    got = gap_run.run(*inputs, 0, SETTINGS)
    assert gap_run.verify(got, *inputs, 0, SETTINGS) == []
    changed = gap_run.Result(got.cuts, got.gaps.withColumn("rule", F.lit("a")), got.members, got.support, got.sensitivity)
    assert gap_run.verify(changed, *inputs, 0, SETTINGS) == ["gaps differ from what the rules give"]


def test_temporal(spark):
    rows, _ = clouds(spark, 60)
    years = spark.createDataFrame([(i, 2000 + i // 40) for i in range(60)], "id bigint, year int")
    words = spark.createDataFrame([(i, "t", [f"w{i % 3}", "common", f"late{i}" if i >= 40 else "old"]) for i in range(60)], "doc bigint, section string, tokens array<string>")
    vocab = spark.createDataFrame([("w0",), ("w1",), ("w2",), ("common",), ("late50",)], "term string")
    cluster = lambda r: r.select("id", (F.col("id") % 3).cast("int").alias("label"))
    m = temporal.fit(rows, years, words, 2001, cluster, vocabulary=vocab)
    assert {r.term for r in m.topics.collect()} == {"w0", "w1", "w2", "common"}
    late = temporal.assign_late(m)
    assert all(r.topic == r.id % 3 for r in late.collect()) and late.count() == 20
    runs = spark.createDataFrame([("r", i, i % 3) for i in range(60)] + [("s", 1, 1)], "run_id string, id bigint, label int")
    full = temporal.full_labels(runs, "r", rows)
    with pytest.raises(ValueError):
        temporal.full_labels(runs, "s", rows)
    told = {(r.period, r.noise): r for r in temporal.consistency(m, late, full).collect()}
    assert told[("late", "own_label")].ari == told[("early", "exclude_either")].nmi == 1.0 and told[("late", "own_label")].agreement == 1.0
    with pytest.raises(ValueError, match="no topic"):
        temporal.fit(rows, years, words, 2001, lambda r: r.select("id", F.lit(-1).alias("label")), vocabulary=vocab)
    programs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "id bigint, program string")
    sample = temporal.expert_sample(late.withColumn("atypical", F.col("id") < 43), programs, 8, 5, 1, "s").collect()
    assert Counter(r.pool for r in sample) == {"atypical": 3, "typical": 5} and sorted(r.position for r in sample) == list(range(1, 9))


def test_expert_cases(spark):
    rows, _ = clouds(spark, 60)
    labels = spark.createDataFrame([(i, i % 3) for i in range(40)], "id bigint, label int")
    topics = spark.createDataFrame([(t, f"w{t}{k}", k) for t in range(3) for k in (1, 2)], "label int, term string, rank int")
    sample = spark.createDataFrame([(i, "ab"[i % 2], i % 3, i % 5 == 0) for i in range(40, 60)], "id bigint, program string, topic int, atypical boolean")
    sizes = labels.groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("size"))
    cases = expert.assignments(sample, labels, topics, sizes, "s", expert.Sizes(3, examples=2))
    got = cases.collect()
    assert Counter(r.program for r in got) == {"a": 3, "b": 3} and sorted(r.code for r in got) == [f"A{k:02d}" for k in range(1, 7)]
    assert all(len(r.examples) == 2 and {x % 3 for x in r.examples} == {r.topic} and r.terms == [f"w{r.topic}1", f"w{r.topic}2"] for r in got)
    with pytest.raises(ValueError, match="topic"):
        expert.assignments(sample.withColumn("topic", F.lit(9)), labels, topics, sizes, "s", expert.Sizes(3))
    early = rows.filter("id < 40")
    cents = learn.unit and query_index.search.centroids(early, labels)
    order = [r.id for r in cases.orderBy(expert.hash_order("s:B", "program", "id")).collect() if r.program == "a"]
    bad = spark.createDataFrame([(order[0], "no abstract")], "id bigint, reason string")
    asked, replaced = expert.queries(cases.select("id", "program", "topic"), bad, rows, early, cents, "s", expert.Sizes(1), ranking=4, neighbours=2)
    assert len(asked) == 2 and order[0] not in {q["id"] for q in asked} and [r.id for r in replaced.collect()] == [order[0]]
    assert all(len(q["ranking"]) == 4 and len(q["neighbours"]) == 2 and q["topic"] not in q["neighbours"] for q in asked)
    with pytest.raises(ValueError, match="candidates"):
        expert.queries(cases.select("id", "program", "topic"), bad, rows, rows, cents, "s", expert.Sizes(1))
    text = expert.sheet("Queries", asked, ["id"])
    assert "## B01" in text and "- id:" not in text
    assert {n for _, n, _ in expert.key_rows(asked, ["id"])} == {"id"}
    assert expert.topics_sample(sizes, labels.select(F.col("label").alias("topic"), "id"), topics, 2, "s", expert.Sizes(1)).count() == 2
    gaps = spark.createDataFrame([("G1", "a"), ("G2", "a"), ("G3", "b")], "gap_id string, rule string")
    own = spark.createDataFrame([("G1", 1), ("G2", 2), ("G3", 3)], "gap_id string, id bigint")
    assert {r.rule for r in expert.gaps_sample(gaps, own, 1, "s", expert.Sizes(1)).collect()} == {"a", "b"}


def test_query_index(spark, tmp_path):
    rows, raw = clouds(spark, 30)
    labels = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, label int")
    gaps = spark.createDataFrame([(1, 0, None), (2, 1, 2)], "gap_no bigint, first bigint, second bigint")
    home = f"{tmp_path}/run"
    strict.publish(spark, home, {"rows": rows, "labels": labels, "gaps": gaps}, {"model": "m", "revision": "1", "longest_chunk": 8})
    index = query_index.load(spark, home)
    encoder = query_index.Encoder("m", "1", 10, lambda texts: [[1.0, 0.1, 0.0, 0.0] if "zero" in t else [0.0, 1.0, 0.0, 0.0] for t in texts])
    one = query_index.represent(spark, {"title": "zero", "abstract": "zero and more. " * 6, "objectives": " "}, query_index.matching(encoder, index))
    told = query_index.answer(one, index)
    assert told["assignment"].first().topic == 0 and all(r.id % 3 == 0 for r in told["similar"].collect())
    assert [r.topic for r in told["neighbours"].collect()] == [1, 2] and told["gaps"].first().gap_no == 1 and told["antecedents"].count() == 5
    for other in (query_index.Encoder("m", "2", 10, None), query_index.Encoder("m", "1", 5, None)):
        with pytest.raises(ValueError):
            query_index.matching(other, index)
    with pytest.raises(ValueError, match="no text"):
        query_index.represent(spark, {"title": " "}, encoder)
    index.release()
    strict.publish(spark, f"{tmp_path}/bad", {"rows": rows, "labels": labels.limit(9), "gaps": gaps}, {})
    with pytest.raises(ValueError, match="different documents"):
        query_index.load(spark, f"{tmp_path}/bad")
    points = rows.select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), F.when(F.col("id") == 0, -1).otherwise(F.col("id") % 3).alias("label"))
    drawn = query_index.figure(points, "Map")
    assert len(drawn["data"]["values"]) == 30 and drawn["layer"][1]["encoding"]["color"]["scale"]["domain"] == ["0", "1", "2"]
    with pytest.raises(ValueError):
        query_index.figure(points, "Map", 10)


def test_publishing_survives_a_crash(spark, tmp_path):
    home, good = f"{tmp_path}/run", spark.range(5)
    broken = spark.range(3).select(F.raise_error(F.lit("crash")).cast("string").alias("x"))
    with pytest.raises(Exception, match="crash"):
        strict.publish(spark, home, {"a": spark.range(9), "b": broken}, {})
    strict.publish(spark, home, {"a": good, "b": good}, {})
    assert strict.read_verified(spark, home, "a").count() == 5
    with pytest.raises(FileExistsError):
        strict.publish(spark, home, {"a": good}, {})


def test_commands(spark, tmp_path, capsys):
    """From a public list to guarded tables: dry runs write nothing, a stage runs once, and what is sensitive stays."""
    topics = [{"id": f"T{k}", "name": f"topic {k}"} for k in range(5)]

    def get(url):
        page, size = (int(x) for x in url.split("?")[1].split(","))
        return json.dumps({"meta": {"count": 5}, "results": topics[(page - 1) * size : page * size]}).encode()

    settings, ports = {"topics_url": "https://x?{page},{per_page}"}, {"get": get}
    call = lambda *a, s=None: (commands.main([*a, "--home", str(tmp_path), "--snapshot", "s1"], spark, settings | (s or {}), ports, spark.createDataFrame([("secret name",)], "needle string")), json.loads(capsys.readouterr().out))
    assert call("topic_list", "--dry-run")[1] == {"dry_run": True, "inputs": {}, "stage": "topic_list"}
    assert call("topic_list") == (0, {"count": 5, "rows": {"topics": 5}, "stage": "topic_list"})
    assert call("topic_list")[0] == 1
    assert "not published" in call("pair_draw")[1]["refused"]
    # a stage that needs others, and a guarded table
    corpus_rows = spark.createDataFrame([(f"D-{i:08x}", f"Title {i}.", "An abstract of some words. And more.", "ab"[i % 2], 2000 + i % 3, True) for i in range(12)], "doc_code string, title string, abstract string, program string, issue_year int, include boolean").withColumn("objectives", F.lit(None).cast("string"))
    strict.publish(spark, f"{tmp_path}/s1/corpus_table", {"corpus": corpus_rows}, {})
    assert call("chunk_table", "--dry-run")[1]["inputs"] == {"corpus_table.corpus": 12}
    code, told = call("chunk_table")
    assert code == 0 and told["rows"]["sections"] == 24 and told["longest_chunk"] <= 128
    ports["encode"] = lambda texts: [[float(len(t)), 1.0, float(sum(map(ord, t)) % 7)] for t in texts]
    assert call("embeddings", s={"model": "m", "revision": "1", "model_limit": 128})[1]["rows"] == {"rows": 12}
    assert call("term_weights", s={"stopwords": ["of"], "min_df": 2})[1]["rows"]["words"] == 24
    plan = pairs.Plan({"first": 4}, 2, 3, 2, 0, 0, 0.5, 0.2, 0.9, "s")
    code, told = call("pair_draw", s={"programs": ["a", "b"], "plan": plan})
    assert code == 0 and told["pairs"] == 66 and told["rows"]["drawn"] == 11
    with pytest.raises(ValueError, match="2 rows of x hold"):
        job = commands.Job(spark, str(tmp_path), "s1", sensitive=spark.createDataFrame([("secret name",)], "needle string"))
        commands.guard(job, "x", spark.createDataFrame([("a Secret  Name here",), ("fine",), ("secret name",)], "t string"))
    with pytest.raises(LookupError):
        job.port("cluster")


def test_leaks_by_parts(spark):
    docs = spark.createDataFrame([(1, "The quick  brown fox"), (2, "nothing"), (3, None), (4, "brown")], "id bigint, text string")
    needles = spark.createDataFrame([("quick brown",), ("brown",), ("fox",), ("zzz",)], "needle string")
    want = {(1, "quick brown"), (1, "brown"), (1, "fox"), (4, "brown")}
    for chars in (4, 1_000):
        assert {tuple(r) for r in guards.leaks(docs, "id", "text", needles, chars).collect()} == want
    finder = guards.Finder(["a", "ab", ""])
    finder.machine = None
    assert finder.find("xab") == guards.Finder(["a", "ab", ""]).find("xab") == ["a", "ab", ""]


def test_files_of_items(spark, tmp_path):
    body = b"%PDF-1.4 hello"
    listing = {"uuid": "i1", "_embedded": {"bundles": {"_embedded": {"bundles": [{"name": "ORIGINAL", "_embedded": {"bitstreams": {"_embedded": {"bitstreams": [{"id": "f1", "name": "a.pdf", "sizeBytes": len(body), "checkSum": {"checkSumAlgorithm": "MD5", "value": hashlib.md5(body).hexdigest()}}]}}}}]}}}}
    found = bundles.listed_files(lambda url: json.dumps(listing).encode(), "https://x/{item}", "i1")
    assert found == [("i1", "ORIGINAL", "f1", "a.pdf", len(body), "MD5", hashlib.md5(body).hexdigest())]
    with pytest.raises(ValueError):
        bundles.listed_files(lambda url: json.dumps(listing).encode(), "https://x/{item}", "i2")
    path, md5 = f"{tmp_path}/a.pdf", hashlib.md5(body).hexdigest()
    assert bundles.store([body[:3], body[3:]], path, len(body), "MD5", md5) == hashlib.sha256(body).hexdigest()
    for parts, size, digest in (([body], len(body) - 1, md5), ([b"<html>" + body], 99, md5), ([body[:5]], len(body), md5), ([body], len(body), "0")):
        with pytest.raises(bundles.BadFile):
            bundles.store(parts, f"{tmp_path}/b.pdf", size, "MD5", digest)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf"]
    files = spark.createDataFrame([(f"i{k}", f"f{k}", len(body), "MD5", md5 if k else "0") for k in range(4)], "item string, file string, size bigint, algorithm string, checksum string")
    log, folder = f"{tmp_path}/log", tmp_path / "pdfs"
    folder.mkdir()
    clock = iter(range(1, 60))
    now = lambda: datetime(2024, 1, 1, 0, 0, next(clock))
    fetched = []

    def fetch(url):
        fetched.append(url)
        return [body]

    assert bundles.download_all(spark, files, str(folder), log, "{file}", now, fetch) == {"downloaded": 3, "failed": 1}
    assert bundles.download_all(spark, files, str(folder), log, "{file}", now, fetch) == {"downloaded": 0, "failed": 1} and len(fetched) == 5
    with pytest.raises(RuntimeError):
        bundles.download_all(spark, files.withColumn("checksum", F.lit("0")).withColumn("item", F.concat(F.lit("x"), "item")), str(folder), log, "{file}", now, fetch, most_failures=2)
    assert {r.item: r.status for r in bundles.read_log(spark, log).filter("item like 'i%'").collect()} == {"i0": "failed", "i1": "downloaded", "i2": "downloaded", "i3": "downloaded"}
    digest = hashlib.sha256(b"data").hexdigest()
    assert bundles.asset(f"{tmp_path}/x", lambda: [b"data"], 4, digest) == bundles.asset(f"{tmp_path}/x", lambda: 1 / 0, 4, digest)


def test_topic_lists(spark):
    rows = [{"id": f"T{k}", "n": k} for k in range(7)]

    def get(url, count=7, rows=rows):
        page, size = (int(x) for x in url.split(","))
        return json.dumps({"meta": {"count": count}, "results": rows[(page - 1) * size : page * size]}).encode()

    assert topic_lists.read(get, "{page},{per_page}", 3) == rows
    assert topic_lists.table(spark, rows).first().record == '{"id":"T0","n":0}'
    with pytest.raises(ValueError, match="reported"):
        topic_lists.read(lambda u: get(u, 9), "{page},{per_page}", 3)
    with pytest.raises(ValueError, match="repeated"):
        topic_lists.read(lambda u: get(u, 7, rows[:6] + rows[:1]), "{page},{per_page}", 3)


@dataclass(frozen=True)
class Inner:
    k: int
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outer:
    inner: Inner
    share: float
    note: str | None = None


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"inner": {"k": 2, "names": ["x"]}, "share": 1}')
    assert config.load(Outer, f"{tmp_path}/a.json") == Outer(Inner(2, ("x",)), 1.0)
    for bad in ('{"inner": {"k": 2}, "share": 1, "more": 1}', '{"inner": {"k": "2"}, "share": 1}', '{"share": 1}', '{"inner": {"k": 1, "k": 2}, "share": 1}', '{"inner": {"k": true}, "share": 1}', "[]"):
        with pytest.raises(ValueError):
            config.build(Outer, config.parse(bad))


def test_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("AB123", "ann", "text one"), ("CD456", "ann", "text two"), ("EF789", "bob", "text three")], "code string, who string, shown string")
    assert sheets.write_sheets(rows, str(tmp_path), "who", "code", ["shown"], "s") == ["ann", "bob"]
    labels, faults = sheets.read_sheet(spark, f"{tmp_path}/ann", "code", ["shown"], ["R", "N"], rows.filter("who = 'ann'"))
    assert labels.count() == 2 and faults == ["2 labels are missing"]
    (tmp_path / "back.csv").write_text("order__,code,shown,label,note\n1,AB123,x,R,see Secret Name\n2,AB123,x,Q,\n3,ZZ000,x,N,\n")
    labels, faults = sheets.read_sheet(spark, f"{tmp_path}/back.csv", "code", ["shown"], ["R", "N", "P"], rows.filter("who = 'ann'"))
    assert faults == ["1 codes are unknown", "1 codes are missing", "1 codes are repeated", "1 labels are off the scale"]
    assert sheets.missing_levels(labels, ["R", "N", "P"]) == ["P"]
    assert sheets.notes_with(labels, "code", spark.createDataFrame([("secret name",)], "needle string")) == 1


def test_questionnaires(spark):
    rows = [(r, i, (r + k) % 5 + 1) for r in range(6) for k, i in enumerate("abc")]
    frame = spark.createDataFrame(rows, "respondent int, item string, value int")
    assert agreement.answer_matrix(frame, 1, 5).count() == 18
    for bad in (frame.filter("not (respondent = 1 and item = 'a')"), frame.withColumn("value", F.lit(9)), frame.withColumn("item", F.lit(" ")), frame.union(frame.limit(1))):
        with pytest.raises(ValueError):
            agreement.answer_matrix(bad, 1, 5)
    assert agreement.dimensions({"x": ["a"], "y": ["b", "c"]}, ["a", "b", "c"]) == {"x": ("a",), "y": ("b", "c")}
    for groups in ({"x": ["a"], "y": []}, {"x": ["a", "b"], "y": ["b", "c"]}, {"x": ["a", "b"]}, {"x": ["a", "b", "c", "d"]}):
        with pytest.raises(ValueError):
            agreement.dimensions(groups, ["a", "b", "c"])
    wide = spark.createDataFrame([(1, 2), (2, 3), (3, 5)], "a int, b int")
    got = {r.deleted: r for r in agreement.cronbach_if_deleted(wide, ["a", "b"]).collect()}
    assert abs(got[None].alpha - 2 * (1 - (1 + 7 / 3) / np.var([3, 5, 8], ddof=1))) < 1e-9 and got["a"].undefined_reason == "one_item"


def test_corpus_checks(spark):
    settings = corpus.Settings("thesis", "2020-01-01", {"p": "P"})
    meta = lambda title: {"type": ["x#thesis"], "title": [title], "abstract": ["Same"], "issued": ["2021-02"], "added": ["1"], "rights": ["y/c_abf2"]}
    records = spark.createDataFrame([("u1", "h1", "p", meta("Á b")), ("u2", "h2", "p", meta("a  B")), ("u3", None, "p", meta("other"))], "uuid string, handle string, program string, metadata map<string,array<string>>")
    files = spark.createDataFrame([("u1", "verified", "d"), ("u3", "verified", "e")], "uuid string, status string, sha256 string")
    texts = spark.createDataFrame([("u1", "ok", 1, 0), ("u3", "ok", 1, 1)], "uuid string, status string, text_pages int, ocr_pages int")
    found = spark.createDataFrame([("u1", "extracted", "G.", "S.", ["f"]), ("u3", "not_found", None, None, [])], "uuid string, status string, general string, specific string, flags array<string>")
    none = spark.createDataFrame([], "handle string, owner_handle string")
    built = corpus.build(records, files, texts, found, none, settings).persist()
    rows = {r.uuid: r for r in built.collect()}
    assert rows["u2"].duplicate_of == "u1" and rows["u2"].exclusion_reason == "duplicate" and rows["u1"].objectives == "G.\n\nS." and rows["u3"].source_format == "mixed"
    assert rows["u1"].issued_after_snapshot and rows["u1"].notes == ["objectives: f"] and rows["u3"].url.endswith("/u3")
    assert corpus.usable(built).count() == 2
    good = {"records": 3, "included": 2, "duplicates": 1, "non_thesis": 0, "objectives_extracted": 1, "metadata_only": 1}
    assert corpus.check(built, good) == good
    with pytest.raises(ValueError, match="included is 2, 5 is declared"):
        corpus.check(built, good | {"included": 5})
    with pytest.raises(ValueError, match="has its objectives row"):
        corpus.build(records, files, texts, found.filter("uuid = 'u3'"), none, settings)
    with pytest.raises(ValueError, match="copy of the owner"):
        corpus.build(records, files, texts, found, spark.createDataFrame([("h1", "h2")], "handle string, owner_handle string"), settings)
    proposal = corpus.as_row("T", "A", None, built).first()
    assert (proposal.title, proposal.section_source, proposal.include, proposal.program) == ("T", "title_abstract", True, None)
