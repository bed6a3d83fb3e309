import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import people, records
from corpuslens.operators import labels
from corpuslens.plans import experiment
from corpuslens.sources import files

KEY = b"k" * 32


def apply(spark, values, f, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in frame.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


@pytest.mark.parametrize("key", [KEY, b"x" * 100])
def test_hmac(spark, key):
    texts = ["", "abc", "ñandú", None]
    want = [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() if t is not None else None for t in texts]
    assert apply(spark, texts, lambda c: people.hmac_sha256(key, c)) == want


def test_people(spark):
    assert apply(spark, ["https://orcid.org/0000-0002-1825-0097", "0000-0002-1694-233x", "0000-0002-1825-0098", "x", None], people.orcid) == ["0000-0002-1825-0097", "0000-0002-1694-233X", None, None, None]
    assert apply(spark, ["  Pérez ,Ana  María"], people.name_key) == ["perez, ana maria"]
    code = "A-" + hmac.new(KEY, b"A-\0x", hashlib.sha256).hexdigest()[:10]
    assert apply(spark, [["x", " ", "y", "x"]], lambda c: F.array(F.size(people.author_codes(c, KEY, "A-")).cast("string"), people.author_codes(c, KEY, "A-")[0]), "array<string>") == [["2", code]]
    with pytest.raises(ValueError):
        people.pseudonym(F.lit("x"), b"short", "A-")
    assert "Ana María Pérez Ruiz" in apply(spark, ["Pérez Ruiz, Ana María"], people.written_forms)[0]
    assert apply(spark, ["By ANA PÉREZ and Ana; Banana stays"], lambda c: people.redacted(c, ["Ana", "Ana Pérez"])) == ["By […] and […]; Banana stays"]


def test_records(spark):
    rights = [["a/c_abf2"], ["a/c_abf2", "a/c_16ec"], ["x"], [" "]]
    assert apply(spark, rights, records.access_class, "array<string>") == ["open", "restricted", "unknown", "missing"]
    assert apply(spark, [["u#bachelor"], ["u#Tesis"], ["u#book"], []], lambda c: records.document_type(c, "bachelor"), "array<string>") == ["thesis", "thesis_other_spelling", "other", "(none)"]
    files_ = [[("ORIGINAL", "T.pdf"), ("ORIGINAL", "t.rt.pdf"), ("ORIGINAL", "Autorización.pdf"), ("TEXT", "t.pdf")]]
    assert [[f.name for f in x] for x in apply(spark, files_, records.thesis_files, "array<struct<bundle: string, name: string>>")] == [["T.pdf"]]
    assert apply(spark, ["a", "", None], lambda c: records.joined_parts(c, F.lit("b"), F.lit(" "))) == ["a\n\nb", "b", "b"]
    gaps = spark.createDataFrame([("a", ["p"], None, None), ("c", [], "q", "r")], "rule string, programs array<string>, source string, target string")
    assert [r.rule for r in records.concerned(gaps, None, ["r"]).collect()] == ["c"] and records.concerned(gaps, ["a"], ["r"]).count() == 0


def test_adjudicators_and_codes():
    import random

    disputed = [(f"p{i}", ["a", "b"]) for i in range(6)]
    got = labels.adjudicators(disputed, ["a", "b", "c", "d"], "s")
    assert sorted(got.values()) == ["c"] * 3 + ["d"] * 3 and got == labels.adjudicators(disputed[::-1], ["a", "b", "c", "d"], "s")
    with pytest.raises(ValueError):
        labels.adjudicators(disputed, ["a", "b"], "s")
    codes = labels.blind_codes([str(i) for i in range(500)], random.Random(1).choice)
    assert len(set(codes.values())) == 500


def test_agreement_by_raters(spark):
    rated = spark.createDataFrame([("1", "x", "y", 0, 0), ("2", "x", "y", 1, 1), ("3", "x", "z", 0, 1), ("4", "x", "z", 1, 0)], "pair_id string, annotator_a string, annotator_b string, a int, b int")
    got = labels.agreement_by_pair_of_raters(rated, 2)
    assert got["x", "y"]["kappa"] == 1.0 and got["x", "z"]["kappa"] == -1.0 and got[None, None]["n"] == 4


def test_experiment(spark):
    rows = spark.createDataFrame([(i, [float(i % 3 == k) + 0.01 * (i % 7) for k in range(4)]) for i in range(60)], "id bigint, vec array<double>")
    grid = experiment.Grid((1, 2), (2, 3), (5,), dimensions=2)
    assert experiment.forecast(["r"], grid) == {"reductions": 2, "clusterings": 6, "metric_calls": 6, "stability_pairs": 3}
    found, scored = experiment.execute({"r": rows}, grid)
    assert found.count() == 360 and scored.count() == 6
    ari = {(r.algorithm, r.parameter): r.ari for r in experiment.stability(found).collect()}
    assert ari["kmeans", 3] == pytest.approx(1.0) and ari["density", 5] == pytest.approx(1.0)
    best = scored.filter("algorithm = 'kmeans'").orderBy(F.desc("silhouette")).first()
    assert best.parameter == 3
    assert experiment.repeats(found.filter("run_id = 'r-density5-s1'"), found.filter("run_id = 'r-density5-s2'"))
    with pytest.raises(ValueError):
        experiment.pinned({"a": 1}, experiment.config_hash({"a": 2}))


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "x int, y string")
    files.write_csv(df, f"{tmp_path}/c", ["x"])
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c", "x int, y string").collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        files.sparse(spark.createDataFrame([(1, "t", 0.5), (1, "t", 0.2)], "doc int, term string, weight double"))
    with files.exclusive_run(str(tmp_path)), pytest.raises(RuntimeError), files.exclusive_run(str(tmp_path)):
        pass
    (tmp_path / "a.bin").write_bytes(b"one\x0c \x0cthree")
    pages = files.page_texts(spark, f"{tmp_path}/a.bin", lambda c: c.decode().split("\x0c"), lambda c, p: f"seen {p}" if p == 1 else "", least=4)
    assert [(r.page, r.text, r.source) for r in pages.orderBy("page").collect()] == [(0, "one", "text_layer"), (1, "seen 1", "ocr"), (2, "three", "text_layer")]
    coded = files.encode(spark.createDataFrame([("k", "ab"), ("k", "ab")], "cache_key string, text string"), lambda ts: [[float(len(t))] for t in ts])
    assert [tuple(r) for r in coded.collect()] == [("k", [2.0])]
    assert files.markdown(df.orderBy("x"), "T").splitlines()[-1] == "| 2 | b |"


def test_grid_takes_the_best_of_ten_starts(spark, monkeypatch):
    seeds, real = [], experiment.learn.KMeans
    monkeypatch.setattr(experiment.learn, "KMeans", lambda **kw: seeds.append(kw["seed"]) or real(**kw))
    vec = spark.createDataFrame([(i, [float(i % 3), float(i % 2), 1.0]) for i in range(12)], "id bigint, vec array<double>").coalesce(1)
    experiment.execute({"r": vec}, experiment.Grid(seeds=(4,), ks=(2,), dimensions=2))
    assert seeds == list(range(4, 14))
