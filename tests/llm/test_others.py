import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import ann, languages, mixing, pieces, quality, queries, secrets, stages
from corpuslens.llm.common import maybe_in

MODEL = queries.piece_model()


def test_mix_matches_sql(spark, rows):
    unique = [(k, t) for k, (_, t) in enumerate(rows)]
    frame = spark.createDataFrame([(i, t, ["b", None, "a", "hot", "hot"][i % 5]) for i, t in unique], "doc_id bigint, text string, source string")
    got = mixing.mix(frame).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = con.execute(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)[got.columns.tolist()]
    assert (got["taken"] == want["taken"]).all() and np.allclose(got["target"], want["target"])
    assert (got["taken"] <= 2 * got["size"]).all()
    by = frame.toPandas().assign(taken=got["taken"], target=got["target"], size=got["size"]).groupby("source", dropna=False)
    assert ((by["taken"].sum() - by["target"].first()).abs() <= by["size"].max()).all()


def test_mix_null_and_repeated_ids(spark, docs, empty, rows):
    """Against SQL: by the rows, as ids don't tell them apart; and with no ids at all."""
    for frame in (docs, docs.withColumn("doc_id", F.lit(None).cast("bigint"))):
        con = duckdb.connect()
        con.register("documents", frame.select("doc_id", "text", "source").distinct().toArrow())
        want = con.execute(mixing.ORACLE.replace("AS times FROM r GROUP BY doc_id", "AS times, key AS k2, nth AS n2 FROM r GROUP BY doc_id, key, nth").replace("LEFT JOIN t USING (doc_id)", "LEFT JOIN t ON c.key = k2 AND c.nth = n2")).fetchall()
        got = mixing.mix(frame.select("doc_id", "text", "source").distinct()).collect()
        plain = lambda r: (*r[:3], round(r[3], 6), *r[4:])
        assert Counter(map(plain, map(tuple, got))) == Counter(map(plain, want))
    assert mixing.mix(docs).count() == len(rows)
    assert mixing.mix(empty).count() == 0


def test_mix_targets(spark):
    """One source can't use its share; the excess goes to the others by weight."""
    frame = spark.createDataFrame([(i, "w " * 10, "a" if i < 10 else "b" if i < 100 else "c") for i in range(1000)], "doc_id bigint, text string, source string")
    got = {r.source_size: r.target for r in mixing.mix(frame).collect()}
    assert got == {100: 200.0, 900: 1800.0, 9000: 13000.0}


#: The contract's patterns, written anew; letters of the key words in either case, ASCII only.
KEY_WORD = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
PLAIN = [("assign", KEY_WORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]


def secrets_brute(text):
    t, spans = text or "", []
    for k, (_, pattern, group, least) in enumerate(PLAIN):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if len(m[group]) >= least]
    listed = ",".join(f"{PLAIN[k][0]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest())


def test_secrets(docs, rows):
    got = secrets.digest(secrets.findings(docs, secrets.scan(docs))).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter((i, *secrets_brute(t)) for i, t in rows)
    assert any(r.n_assign and r.n_access and r.n_hex for r in got)


def test_secrets_match_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    found = con.execute(secrets.ORACLE)
    names = [c[0] for c in found.description]
    got = secrets.digest(secrets.findings(docs, secrets.scan(docs))).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(found.fetchall())


def test_secrets_ledger(spark, docs, tmp_path):
    """A second scan reads what the first wrote, scans only what is new, and findings are those of the present versions."""
    path, first = f"{tmp_path}/ledger", docs.filter("doc_id < 50")
    ledger = secrets.update(first, path)
    blobs = first.select(F.sha2(F.coalesce("text", F.lit("")), 256)).distinct().count()
    assert ledger.count() == blobs * len(secrets.RULES)  # clean blobs have their rows too
    assert secrets.scan(first, ledger).count() == 0
    whole = Counter(tuple(map(str, r)) for r in secrets.scan(docs).collect())
    assert Counter(tuple(map(str, r)) for r in secrets.update(docs, path).collect()) == whole
    assert Counter(secrets.digest(secrets.findings(docs, spark.read.parquet(path))).collect()) == Counter(secrets.digest(secrets.findings(docs, secrets.scan(docs))).collect())
    # a new version of a rule is scanned again, and the old one's spans are findings no more; a new kind comes last
    newer = dict(secrets.RULES) | {"hex": secrets.Rule(2, r"[0-9a-f]{99,}", 0, 99), "same": secrets.Rule(1, "same row", 0, 1)}
    ledger = secrets.update(docs, path, newer)
    assert {(r.kind, r.version) for r in ledger.select("kind", "version").distinct().collect()} == {(k, r.version) for k, r in secrets.RULES.items()} | {("hex", 2), ("same", 1)}
    assert secrets.scan(docs, ledger, newer).count() == 0
    spans = [s for r in secrets.findings(docs, ledger, newer).collect() for s in r.spans]
    assert "hex" not in {s.kind for s in spans} and "same" in {s.kind for s in spans}
    assert "hex" in {s.kind for r in secrets.findings(docs, ledger).collect() for s in r.spans}


def test_secrets_empty(empty, tmp_path):
    assert secrets.findings(empty, secrets.update(empty, f"{tmp_path}/ledger")).count() == 0


def vectors(spark, n=400, d=16):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=d).astype("float32").tolist(), "x") for i in range(n)]
    for i in range(n // 2, min(n, n // 2 + 60)):
        rows[i] = (i, rows[7][1], "x")  # a common vector
    rows += [(None, rows[1][1], "x"), (n, None, "x"), (n + 20, [0.0] * d, "x"), (n + 40, [float("nan")] * d, "x"), (n + 60, [None] + [1.0] * (d - 1), "x"), (n + 80, [float("inf")] * d, "x"), (n + 100, [1.0, 2.0], "x"), (20, rows[min(20, n - 1)][1], "x")]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string").repartition(5), rows


def ann_brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = Counter()
    for q, x in good:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x.tolist(), v.tolist(), strict=True)), i) for i, v in good if i != q)[:k]
            out.update((q, r + 1, i) for r, (_, i) in enumerate(found))
    return out


@pytest.mark.parametrize("sizes", [(4096, 16384, 16384), (64, 7, 100)])
def test_ann(spark, sizes):
    frame, rows = vectors(spark)
    # repeated rows: of a query, of a query with another vector, of candidates beside a common vector
    more = [rows[40], rows[40], (60, rows[61][1], "x"), *[rows[205]] * 30, *[rows[200]] * 3]
    frame, rows = frame.union(spark.createDataFrame(more, frame.schema)).repartition(5), rows + more
    got = ann.nearest(frame, frame.filter("vec_id % 20 = 0"), 20, *sizes)
    assert Counter((r.query_id, r.rank, r.vec_id) for r in got.collect()) == ann_brute(rows, 20)


def test_ann_tile_is_exact_in_many_dimensions():
    rng = np.random.default_rng(2)
    a, b = (np.full((3, 5000), 127, np.int8) - rng.integers(0, 2, (3, 5000)).astype(np.int8) for _ in range(2))
    assert (ann._tile(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_ann_few_and_none(spark):
    frame, _ = vectors(spark, 10)
    got = ann.nearest(frame, frame.filter("vec_id = 0"), 20)
    assert got.count() == 9 + 1  # the repeated vector 20 is there
    none = frame.filter("vec_id < 0")
    assert ann.nearest(none, none, 20).count() == 0


def test_pieces_match_the_library(rows):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    rng = random.Random(2)
    parts = ["a", "e", "the", "ing", " ", "  ", "\n", "▁", "é", "日", "😀", "\x00", "0", "<s>", "<0x0A>", "--", "==", "́", "\xa0", "aaaa", "    "]
    texts = [t or "" for _, t in rows] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        ids = list(own.encode(t))
        assert ids == library.encode(t)
        assert own.decode(ids) == library.decode(ids)


def test_pieces_operator(docs, empty, rows):
    import hashlib

    own = pieces.load(MODEL)
    got = pieces.digest(pieces.encode(docs, MODEL, decode=True)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((i, len(own.encode(t or "")), sha(",".join(map(str, own.encode(t or "")))), sha((t or "").replace("▁", " "))) for i, t in rows)
    assert pieces.encode(empty, MODEL, decode=True).count() == 0


def prose(rng, lang, n):
    syllables = {"en": ["the", "ing", "and", "tion", "wh", "ed"], "fr": ["eau", "eux", "ment", "oi", "é", "qu"], "de": ["sch", "ung", "ein", "ü", "keit", "ß"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang := rng.choice(["en", "fr", "de"]), rng.randint(5, 200)), lang) for i in range(300)]
    frame = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !!", "fr"), (902, "", None), (903, "\u0301", "fr"), (904, "\u093e \u0940", None), (None, "the and", "en")], "doc_id bigint, text string, lang string")
    model = languages.learn(frame.filter("doc_id % 5 <> 0 or doc_id >= 900"))
    got = {r.doc_id: r for r in languages.predict(frame, model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902, 903, 904)] == [("und", 0.0)] * 5
    assert all(0 <= r.score <= 1 for r in got.values())
    assert languages.predict(empty, model).count() == 0
    nothing = languages.learn(empty)
    assert {r.lang_pred for r in languages.predict(frame, nothing).collect()} == {"und"}


def test_language_mixture():
    rng = random.Random(8)
    grams = {lang: languages.trigrams([prose(rng, lang, 4000)])[0] for lang in ("de", "en", "fr")}
    table = np.stack([np.bincount(g, minlength=languages.BUCKETS) + 0.5 for g in grams.values()])
    model = languages.Languages(("de", "en", "fr"), np.log(table / table.sum(axis=1, keepdims=True)))
    pure, mixed = prose(rng, "fr", 400), prose(rng, "fr", 300) + " " + prose(rng, "de", 150)
    names, scores = languages.infer(model, [pure, mixed])
    assert names == ["fr", "fr"]
    assert scores[0] > 0.95 and 0.5 < scores[1] < 0.85


def proportions(model, text, use):
    """Expectation-maximisation for one text over the languages in ``use``, in plain Python: proportions and log-likelihood."""
    grams = Counter(languages.trigrams([text])[0].tolist())
    p = {g: [float(np.exp(model.log_p[j][g])) for j in use] for g in grams}
    share, total = [1 / len(use)] * len(use), sum(grams.values())
    for _ in range(languages.STEPS):
        gain = [0.0] * len(use)
        for g, n in grams.items():
            mix = sum(s * q for s, q in zip(share, p[g], strict=True))
            for j in range(len(use)):
                gain[j] += n * share[j] * p[g][j] / mix
        share = [x / total for x in gain]
    return share, sum(n * np.log(sum(s * q for s, q in zip(share, p[g], strict=True))) for g, n in grams.items()), total


def language_brute(model, text):
    """The choice of the set as stated: join in order of proportion, leave where the penalty is not earned."""
    k = len(model.names)
    whole, _, total = proportions(model, text, range(k))
    need = languages.PENALTY * np.log(total + 1)
    fits = lambda use: proportions(model, text, sorted(use))
    best = max(range(k), key=lambda j: fits({j})[1])
    chosen, now = {best}, fits({best})[1]
    for j in sorted(range(k), key=lambda j: (-whole[j], j)):
        if j not in chosen and fits(chosen | {j})[1] - now > need:
            chosen, now = chosen | {j}, fits(chosen | {j})[1]
    share = dict(zip(sorted(chosen), fits(chosen)[0], strict=True))
    for j in sorted(chosen, key=lambda j: (share[j], j)):
        if j in chosen and len(chosen) > 2 and now - fits(chosen - {j})[1] <= need:
            chosen, now = chosen - {j}, fits(chosen - {j})[1]
    share = dict(zip(sorted(chosen), fits(chosen)[0], strict=True))
    top = max(share, key=lambda j: (share[j], -j))
    return model.names[top], (total * share[top] + 1) / (total + min(languages.DOUBT, k))


def test_languages_match_brute_force():
    rng = random.Random(21)
    model, words = kin(rng)
    say = lambda w, n: rng.choices(words[w], k=n)
    texts = [" ".join(say(w, n)) for w in words for n in (1, 4, 30, 200)]
    texts += [" ".join(say("a", x) + say("b", y)) for x, y in ((5, 5), (40, 20), (100, 300))] + [" ".join(say("a1", 200) + say("a2", 150) + say("b", 100)), "xq zz", "a"]
    names, scores = languages.infer(model, texts)
    want = [language_brute(model, t) for t in texts]
    assert names == [w for w, _ in want]
    assert np.allclose(scores, [s for _, s in want], atol=1e-9)


def kin(rng):
    """A model of a language, three relatives that share most of its words, and a stranger; and words of each."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    stem = [word() for _ in range(60)]
    words = {"a": stem} | {f"a{i}": stem[:45] + [word() for _ in range(15)] for i in (1, 2, 3)} | {"b": [word() for _ in range(60)]}
    table = np.stack([np.bincount(languages.trigrams([" ".join(rng.choices(w, k=4000))])[0], minlength=languages.BUCKETS) + 0.5 for w in words.values()])
    return languages.Languages(tuple(words), np.log(table / table.sum(axis=1, keepdims=True))), words


def test_language_mixture_sees_every_language():
    rng = random.Random(11)
    model, words = kin(rng)
    # four languages explain it better alone than the one that fifteen in a hundred words are in
    texts = [" ".join(rng.choices(words["a"], k=850) + rng.choices(words["b"], k=150)) for _ in range(5)]
    names, scores = languages.infer(model, texts)
    assert names == ["a"] * 5 and all(0.8 < s < 0.9 for s in scores)
    # no part is lost among relatives: one third each
    names, scores = languages.infer(model, [" ".join(rng.choices(words["a1"], k=500) + rng.choices(words["a2"], k=500) + rng.choices(words["b"], k=600))])
    assert names == ["b"] and 0.32 < scores[0] < 0.43


def test_identified_rejects(spark):
    rng = random.Random(12)
    _, words = kin(rng)
    say = lambda w, n: " ".join(rng.choices(w, k=n))
    text = {f"{k}-{i}": (say(words[k], 200), k) for k in ("a", "b") for i in range(20)}
    # no label: none of these teach anything
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)]
    text |= {"junk": (say(junk, 200), None), "other script": (say(["привет", "мир", "слово", "жизнь", "город"], 200), None), "letterless": ("123 !!", None), "null": (None, None)}
    text |= {"mostly a": (say(words["a"], 150) + " " + say(junk, 50), None), "mostly junk": (say(words["a"], 40) + " " + say(junk, 160), None)}
    frame = spark.createDataFrame([(k, t, lang) for k, (t, lang) in text.items()], "name string, text string, lang string")
    got = {r.name for r in stages.identified(frame).collect()}
    assert got == {k for k in text if k[:2] in ("a-", "b-")} | {"mostly a"}


def test_word_vectors_match_brute_force(spark, docs, rows):
    """Sums of neighbours' index vectors by loops over words, and pooled means."""
    places, signs = quality.index_vectors()
    slot = lambda w: int(quality.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash[0] % np.uint64(quality.VOCABULARY))
    sums, split = np.zeros((quality.VOCABULARY, quality.DIMENSIONS)), [[slot(w) for w in (t or "").encode().split()] for _, t in rows]
    for doc in split:
        for i, w in enumerate(doc):
            for j in range(max(0, i - quality.REACH), min(len(doc), i + quality.REACH + 1)):
                if i != j:
                    for at, sign in zip(places[doc[j]], signs[doc[j]], strict=True):
                        sums[w, at] += sign
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    got = quality.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-6) and np.abs(got).sum() > 100
    pooled = {r.doc_id: np.array(r.x) for r in quality.pooled(docs, got).collect()}
    for (i, t), doc in zip(rows, split, strict=True):
        if i is not None and i < 200 and doc:
            assert np.allclose(pooled[i][: quality.DIMENSIONS], want[doc].mean(axis=0), atol=1e-5)
            assert abs(pooled[i][-2] - np.log1p(len(doc)) / 10) < 1e-6


def test_network_matches_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] > 0).astype(float)
    net = quality.fit(x, y)
    for row, score in zip(x[:20], net.scores(x[:20]), strict=True):
        hidden = [max(0.0, sum((row[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(5)) + net.b1[j]) for j in range(quality.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-9
    assert ((net.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_quality(spark, docs, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, "en", rng.randint(20, 120)) if good else rng.choice([prose(rng, "en", 30).upper() + "!!", " ".join([prose(rng, "en", 1)] * 40), prose(rng, "en", 40).replace(" ", "$$$ ")])
        rows.append((i, text))
        labels.append((i, int(good)))
    frame = spark.createDataFrame(rows + [(700, None), (None, "x")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.classify(frame, spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id bigint, quality int")).collect()}
    held = [(i, y) for i, y in labels if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    # a label that is repeated, and one that contradicts itself
    again = spark.createDataFrame(labels + labels[:50] + [(labels[0][0], 1 - labels[0][1])], "doc_id bigint, quality int")
    more = quality.classify(frame, again).collect()
    assert len(more) == 602 and sum(got[r.doc_id].predicted == r.predicted for r in more) > 590
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty, none).count() == 0


@pytest.mark.parametrize("most", [1 << 26, 64])
def test_bitmap_has_no_false_negative(spark, most):
    """With room for the bitmap, and, exactly, with none."""
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"))
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit("user's").alias("word"))
    told = maybe_in(rows.union(rows.filter("k = 6")), "k", keys, most=most)
    assert told.columns == ["k", "word", "maybe"] and told.count() == 3001
    assert told.filter("k % 3 = 0 and not maybe").count() == 0
    assert told.filter("k % 3 <> 0 and maybe").count() <= (100 if most > 64 else 0)


def test_pipeline(spark, docs, tmp_path, rows):
    """Each stage against its definition, on what the stage before it kept."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(x.columns == docs.columns for x in seen[1:-1])
    texts = [[r.text or "" for r in x.collect()] for x in seen[:-1]]
    assert not any(t.strip() == "" or not any(c.isalpha() for c in t) for t in texts[1])
    assert sorted(texts[2]) == sorted(set(texts[1]))
    assert set(texts[3]) <= set(texts[2]) and len(texts[3]) < len(texts[2])
    assert set(texts[4]) <= set(texts[3]) and max(Counter(texts[4]).values()) <= 2
    size = lambda ts: sum(len(t.encode().split()) for t in ts)
    assert abs(size(texts[4]) - 1.5 * size(texts[3])) <= max(len(t.split()) for t in texts[3])
    assert sorted(r.decoded for r in seen[-1].collect()) == sorted(texts[4])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.decoded for r in whole.collect()) == sorted(texts[4])


def test_pipeline_on_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(18)
    long = prose(rng, "en", 160_000)
    rows = [(1, long + " token=abcdefgh " + "f" * 30), (2, "y" * 1_500_000), (3, "AKIA" * 400_000), (4, prose(rng, "fr", 40))]
    frame = spark.createDataFrame([(i, t, "en" if i < 4 else "fr", "a") for i, t in rows], "doc_id bigint, text string, lang string, source string").repartition(2)
    got = secrets.digest(secrets.findings(frame, secrets.scan(frame))).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter((i, *secrets_brute(t)) for i, t in rows)
    assert {r.doc_id: r["size"] for r in mixing.mix(frame).collect()} == {i: len(t.split()) for i, t in rows}
    own = pieces.load(MODEL)
    encoded = {r.doc_id: r for r in pieces.encode(frame, MODEL, decode=True).collect()}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(encoded[i].ids == library.encode(t) == list(own.encode(t)) and encoded[i].decoded == t for i, t in rows)
    told = {r.doc_id: r.lang_pred for r in languages.predict(frame, languages.learn(frame)).collect()}
    assert told[1] == "en" and told[4] == "fr"
    scored = quality.classify(frame, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
