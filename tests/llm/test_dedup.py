import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpuslens.llm.common import cut_lineage, join_groups
from corpuslens.llm import exact_dedup, near, stages, substring_dedup, suffix_dedup


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, sha((t or "").encode())))
    return Counter(out)


def test_exact(docs, rows):
    assert Counter(map(tuple, exact_dedup.exact_classes(docs).collect())) == exact_brute(rows)


def test_exact_with_collisions(docs, rows):
    """A hash of two values: nearly all texts collide and only the bytes tell them apart."""
    weak = lambda text: F.substring(F.unhex(F.md5(text)), 1, 1).substr(1, 1).cast("binary")
    two = lambda text: F.when(F.hex(weak(text)) > "7F", F.lit(b"1")).otherwise(F.lit(b"2"))
    assert Counter(map(tuple, exact_dedup.exact_classes(docs, hasher=two).collect())) == exact_brute(rows)


def test_exact_plan_is_native(docs):
    plan = exact_dedup.exact_classes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_empty(empty):
    assert exact_dedup.exact_classes(empty).count() == 0


def substring_brute(rows, window=13):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


def test_substring(docs, rows):
    got = substring_dedup.remove_repeats(docs)
    assert Counter(map(tuple, got.collect())) == substring_brute(rows)
    assert sum(r.n_removed for r in got.collect()) > 500


def test_substring_other_window_and_text(docs, rows):
    got = substring_dedup.remove_repeats(docs, window=9, with_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == substring_brute(rows, 9)
    assert all(sha(r.kept_text.encode()) == r.kept_sha256 for r in got)


def test_substring_extreme_ids(spark):
    line = " ".join(f"w{k}" for k in range(20))
    rows = [(-(2**63), line), (5, "x " + line), (2**63 - 1, line + " y"), (None, line), (0, line + " z")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(map(tuple, got)) == substring_brute(rows)
    assert {r.doc_id: r.n_removed for r in got}[-(2**63)] == 0


def test_substring_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_cover_has_every_shift():
    d, p = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % p for a in d for b in d} == set(range(p))


def suffix_brute(rows, length=200):
    times = Counter()
    for _, t in rows:
        b = (t or "").encode()
        times.update(hash(b[k : k + length]) for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if times[hash(b[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


def test_suffix(docs, rows):
    got = suffix_dedup.remove_repeats(docs)
    assert Counter(map(tuple, got.collect())) == suffix_brute(rows)


def test_suffix_boundaries(spark):
    """Matches of 199, 200 and 201 bytes, at text ends, overlapping themselves, and with both sides different."""
    import random

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = noise(420)
    texts = [noise(50) + core[:199] + noise(30), noise(70) + core[:199] + "é", core[100:300], noise(5) + core[100:300] + noise(400), core[:201], "z" + core[:201], core[200:420] + noise(3)]
    texts += [noise(300) + core[210:420], "ab" * 150, "c" * 200, "d" * 201, "e" * 199, noise(1000), "😀" * 60 + noise(9), "x" + "😀" * 60]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert Counter(map(tuple, suffix_dedup.remove_repeats(frame).collect())) == suffix_brute(rows)


def test_suffix_empty(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_quicksort():
    import numpy as np

    rows = np.random.default_rng(1).integers(0, 3, (500, 16)).astype(np.uint8)
    rows[:, 2:14] = 0
    order, group = suffix_dedup.multikey_quicksort(rows)
    keys = [rows[i].tobytes() for i in order]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:], strict=False)] == [a == b for a, b in zip(group, group[1:], strict=False)]


def near_brute(texts):
    """The definition: id -> (rep_id, class_id, n_links)."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    near_ = {i: [j for j in texts if j != i and sets[i] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])] for i in texts}
    root = {}
    for i in sorted(texts):
        todo = [i] if i not in root else []
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += near_[k]
    rep = {}
    for i in sorted(texts):
        rep.setdefault(texts[i] or "", i)
    return {i: (rep[texts[i] or ""], root[i] if sets[i] else rep[texts[i] or ""], len(near_[i])) for i in texts}


def near_rows(rows):
    """One row an id, as the brute-force version is keyed by it."""
    return [(i, t) for i, t in dict(rows).items() if i is not None]


def test_near(spark, rows):
    rows = near_rows(rows)
    brute = near_brute(dict(rows))
    got = near.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in got} == brute
    assert sum(b[2] > 0 for b in brute.values()) >= 10


def test_near_with_null_and_repeated_ids(docs, rows):
    got = near.classes(docs).collect()
    assert len(got) == len(rows)
    copies = [r for r in got if r.doc_id == 300]
    assert len(copies) == 2 and all(r.n_links == 1 and r.class_id == 300 for r in copies)


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.range(4000).select((F.when(F.col("id") < 1500, 7).otherwise(F.col("id"))).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.when(F.min("id") > 0, F.min("id")).alias("least"))
    got = join_groups(rows, groups, "k", "n")
    assert got.count() == 4000 and got.filter("k = 7").select("n", "least").distinct().collect() == [(1500, None)]
    assert got.filter("k <> 7 and (n <> 1 or least <> id)").count() == 0


def test_near_large_group(spark):
    """Hundreds of different near copies of one text: linear edges, exact links."""
    import random

    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(150)] = f"e{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    brute = near_brute(dict(rows))
    for block in (near.BLOCK, 64):
        got = near.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), block).collect()
        assert {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in got} == brute


def test_near_blocks_by_bytes(spark, rows):
    rows = near_rows(rows)
    got = near.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 4096, 3000).collect()
    assert {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in got} == near_brute(dict(rows))


def test_near_empty(empty):
    assert near.classes(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 30), (30, 25), (25, 21), (4, 1), (5, 5)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 20, 30: 20, 25: 20, 21: 20}


def test_stage_keeps_one_of_each(docs, rows):
    kept = cut_lineage(stages.without_copies(docs))
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    classes = near.classes(kept)
    again = stages.without_near_copies(kept)
    assert again.count() == classes.select("class_key").distinct().count()


def test_stages_keep_clashing_columns(spark):
    """Columns named as anything inside are neither lost nor changed."""
    rows = [(i, f"text number {i % 7} of a few words more", f"r{i}", f"n{i}", i, i % 2 == 0, 1.5, f"s{i}") for i in range(20)]
    names = "doc_id bigint, text string, `row` string, name string, word__ int, maybe boolean, times double, sha string"
    docs = spark.createDataFrame(rows, names)
    for stage, n in ((stages.without_copies, 7), (stages.without_near_copies, 7), (stages.mixed, None)):
        got = stage(docs.withColumn("source", F.lit("a")) if n is None else docs).collect()
        assert n is None or len(got) == n
        assert {tuple(r)[:8] for r in got} <= set(rows) and got[0].__fields__[:8] == docs.columns


def test_stage_of_near_copies_matches_brute_force(spark, rows):
    rows = near_rows(rows)
    brute = near_brute(dict(rows))
    got = stages.without_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    # of each class the smallest id; a text without words is a class of its copies
    assert sorted(r.doc_id for r in got) == sorted({class_id for _, class_id, _ in brute.values()})


def test_very_long_texts(spark):
    """Texts of megabytes among short ones, each operator against its definition."""
    import random

    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    long = prose(200_000)
    edited = list(long)
    for k in range(0, len(edited), 997):
        edited[k] = "edited"
    rows = [(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(prose(500) + long[100_000:150_000])), (4, "x" * 2_000_000), (5, " ".join(long)), (6, " ".join(long[70:110]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert min(len(t) for _, t in rows[:2]) > 1_000_000
    assert Counter(map(tuple, exact_dedup.exact_classes(frame).collect())) == exact_brute(rows)
    assert Counter(map(tuple, substring_dedup.remove_repeats(frame).collect())) == substring_brute(rows)
    assert {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in near.classes(frame).collect()} == near_brute(dict(rows))
    small = [(i, t[: 1 << 20]) for i, t in rows if i != 4] + [(4, "x" * 300)]
    assert Counter(map(tuple, suffix_dedup.remove_repeats(spark.createDataFrame(small, "doc_id bigint, text string")).collect())) == suffix_brute(small)
