"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a text of one to four words is one shingle); copies of a text are one node. Nodes that agree in a band
of MinHash values meet; their signatures are compared a few values at a time, and a pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below TOLERANCE. The pairs left give candidate components (each node searches among
those that none has reached, so a group of n near copies costs about n comparisons, not n squared, and yields n - 1 edges).
Within a component every pair is verified by its shingles (64-bit hashes of five words, so a component with a million of them counts one
wrongly with a probability of 3e-8): shared ones are counted by products of 0/1 matrices, block by block. No pair is ever a row. A pair at the threshold is missed with a probability below 1e-7 (32 bands of 4: 0.59 ** 32), pruning adds about TOLERANCE.

Copies, that is texts of one SHA-256, are merged before texts or signatures are shuffled, so they may be any number. A component of more
than BLOCK texts or BLOCK_BYTES bytes is verified in pairs of blocks, each a group of its own. The signatures (136 bytes each) of different texts that agree in one band must fit a task.

Defined results: null text and text without words have no shingles and no links, each a class of its copies; class_id and rep_id are the
smallest ids, null if there is none; ids are read as bigint (one that can't be fails the job, as a cast does); rows that repeat an id and its text are copies; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import buckets, cut_lineage, dealt, join_groups, lean, lean_group, maybe_in, mix64, text_or_empty
from corpuslens.llm.spans import PACKED, SLICE_BYTES, Words, bucket_of, counts, flat, lists, per_document, slices, text_buffers
from corpuslens.llm.substring_dedup import MESSAGE, ask, live_keys

N, NUMERATOR, DENOMINATOR = 5, 4, 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEPS, TOLERANCE = (16, 32, 64, HASHES), 1e-7
MATRIX_ROWS = 1024
#: Texts of a component that are verified together, and their bytes.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
_FACTORS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document of a slice: hashes, and document numbers in rising order."""
    full, ok = words.windows(N), words.valid(N)
    value, doc = full[ok], words.doc[: len(full)][ok]
    size = np.diff(words.first)
    for n in range(1, N):
        few = np.flatnonzero(size == n)
        if len(few):
            value = np.r_[value, words.windows(n)[words.first[few]] + np.uint64(n)]
            doc = np.r_[doc, few]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    return value[new], doc[new]


def signatures(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with shingles, and their HASHES minimal values."""
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    out = np.empty((len(heads), HASHES), np.uint64)
    if len(heads):
        for k, factor in enumerate(_FACTORS):
            out[:, k] = np.minimum.reduceat(value * factor, heads)
    return doc[heads], out


def band_keys(mins: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(mins), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = mix64(acc * np.uint64(0xD1342543DE82EF95) + mins[:, k::ROWS])
    return acc


@lru_cache(1)
def least_matches() -> dict[int, int]:
    """After so many byte comparisons, the fewest matches at which the threshold is still likelier than TOLERANCE (flat prior)."""
    s = np.linspace(0, 1, 4001)
    p = s + (1 - s) / 256  # bytes agree by chance
    high = s >= NUMERATOR / DENOMINATOR
    out = {}
    for n in STEPS:
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log(np.maximum(1 - p, 1e-300))
            weight = np.exp(log - log.max())
            if weight[high].sum() / weight.sum() >= TOLERANCE:
                out[n] = m
                break
    return out


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` (n, HASHES) may be as similar as the threshold to ``a`` (one row, or n)."""
    left = np.arange(len(b))
    matches, done = np.zeros(len(b), np.int64), 0
    for n in STEPS:
        x = a[done:n] if a.ndim == 1 else a[left, done:n]
        matches[left] += (b[left, done:n] == x).sum(axis=1)
        left = left[matches[left] >= least_matches()[n]]
        done = n
    out = np.zeros(len(b), bool)
    out[left] = True
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keys = batch.column("key").to_pylist()
        data, off = text_buffers(batch.column("t"))
        for i, j in slices(off):
            fresh = {}
            for k in range(i, j):
                if keys[k] not in seen:
                    fresh.setdefault(keys[k], k - i)
            seen.update(fresh)
            if len(seen) > 100_000:
                seen.clear()
            doc, mins = signatures(*shingles(Words(data[off[i] : off[j]], off[i : j + 1] - off[i])))
            at = np.flatnonzero(np.isin(doc, np.fromiter(fresh.values(), np.int64, len(fresh))))
            sig = (mix64(mins[at]) & np.uint64(255)).astype(np.uint8)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(mins[at]).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i + d] for d in doc[at].tolist()], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), bands], ["key", "sig", "bands"])


def _ask_bands(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from ask([flat(batch.column("bands")).view(np.uint64)], [np.repeat(batch.column("ck").to_numpy(), BANDS)], n_buckets)

    return run


GROUPS = "bucket int, keys array<bigint>, cks array<bigint>, sigs binary"
EDGES = "a bigint, b bigint"


def _meet(n_buckets: int):
    """Sends each signature to where the nodes of each of its live bands meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                batch = big.slice(lo, 2048)
                keys, n = flat(batch.column("keys")), counts(batch.column("keys"))
                row = np.repeat(np.arange(batch.num_rows), n)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
                to = bucket_of(keys, n_buckets)
                order = np.argsort(to, kind="stable")
                heads, (k, c) = lists(to, keys, batch.column("ck").to_numpy()[row])
                ends = np.r_[np.flatnonzero(np.r_[True, np.diff(to[order]) != 0]), len(order)]
                packed = [sig[row[order[a:b]]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(heads.astype(np.int32)), k, c, pa.array(packed, pa.binary())], ["bucket", "keys", "cks", "sigs"])

    return run


def _edges(table: pa.Table) -> pa.Table:
    """A spanning forest of the likely pairs of each band."""
    keys, cks = flat(table.column("keys")), flat(table.column("cks"))
    sigs = np.frombuffer(b"".join(table.column("sigs").to_pylist()), np.uint8).reshape(-1, HASHES)
    order = np.lexsort((cks, keys))
    new = np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(cks[order]) != 0)] if len(keys) else np.zeros(0, bool)
    order = order[new]
    keys, cks, sigs = keys[order], cks[order], sigs[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(keys)])
    two = head[size == 2]
    ok = likely(sigs[two], sigs[two + 1]) if len(two) else np.zeros(0, bool)
    a, b = [cks[two[ok]]], [cks[two[ok] + 1]]
    for h, n in zip(head[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        ids, sig = cks[h : h + n], sigs[h : h + n]
        rest, queue = np.arange(1, n), [0]
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
                continue
            at = queue.pop()
            hit = likely(sig[at], sig[rest])
            found = rest[hit]
            a.append(np.full(len(found), ids[at]))
            b.append(ids[found])
            queue += found.tolist()
            rest = rest[~hit]
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is connected with), by alternating large and small stars."""
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_groups(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_groups(large, least, "u", "n").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", "m")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _linked(grams: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the members of a component: the first member that each is connected with by links, and how many documents each is linked to.
    With ``side`` (0 or 1 for each) only links between the sides count."""
    n = len(grams)
    size = np.array([len(g) for g in grams])
    _, word, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = times[word] > 1
    width = int((times > 1).sum())
    number = np.cumsum(times > 1) - 1
    word, owner = number[word[shared]], owner[shared]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    parent, links = np.arange(n), np.zeros(n, np.int64)

    def rows(lo: int, hi: int) -> np.ndarray:
        m = np.zeros((hi - lo, width), np.float32)
        part = slice(bounds[lo], bounds[hi])
        m[owner[part] - lo, word[part]] = 1
        return m

    step = max(1, min(MATRIX_ROWS, (16 << 20) // (4 * max(1, width))))
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        left = rows(lo, hi)
        for lo2 in range(lo, n, step):
            hi2 = min(lo2 + step, n)
            both = (left @ (left if lo2 == lo else rows(lo2, hi2)).T).astype(np.int64)
            near = (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (size[lo:hi, None] + size[None, lo2:hi2])
            if side is not None:
                near &= side[lo:hi, None] != side[None, lo2:hi2]
            if lo2 == lo:
                np.fill_diagonal(near, False)
            links[lo:hi] += near @ copies[lo2:hi2]
            if lo2 > lo:
                links[lo2:hi2] += copies[lo:hi] @ near
            i, j = np.nonzero(near)
            i, j = i + lo, j + lo2
            while len(i):
                pi, pj = parent[i], parent[j]
                apart = pi != pj
                i, j, pi, pj = i[apart], j[apart], pi[apart], pj[apart]
                np.minimum.at(parent, np.maximum(pi, pj), np.minimum(pi, pj))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
    return parent, links


def _verify(table: pa.Table) -> pa.Table:
    """Exact links within each component, or between two blocks of one: ck, the first member it is connected with here, links found here."""
    table = table.sort_by([("root", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("ck", "ascending")]).combine_chunks()
    data, off = text_buffers(table.column("t"))
    grams: list[np.ndarray] = []
    for i, j in slices(off, SLICE_BYTES):
        value, doc = shingles(Words(data[off[i] : off[j]], off[i : j + 1] - off[i]))
        grams += np.split(value, np.searchsorted(doc, np.arange(1, j - i)))
    root, copies, block, low, high = (table.column(c).to_numpy() for c in ("root", "copies", "block", "lo", "hi"))
    ck, links = table.column("ck").to_numpy(), np.zeros(table.num_rows, np.int64)
    group = ck.copy()
    head = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(root) else []
    for lo, hi in zip(head, [*head[1:], len(root)], strict=True):
        side = (block[lo:hi] == high[lo]).astype(np.int8) if low[lo] != high[lo] else None
        parent, links[lo:hi] = _linked(grams[lo:hi], copies[lo:hi], side)
        group[lo:hi] = ck[lo + parent]
    return pa.table({"ck": pa.array(ck), "grp": pa.array(group), "links": pa.array(links), "split": table.column("split")})


def verified(members: DataFrame, n: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ck, grp, links of the members (root, ck, copies, t) of candidate components. A component of more than ``block`` texts or ``block_bytes``
    bytes is dealt to pairs of blocks, each a task's group; their links are added, and what they connect is connected by components of a
    spanning forest. Smaller components of a bucket are worked on together."""
    size = members.groupBy("root").agg(F.count("*").alias("size"), F.sum(F.octet_length("t")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    split = members.join(size, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("ck"), F.col("blocks")).cast("int"))
    pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    bucket = F.pmod(F.xxhash64("root", lo, hi), F.lit(n)).cast("int")
    asked = pairs.select(bucket.alias("bucket"), "root", lo.alias("lo"), hi.alias("hi"), (F.col("blocks") > 1).alias("split"), "block", "ck", "copies", "t")
    told = cut_lineage(dealt(asked, "bucket", n, "lo", "hi").applyInArrow(lean_group(_verify), "ck bigint, grp bigint, links bigint, split boolean"))
    whole = told.filter("not split").select("ck", "grp", "links")
    parts = told.filter("split")
    joined = components(parts.select(F.col("ck").alias("a"), F.col("grp").alias("b")))
    added = parts.groupBy("ck").agg(F.sum("links").alias("links")).join(joined, F.col("ck") == F.col("node"), "left")
    return whole.union(added.select("ck", F.coalesce("root", "ck").alias("grp"), "links"))


def classes(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, rep_id (smallest id of its copies), class_id (smallest id of its near-duplicate class), n_links (other
    documents whose similarity is at the threshold or more, copies counted), text_key (SHA-256 of the text), class_key (that of class_id)."""
    n = buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("t")).withColumn("key", F.unhex(F.sha2("t", 256)))
    texts = cut_lineage(rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    # a text's number, by which messages name it, is its place in a written table
    signed = cut_lineage(rows.select("key", "t").mapInArrow(lean(_sign), "key binary, sig binary, bands array<bigint>").dropDuplicates(["key"])).withColumn("ck", F.monotonically_increasing_id())
    live = per_document(dealt(signed.select("ck", "bands").mapInArrow(lean(_ask_bands(n)), MESSAGE), "bucket", n).applyInArrow(lean_group(live_keys(n)), PACKED), "keys", n)
    # a merge join, since a broadcast one would put two Python nodes, and so two workers a core, into one stage
    met = signed.select("ck", "sig").join(live.hint("merge"), F.col("ck") == F.col("did")).select("ck", "sig", "keys").mapInArrow(lean(_meet(n)), GROUPS)
    found = components(dealt(met, "bucket", n).applyInArrow(lean_group(_edges), EDGES))
    nodes = cut_lineage(signed.select("key", "ck").join(found, F.col("ck") == F.col("node")).join(texts, "key").select("key", "ck", "root", "copies"))

    doubtful = maybe_in(rows.select("key", "t"), "key", nodes.select("key")).filter("maybe")
    members = doubtful.groupBy("key").agg(F.first("t").alias("t")).join(nodes, "key")
    told = cut_lineage(verified(members.select("root", "ck", "copies", "t"), n, block, block_bytes))
    linked = cut_lineage(told.join(nodes.select("ck", "key"), "ck").join(texts, "key").select("grp", "key", "rep", "links"))
    first = F.min(F.struct(F.col("rep").isNull().alias("null"), "rep", "key"))
    least = linked.groupBy("grp").agg(first.alias("least"), F.count("*").alias("n"))
    # a class may hold any share of the texts
    classed = join_groups(linked.select("grp", "key", "links"), least, "grp", "n").select("key", "least", "links")
    by_text = cut_lineage(texts.join(classed, "key", "left").join(_wordless(rows), "key", "left"))
    links = F.when(F.col("none"), 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    return (
        join_groups(rows.select("id", "key"), by_text, "key", "copies")
        .withColumn("none", F.coalesce("none", F.lit(False)))
        .withColumn("least", F.coalesce("least", F.struct(F.col("rep").isNull().alias("null"), "rep", "key")))
        .select(F.col("id").alias("doc_id"), F.col("rep").alias("rep_id"), F.col("least.rep").alias("class_id"), links.alias("n_links"), F.col("key").alias("text_key"), F.col("least.key").alias("class_key"))
    )


def _wordless(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("t").rlike(r"[^\x20\x09-\x0D]")).select("key").distinct().withColumn("none", F.lit(True))
