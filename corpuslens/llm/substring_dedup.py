"""Substring dedup over words, by difference-cover anchors.

A window of 13 words that two documents share need not start at like places. But of any 7 consecutive places, for any shift between the
documents, one is at a cover place (0, 1 or 3 modulo 7) of both; a run of 7 words from there lies in the window. So each document hashes
only the 7-word runs at its cover places, 3 of 7. Runs seen in two documents or more are live; each document extends its live runs to
the windows of 13 words that hold one, and these, few, are compared exactly (96 bits) for the smallest document they start in.

Defined results: null text has no words; ids are read as bigint (one that can't be fails the job, as a cast does); a document with null id keeps all words and takes none from others; rows that repeat an id take
nothing from each other; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import buckets, cut_lineage, dealt, lean, lean_group, maybe_in, text_or_empty
from corpuslens.llm.spans import PACKED, Words, bucket_of, counts, flat, lists, pack, per_document, slices, spread, tagged, text_buffers

#: A perfect difference set: each shift modulo PERIOD is a difference of two of its places.
PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
FLUSH = 1 << 20
ASK, SEEN, TOLD = 0, 1, 2
MESSAGE = "bucket int, kind int, keys array<bigint>, more array<int>, docs array<bigint>"


def _slices_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    data, off = text_buffers(batch.column("t"))
    for i, j in slices(off):
        yield i, j, data, Words(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _message(kind: int, bucket: np.ndarray, keys: np.ndarray, more: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    by = np.argsort(docs, kind="stable")  # runs of a document compress well
    bucket, keys, more, docs = bucket[by], keys[by], more[by], docs[by]
    heads, columns = lists(bucket, keys.view(np.int64), more.astype(np.int32), docs)
    return pa.RecordBatch.from_arrays([pa.array(heads.astype(np.int32)), pa.array(np.full(len(heads), kind, np.int32)), *columns], ["bucket", "kind", "keys", "more", "docs"])


def _anchors(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in the slice, and their keys."""
    at = np.flatnonzero(words.valid(length) & np.isin(words.nth[: max(0, len(words.hash) - length + 1)] % PERIOD, COVER))
    return at, words.windows(length)[at]


def ask(keys: list[np.ndarray], docs: list[np.ndarray], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Messages that ask which of the keys other documents have too. Keys that two documents here share are live without asking."""
    k, d = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((d, k))
    k, d = k[order], d[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
    k, d = k[new], d[new]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[head, len(k)])
    shared = np.repeat(size > 1, size)
    for kind, kk, dd in ((ASK, k[~shared], d[~shared]), (SEEN, k[head[size > 1]], np.zeros(int((size > 1).sum()), np.int64)), (TOLD, k[shared], d[shared])):
        if len(kk):
            yield _message(kind, bucket_of(kk if kind != TOLD else dd * np.int64(-7046029254386353131), n_buckets), kk, np.zeros(len(kk), np.int32), dd)


def _send_anchors(n_buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column("did").to_numpy(zero_copy_only=False)
            for i, _, _, words in _slices_of(batch):
                at, k = _anchors(words, length)
                keys.append(k)
                docs.append(ids[i + words.doc[at]])
                held += len(k)
                if held >= FLUSH:
                    yield from ask(keys, docs, n_buckets)
                    keys, docs, held = [], [], 0
        if held:
            yield from ask(keys, docs, n_buckets)

    return run


def _of_kind(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = table.filter(pc.equal(table.column("kind"), kind))
    return flat(rows.column("keys")), flat(rows.column("more")), flat(rows.column("docs"))


def live_keys(n: int):
    """Answers to the asking documents whose key another batch has too, and what was told before."""

    def run(table: pa.Table) -> pa.Table:
        return _live(table, n)

    return run


def _live(table: pa.Table, n: int) -> pa.Table:
    k, _, d = _of_kind(table, ASK)
    seen, _, _ = _of_kind(table, SEEN)
    told, _, to = _of_kind(table, TOLD)
    order = np.argsort(k, kind="stable")
    k, d = k[order], d[order]
    same = k[1:] == k[:-1]
    live = np.r_[False, same] | np.r_[same, False] if len(k) else np.zeros(0, bool)
    live |= np.isin(k, seen)
    return pack(np.r_[d[live], to], np.r_[k[live], told], n)


def _send_windows(n_buckets: int, window: int, length: int):
    def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, m, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((d, m, k))
        k, m, d = k[order], m[order], d[order]
        head = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]
        new = head | np.r_[True, d[1:] != d[:-1]]
        least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
        later = new & (d > least)
        yield _message(ASK, bucket_of(k[head], n_buckets), k[head], m[head], d[head])
        if later.any():
            yield _message(TOLD, bucket_of(d[later] * np.int64(-7046029254386353131), n_buckets), k[later], m[later], d[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("did").to_numpy(zero_copy_only=False)
            live, n_live = flat(batch.column("keys")), counts(batch.column("keys"))
            upto = np.r_[0, np.cumsum(n_live)]
            for i, j, _, words in _slices_of(batch):
                at, k = _anchors(words, length)
                mine = tagged(live[upto[i] : upto[j]], np.repeat(np.arange(j - i), n_live[i:j]))
                at = at[np.isin(tagged(k, words.doc[at]), mine)]
                n = max(0, len(words.hash) - window + 1)
                holds = np.zeros(n + 1, np.int32)
                np.add.at(holds, np.clip(at - (window - length), 0, n), 1)
                np.add.at(holds, np.clip(at + 1, 0, n), -1)
                w = np.flatnonzero((np.cumsum(holds[:n]) > 0) & words.valid(window))
                parts.append((words.windows(window)[w], (words.windows(window, 0x2545F4914F6CDD1D)[w] >> np.uint64(33)).astype(np.int32), ids[i + words.doc[w]]))
                held += len(w)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def later_keys(n: int):
    """Answers to the documents with a window that a smaller id has too."""

    def run(table: pa.Table) -> pa.Table:
        return _later(table, n)

    return run


def _later(table: pa.Table, n: int) -> pa.Table:
    k, m, d = _of_kind(table, ASK)
    told, _, to = _of_kind(table, TOLD)
    order = np.lexsort((d, m, k))
    k, m, d = k[order], m[order], d[order]
    head = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])] if len(k) else np.zeros(0, bool)
    later = d > d[np.flatnonzero(head)][np.cumsum(head) - 1] if len(k) else head
    return pack(np.r_[d[later], to], np.r_[k[later], told], n)


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("t"))
            texts = memoryview(data)
            split = [bytes(texts[off[r] : off[r + 1]]).split() for r in range(batch.num_rows)]
            total = [len(x) for x in split]
            keys = batch.column("keys")
            n_keys = np.where(keys.is_valid().to_numpy(zero_copy_only=False), counts(keys), 0)
            rows = np.flatnonzero(n_keys)
            if len(rows):
                some = pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(rows))], ["t"])
                gone = flat(keys.take(pa.array(rows)))
                upto = np.r_[0, np.cumsum(n_keys[rows])]
                for i, j, _, words in _slices_of(some):
                    mine = tagged(gone[upto[i] : upto[j]], np.repeat(np.arange(j - i), n_keys[rows[i:j]]))
                    n = max(0, len(words.hash) - window + 1)
                    hit = np.isin(tagged(words.windows(window), words.doc[:n]), mine) & words.valid(window)
                    keep = ~spread(np.flatnonzero(hit), window, len(words.hash))
                    for r in range(i, j):
                        mask = keep[words.first[r - i] : words.first[r - i + 1]]
                        split[rows[r]] = [x for x, y in zip(split[rows[r]], mask.tolist(), strict=True) if y]
            kept = [b" ".join(x) for x in split]
            out = [batch.column("did"), pa.array(total, pa.int64()), pa.array([a - len(x) for a, x in zip(total, split, strict=True)], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            if with_text:
                out.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["did", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; and kept_text if asked for. ``window`` is at least PERIOD."""
    length, n = window - PERIOD + 1, buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("did"), text_or_empty().alias("t"))

    def answers(sent: DataFrame, rule) -> DataFrame:
        return per_document(dealt(sent, "bucket", n).applyInArrow(lean_group(rule), PACKED), "keys", n)

    live = cut_lineage(answers(rows.filter("did is not null").mapInArrow(lean(_send_anchors(n, length)), MESSAGE), live_keys(n)))
    # texts without live anchors are not moved
    flagged = maybe_in(rows, "did", live.select("did"))
    doubtful = F.col("maybe") & F.col("did").isNotNull()
    some, others = flagged.filter(doubtful).drop("maybe"), flagged.filter(~doubtful).drop("maybe")
    gone = answers(some.join(live, "did").mapInArrow(lean(_send_windows(n, window, length)), MESSAGE), later_keys(n))
    told = some.join(gone, "did", "left").unionByName(others.withColumn("keys", F.lit(None).cast("array<bigint>")))
    kept = told.mapInArrow(lean(_cut(window, with_text)), "did bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)
    return kept.withColumnRenamed("did", "doc_id")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS gram FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE least < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
