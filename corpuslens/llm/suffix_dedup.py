"""Suffix-array dedup over bytes: remove what a 200-byte string covers that also starts elsewhere.

A sparse suffix array stands for the full one. Of any GAP starts in a row the one with the least hash of its 16 bytes is sampled,
which depends on bytes alone, so two equal strings of 200 bytes share a sampled suffix within GAP bytes from their start, followed by
KEY more equal bytes. Sampled suffixes whose KEY bytes occur once, as a hash of them shows, are left out; this is all that hashes decide.

The others are sent with their context (GAP-1 bytes before, 200 after). A context that a batch has twice, by its bytes, settles all strings in
it there and is sent once, without its places, so a hot passage costs a row for each batch. Splitters sampled from these
suffixes range-partition them by their leading bytes, and a bucket sorts its suffixes by multikey quicksort on words of eight bytes. A
splitter is a prefix, so suffixes with equal KEY bytes never stand on two sides of a boundary and there is nothing left to compare
across it. In a run of equal KEY bytes the string that starts k bytes before a suffix has k bytes on its left and 200-k on its right. Runs
are parted into classes of equal left sides and of equal right sides, a byte at a time, and a string starts elsewhere exactly if
another suffix, or a copy of its context, is in both of its classes.

Rows are named by 64 bits of id and text; among n documents some n*n / 2^65 pairs share a name, and such a pair may lose bytes wrongly.

Defined results: null text is empty; null and repeated ids are separate documents (a repeated row repeats its strings); an empty table
gives no rows; other columns are not looked at. Removed bytes may end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import buckets, cut_lineage, dealt, lean, lean_group, maybe_in, mix64, text_or_empty
from corpuslens.llm.spans import PACKED, bucket_of, counts, flat, lists, pack, per_document, powers, prefix_hash, runs, slices, text_buffers

LENGTH, GAP, GRAM = 200, 104, 16
KEY = LENGTH - GAP
#: Bytes of a suffix that splitters look at, and how many suffixes are sampled for each bucket.
LEAD, SAMPLES = 24, 8
FLUSH = 1 << 19
ASK, SEEN, TOLD = 0, 1, 2
MESSAGE = "bucket int, kind int, keys array<bigint>, rids array<bigint>, ats array<bigint>"
SUFFIX = "part int, ctx binary, n_left int, copies int, rids array<bigint>, vals array<bigint>"


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each ``width`` values in a row."""
    step, out = 1, x
    while step * 2 <= width:
        out = best(out[:-step], out[step:])
        step *= 2
    return best(out[: len(out) - (width - step)], out[width - step :]) if width > step else out


def sampled(data: np.ndarray, off: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Places of the sampled suffixes of the documents in a slice."""
    n, inverse = len(data), powers(len(data) + 1)[1]
    if n < LENGTH:
        return np.zeros(0, np.int64)
    gram = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    least = _slide(gram, GAP, np.minimum)[: n - LENGTH + 1].copy()
    for end in off[1:-1]:  # strings that would cross into the next document
        least[max(0, end - LENGTH + 1) : end] = 0
    pad = np.zeros(GAP - 1, np.uint64)
    reach = _slide(np.concatenate([pad, least, pad]), GAP, np.maximum)
    return np.flatnonzero(gram[: len(reach)] == reach[: len(gram)])


def _send(n_buckets: int):
    """Asks which sampled suffixes have KEY bytes that occur elsewhere too. Those that occur twice in a batch need no asking."""

    def message(kind, bucket, keys, rids, ats):
        heads, columns = lists(bucket, keys.view(np.int64), rids, ats)
        return pa.RecordBatch.from_arrays([pa.array(heads.astype(np.int32)), pa.array(np.full(len(heads), kind, np.int32)), *columns], ["bucket", "kind", "keys", "rids", "ats"])

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        k, r, a = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((a, r, k))
        k, r, a = k[order], r[order], a[order]
        head = np.r_[True, k[1:] != k[:-1]]
        first = np.flatnonzero(head)
        size = np.diff(np.r_[first, len(k)])
        twice = np.repeat(size > 1, size)
        yield message(ASK, bucket_of(k[~twice], n_buckets), k[~twice], r[~twice], a[~twice])
        if twice.any():
            seen = k[first[size > 1]]
            nil = np.zeros(len(seen), np.int64)
            yield message(SEEN, bucket_of(seen, n_buckets), seen, nil, nil)
            yield message(TOLD, bucket_of(r[twice], n_buckets), np.zeros(int(twice.sum()), np.uint64), r[twice], a[twice])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, off = text_buffers(batch.column("t"))
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                part, ends = data[off[i] : off[j]], off[i : j + 1] - off[i]
                sums = prefix_hash(part)
                at = sampled(part, ends, sums)
                doc = np.searchsorted(ends, at, "right") - 1
                parts.append((mix64((sums[at + KEY] - sums[at]) * powers(len(part) + 1)[1][at]), rids[i + doc], at - ends[doc]))
                held += len(at)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def live(n: int):
    """The places in each document of the suffixes whose KEY bytes occur twice."""

    def run(table: pa.Table) -> pa.Table:
        of = lambda kind: [flat(rows.column(x)) for rows in (table.filter(pc.equal(table.column("kind"), kind)),) for x in ("keys", "rids", "ats")]
        (k, r, a), (seen, _, _), (_, to, told) = of(ASK), of(SEEN), of(TOLD)
        order = np.argsort(k, kind="stable")
        k, r, a = k[order], r[order], a[order]
        same = k[1:] == k[:-1]
        twice = (np.r_[False, same] | np.r_[same, False] if len(k) else np.zeros(0, bool)) | np.isin(k, seen)
        return pack(np.r_[r[twice], to], np.r_[a[twice], told], n)

    return run


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row of the batch, and place in its text, of each suffix."""
    return np.repeat(np.arange(batch.num_rows), counts(batch.column("ats"))), flat(batch.column("ats"))


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffers(batch.column("t"))
        doc, at = _places(batch)
        view = memoryview(data)
        yield pa.RecordBatch.from_arrays([pa.array([bytes(view[p : p + LEAD]) for p in (off[doc] + at).tolist()], pa.binary())], ["lead"])


def _splitters(rows: DataFrame, found: DataFrame, n_buckets: int) -> np.ndarray:
    """Leading bytes of suffixes at every so many-th place of the sorted sample: SAMPLES for each bucket or so reach the driver."""
    total = found.agg(F.sum(F.size("ats"))).first()[0] or 0
    share = min(1.0, SAMPLES * n_buckets / max(1, total))
    sample = found.withColumn("ats", F.filter("ats", lambda at: F.pmod(F.xxhash64("rid", at), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).filter(F.size("ats") > 0)
    leads = sorted(r.lead for r in maybe_in(rows, "rid", sample.select("rid")).filter("maybe").join(sample, "rid").select("t", "ats").mapInArrow(_leads, "lead binary").collect())
    picked = [bytes(leads[len(leads) * i // n_buckets]) for i in range(1, n_buckets)] if leads else []
    return np.unique(np.array(picked or [b""], dtype=f"S{LEAD}"))


def _bits(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all strings in contexts, in two halves."""
    k = np.arange(GAP)
    within = (k <= left[:, None]) & (LENGTH - k <= right[:, None])
    halves = (within[:, :62], within[:, 62:])
    return tuple((h * (np.uint64(1) << np.arange(h.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64) for h in halves)


def _ship(splitters: np.ndarray, n_buckets: int):
    """Contexts of suffixes: those found once in a batch with their place, the others with the number of places, which are answered here."""
    types = (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [c.split()[0] for c in SUFFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("t"))
            row, place = _places(batch)
            rids, view = batch.column("rid").to_numpy(zero_copy_only=False), memoryview(data)
            for lo in range(0, len(place), 50_000):
                d, a = row[lo : lo + 50_000], place[lo : lo + 50_000]
                pos, r = off[d] + a, rids[d]
                left, right = np.minimum(a, GAP - 1), np.minimum(off[d + 1] - pos, LENGTH)
                number: dict[tuple[bytes, int], int] = {}
                spans = zip((pos - left).tolist(), (pos + right).tolist(), left.tolist(), strict=True)
                which = np.array([number.setdefault((bytes(view[b:e]), x), len(number)) for b, e, x in spans], np.int64)
                copies = np.bincount(which, minlength=len(number))
                lead = np.array([c[x : x + LEAD] for c, x in number], dtype=f"S{LEAD}")
                first = np.unique(which, return_index=True)[1]
                one = [[x] if y == 1 else [] for x, y in zip(r[first].tolist(), copies.tolist(), strict=True)]
                at = [[x] if y == 1 else [] for x, y in zip(a[first].tolist(), copies.tolist(), strict=True)]
                columns = (np.searchsorted(splitters, lead, "right"), [c for c, _ in number], [x for _, x in number], copies, one, at)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                told = np.flatnonzero(copies[which] > 1)
                if len(told):
                    triples = np.stack([a[told], *(h.view(np.int64) for h in _bits(left[told], right[told]))], axis=1)
                    to = bucket_of(r[told] * np.int64(-7046029254386353131), n_buckets)
                    heads, (of, vals) = lists(np.repeat(to, 3), np.repeat(r[told], 3), triples.reshape(-1))
                    none = [None] * len(heads)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((heads, none, none, none), types[:4], strict=True)] + [of, vals], names)

    return run


def multikey_quicksort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows (n, 8m), and the run of equal rows that each sorted row is in.

    A stretch is parted by a pivot word into lesser, equal and greater; the equal ones go on with the next word. Short stretches are sorted by
    what is left of their bytes.
    """
    n = len(rows)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if depth == words.shape[1] or hi - lo < 2:
            group[lo:hi] = lo
            continue
        mine = order[lo:hi]
        if hi - lo <= 24:
            keys = [rows[i, 8 * depth :].tobytes() for i in mine.tolist()]
            by = sorted(range(hi - lo), key=keys.__getitem__)
            order[lo:hi] = mine[by]
            first = lo
            for k, i in enumerate(by):
                if k and keys[i] != keys[by[k - 1]]:
                    first = lo + k
                group[lo + k] = first
            continue
        word = words[mine, depth]
        pivot = np.sort(word[:: max(1, (hi - lo) // 9)])[4 if hi - lo >= 9 else 0]
        less, more = word < pivot, word > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([mine[less], mine[~(less | more)], mine[more]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order, group


def _refined(first: np.ndarray, columns: Iterator[np.ndarray], present: Iterator[np.ndarray], weight: np.ndarray) -> Iterator[np.ndarray]:
    """Classes of rows that agree in ``first`` and in ever more bytes: before any, then after each column. -1 is a row that lacks a byte, or that is
    alone in its class and has one copy."""
    own = first.copy()
    yield own
    for column, there in zip(columns, present, strict=True):
        own = np.where(there, own, -1)
        some = np.flatnonzero(own >= 0)
        if len(some):
            pair = own[some] * 256 + column[some]
            _, now, size = np.unique(pair, return_inverse=True, return_counts=True)
            alone = (size[now] == 1) & (weight[some] == 1)
            own[some] = np.where(alone, -1, now)
        yield own


def compare(n: int):
    """Which strings around each suffix start elsewhere: bit k for the string that starts k bytes before it."""

    def run(table: pa.Table) -> pa.Table:
        return _compare(table, n)

    return run


def _compare(table: pa.Table, n_buckets: int) -> pa.Table:
    sent, told = (table.filter(f(table.column("ctx"))).combine_chunks() for f in (pc.is_valid, pc.is_null))
    # a context of one batch is one row here, with the copies that other batches have
    pairs = zip(sent.column("ctx").to_pylist(), sent.column("n_left").to_pylist(), strict=True)
    names = pa.array([c + x.to_bytes(1, "big") for c, x in pairs], pa.binary()).dictionary_encode()
    which = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, off = text_buffers(names.dictionary)
    owners, rids, ats = counts(sent.column("rids")), flat(sent.column("rids")), flat(sent.column("vals"))
    n, wide = len(off) - 1, GAP - 1 + LENGTH
    weight = np.bincount(which, sent.column("copies").to_numpy(), minlength=n).astype(np.int64)
    left = data[off[1:] - 1].astype(np.int64)
    right = np.diff(off) - 1 - left
    cells = np.zeros((n, wide), np.uint8)
    for r, (b, e, x) in enumerate(zip(off[:-1].tolist(), (off[1:] - 1).tolist(), left.tolist(), strict=True)):  # the suffix starts in column GAP-1
        cells[r, GAP - 1 - x : GAP - 1 - x + e - b] = data[b:e]
    order, group = multikey_quicksort(cells[:, GAP - 1 : GAP - 1 + KEY])
    keep = np.bincount(group, weight[order], minlength=n)[group] > 1
    order, group = order[keep], group[keep]
    low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for lo, hi in _stretches(group):
        rows = order[lo:hi]
        low[rows], high[rows] = _repeated(cells[rows], group[lo:hi], left[rows], right[rows], weight[rows])
    row = np.repeat(which, owners)
    hit = ((low | high) > 0)[row]
    row, of, at = row[hit], rids[hit], ats[hit]
    # three numbers for each suffix: its place and the two halves of the bits
    triples = np.stack([at, low[row].view(np.int64), high[row].view(np.int64)], axis=1).reshape(-1)
    return pack(np.r_[np.repeat(of, 3), flat(told.column("rids"))], np.r_[triples, flat(told.column("vals"))], n_buckets)


def _stretches(group: np.ndarray, most: int = 20_000) -> Iterator[tuple[int, int]]:
    """Whole runs, up to ``most`` rows together if they can."""
    ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
    lo = 0
    while lo < len(group):
        fits = ends[(ends > lo) & (ends <= lo + most)]
        hi = int(fits[-1] if len(fits) else ends[np.searchsorted(ends, lo, "right")])
        yield lo, hi
        lo = hi


def _repeated(cells: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the strings of each row that start elsewhere, among rows in runs of equal KEY bytes."""
    at = GAP - 1
    runs_ = np.unique(group, return_inverse=True)[1].astype(np.int64)
    forward = _refined(runs_, (cells[:, at + m] for m in range(KEY, LENGTH)), (right > m for m in range(KEY, LENGTH)), weight)
    rights = [c.astype(np.int32) for c in forward]  # the class of KEY + i bytes on the right
    lefts = _refined(runs_, (cells[:, at - k] for k in range(1, GAP)), (left >= k for k in range(1, GAP)), weight)
    low, high = np.zeros(len(cells), np.uint64), np.zeros(len(cells), np.uint64)
    for k, of_left in enumerate(lefts):
        of_right = rights[LENGTH - k - KEY]
        ok = np.flatnonzero((of_left >= 0) & (of_right >= 0))
        if not len(ok):
            continue
        _, now = np.unique(of_left[ok] * (len(cells) + 1) + of_right[ok], return_inverse=True)
        hit = ok[np.bincount(now, weight[ok])[now] > 1]
        if k < 62:
            low[hit] |= np.uint64(1 << k)
        else:
            high[hit] |= np.uint64(1 << (k - 62))
    return low, high


def _cut(with_text: bool):
    def starts(n: int, triples: np.ndarray) -> np.ndarray:
        """Which bytes of a document start a repeated string."""
        out = np.zeros(n + 1, bool)
        place, low, high = triples.reshape(-1, 3).T.copy()
        for k in range(GAP):
            bits = low >> k if k < 62 else high >> (k - 62)
            out[place[(bits & 1) > 0] - k] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("t"))
            view, column = memoryview(data), batch.column("found")
            upto = np.r_[0, np.cumsum(np.where(column.is_valid().to_numpy(zero_copy_only=False), counts(column), 0))]
            triples = flat(column.drop_null())
            kept, removed, spans = [], [], []
            for r in range(batch.num_rows):
                lo, hi = int(off[r]), int(off[r + 1])
                mine = triples[upto[r] : upto[r + 1]]
                gone = np.zeros(0, bool)
                if len(mine):
                    mark = np.zeros(hi - lo + 1, np.int32)
                    first = np.flatnonzero(starts(hi - lo, mine))
                    mark[first] += 1
                    np.add.at(mark, np.minimum(first + LENGTH, hi - lo), -1)
                    gone = np.cumsum(mark[:-1]) > 0
                kept.append(data[lo:hi][~gone].tobytes() if gone.any() else bytes(view[lo:hi]))
                removed.append(int(gone.sum()))
                spans.append(len(runs(gone)[0]))
            total = np.diff(off)
            out = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            if with_text:
                out.append(pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and kept_text if asked for."""
    n = buckets(docs)
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("t")).withColumn("rid", F.xxhash64("doc_id", "t"))
    asked = dealt(rows.select("rid", "t").mapInArrow(lean(_send(n)), MESSAGE), "bucket", n).applyInArrow(lean_group(live(n)), PACKED)
    # rows that repeat an id and its text ask for the same places
    twice = cut_lineage(per_document(asked, "ats", n).select(F.col("did").alias("rid"), F.array_distinct("ats").alias("ats")))
    # texts without a live suffix are not moved; the others once, for both joins
    flagged = maybe_in(rows, "rid", twice.select("rid"))
    some, others = flagged.filter("maybe").drop("maybe"), flagged.filter(~F.col("maybe")).drop("maybe")
    shipped = some.join(twice, "rid").mapInArrow(lean(_ship(_splitters(rows, twice, n), n)), SUFFIX)
    found = cut_lineage(per_document(dealt(shipped, "part", n).applyInArrow(lean_group(compare(n)), PACKED), "found", n).withColumnRenamed("did", "rid"))
    told = some.join(found, "rid", "left").unionByName(others.withColumn("found", F.lit(None).cast("array<bigint>")))
    return told.select("doc_id", "t", "found").mapInArrow(lean(_cut(with_text)), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text)
