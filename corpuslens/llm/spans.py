"""Byte and word hashing over Arrow text columns, and the messages by which documents ask about shared passages.

A message batch packs many (key, document) pairs into one row for each bucket. Pairs that the sending batch can answer by itself are
answered there and only forwarded, so however often a passage occurs, a batch sends one question for it: hot passages are aggregated
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslens.llm.common import dealt, lean_group, mix64

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            _powers[k] = np.cumprod(seq, out=seq)
    return _powers[0], _powers[1]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its n+1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i], times the inverse power i, the hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


class Words:
    """The words of some documents: byte spans, document number, number of the document's first word, 64-bit hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        self.docs = len(off) - 1
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begins, ends = word.copy(), word.copy()
        if n:
            begins[1:] &= ~word[:-1] | edge[1:-1]
            ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        first = np.searchsorted(self.start, off)
        self.first = first
        self.doc = np.repeat(np.arange(self.docs), np.diff(first))
        self.nth = np.arange(len(self.start)) - first[:-1][self.doc]
        sums = prefix_hash(data)
        self.hash = mix64((sums[self.end] - sums[self.start]) * powers(n + 1)[1][self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, length: int, multiplier: int = 0xA24BAED4963EE407) -> np.ndarray:
        """A hash for each run of ``length`` words, by its first word; runs over the end of a document are meaningless (see valid)."""
        n = max(0, len(self.hash) - length + 1)
        acc = np.zeros(n, np.uint64)
        for j in range(length):
            acc *= np.uint64(multiplier | 1)
            acc += self.hash[j : j + n]
        return mix64(acc)

    def valid(self, length: int) -> np.ndarray:
        n = max(0, len(self.hash) - length + 1)
        return self.doc[:n] == self.doc[length - 1 : length - 1 + n]


def tagged(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One 64-bit value for each pair of key and document number of a slice."""
    return mix64(keys.view(np.uint64) + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def lists(groups: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Values of each group as one list: the groups in order, then list columns."""
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[heads, len(g)].astype(np.int32))
    return g[heads], [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]


def flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The values of a list column, one after the other."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return chunk.flatten().to_numpy(zero_copy_only=False)


def counts(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(chunk.offsets.to_numpy())


#: Answers packed by the bucket that their documents fall into, and unpacked: one row per document.
PACKED = "dest int, docs array<bigint>, vals array<bigint>"


def pack(docs: np.ndarray, values: np.ndarray, n: int) -> pa.Table:
    """Values for documents, in order within a document, as a row for each bucket of documents."""
    by = np.argsort(docs, kind="stable")
    docs, values = docs[by], values[by]
    heads, columns = lists(bucket_of(docs * np.int64(-7046029254386353131), n), docs, values)
    return pa.table({"dest": pa.array(heads.astype(np.int32)), "docs": columns[0], "vals": columns[1]})


def unpack(table: pa.Table) -> pa.Table:
    ids, (values,) = lists(flat(table.column("docs")), flat(table.column("vals")))
    return pa.table({"did": pa.array(ids, pa.int64()), "vals": values})


def per_document(packed: DataFrame, name: str, n: int) -> DataFrame:
    """did, and the list of all its values as ``name``; ``n`` is the number of buckets that documents fall into."""
    return dealt(packed, "dest", n).applyInArrow(lean_group(unpack), "did bigint, vals array<bigint>").withColumnRenamed("vals", name)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edges = np.flatnonzero(np.diff(np.r_[np.int8(0), flags.astype(np.int8), np.int8(0)]))
    return edges[::2], edges[1::2]


def spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places are covered by a stretch of ``length`` from one of the starts."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + length, n), -1)
    return np.cumsum(mark[:n]) > 0
