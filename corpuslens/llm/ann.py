"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed in blocks, quantised to int8 with a scale each. The stated query set meets all vectors block by block, as a grid of (query
block, group of candidate blocks) cells dealt by key; no row meets a row in a join. In a cell a tile is one product of int8 matrices. As
x = x' + e with x' the quantised vector, |x.y - x'.y'| <= |e_x| |y| + |x'| |e_y|, which bounds each product from both sides. A pair
whose upper bound is below the k-th best lower bound of its query can't be among the k nearest; the others are recomputed in
double precision and go through the query's heap of k, which runs over all blocks of the cell. Heaps of cells are merged last.
Of equal vectors in a block only the k smallest ids beside the query's own can matter, so copies don't multiply survivors.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; null ids
take no part; a repeated id is one candidate a row, and one query a row with k rows of its own; a query's own candidates are all rows of its
id; fewer candidates than k are all returned; ties go to the smaller id. Ids are read as bigint.

Work and shuffle grow with queries times vectors: each block goes to every cell of the other side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.common import mix64

#: Rows of a block, and about how many query and candidate rows meet in a cell of the grid.
BLOCK, QUERY_CELL, CELL_ROWS = 4096, 16384, 16384
CELL = "qb int, cg int, role string, n int, ids array<bigint>, vectors binary"
OUT = "query_id bigint, qb int, mark bigint, nth int, vec_id bigint, score double"
#: Components whose products of codes are added in float32 at once: 127 * 127 * SUM < 2^24, so the sums are exact.
SUM = 1024


def _pack(role: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, vectors: list) -> pa.RecordBatch:
            i = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array([i.tolist()], pa.list_(pa.int64())), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], ["ids", "vectors"])

        ids, vectors, held = [], [], 0
        for batch in batches:
            i = batch.column("id").to_numpy(zero_copy_only=False)
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1) if len(i) else None
            for lo in range(0, len(i), block):
                ids.append(i[lo : lo + block])
                vectors.append(v[lo : lo + block])
                held += len(ids[-1])
                if held >= block:
                    yield emit(ids, vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield emit(ids, vectors)

    return run


class Quantised:
    """int8 codes, scale, length of the vector, of the code vector and of the error."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(axis=1) / 127
        self.code = np.rint(x / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        self.near = np.linalg.norm(near, axis=1)
        self.error = np.linalg.norm(x - near, axis=1)
        self.length = np.linalg.norm(x, axis=1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in order of the components."""
    acc = np.zeros(len(q))
    for d in range(q.shape[1]):
        acc += q[:, d] * c[:, d]
    return acc


def _tile(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of int8 codes, exact."""
    out = np.zeros((len(q), len(c)))
    for d in range(0, q.shape[1], SUM):
        out += q[:, d : d + SUM].astype(np.float32) @ c[:, d : d + SUM].astype(np.float32).T
    return out


def _push(heap: list[tuple[float, int]], k: int, score: float, vec_id: int) -> None:
    """Keeps the k largest scores, ties to the smaller id."""
    item = (score, -vec_id)
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _nth(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Numbers rows that share an id and a vector."""
    order = np.lexsort((marks, ids))
    new = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(marks[order]) != 0)]
    head = np.flatnonzero(new)
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - head[np.cumsum(new) - 1]
    return out


def _thin(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block without those that k equal vectors with smaller ids precede, whichever one id is left out of these."""
    _, same = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    at = np.arange(len(s))
    new = np.r_[True, s[1:] != s[:-1]]
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    again = at - np.maximum.accumulate(np.where(new | np.r_[True, i[1:] != i[:-1]], at, 0)) + 1
    group = np.cumsum(new) * np.int64(len(s) + 1)
    most = np.maximum.accumulate(group + again) - group  # rows that one id has at most, so far
    before = np.where(new, 0, np.r_[0, most[:-1]])
    return np.sort(order[nth - before < k])


def _cell(k: int, kind: type):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asks = [r for r in rows if r["role"] == "q"]
        heaps: list[list[tuple[float, int]]] = []
        q_ids = marks = np.zeros(0, np.int64)
        if asks:
            q_ids = np.concatenate([np.array(r["ids"], np.int64) for r in asks])
            raw = np.concatenate([np.frombuffer(r["vectors"], kind).reshape(r["n"], -1) for r in asks])
            q = raw.astype(np.float64)
            marks = mix64((np.ascontiguousarray(q).view(np.uint64) * np.arange(1, 2 * q.shape[1], 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).view(np.int64)
            qz, heaps = Quantised(q), [[] for _ in q_ids]
            floor = np.full(len(q), -np.inf)
            for r in rows:
                if r["role"] != "c":
                    continue
                ids, c = np.array(r["ids"], np.int64), np.frombuffer(r["vectors"], kind).reshape(r["n"], -1).astype(np.float64)
                some = _thin(ids, c, k)
                ids, c = ids[some], c[some]
                cz = Quantised(c)
                for lo in range(0, len(q), 512):
                    part = slice(lo, lo + 512)
                    tile = _tile(qz.code[part], cz.code) * qz.scale[part, None] * cz.scale
                    slack = qz.error[part, None] * cz.length + qz.near[part, None] * cz.error
                    slack += 1e-9 * (1 + np.abs(tile))
                    own = q_ids[part, None] == ids
                    tile[own] = -np.inf
                    lower = tile - slack
                    if lower.shape[1] > k:
                        kth = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
                        floor[part] = np.maximum(floor[part], kth)
                    qi, ci = np.nonzero((tile + slack >= floor[part, None]) & ~own)
                    for s in range(0, len(qi), 65536):
                        at, of = qi[s : s + 65536] + lo, ci[s : s + 65536]
                        for i, vec_id, score in zip(at.tolist(), ids[of].tolist(), exact(q[at], c[of]).tolist(), strict=True):
                            _push(heaps[i], k, score, vec_id)
                    for i in np.unique(qi).tolist():
                        if len(heaps[i + lo]) == k:
                            floor[i + lo] = max(floor[i + lo], heaps[i + lo][0][0])
        each = [len(h) for h in heaps]
        best = [(score, -minus) for h in heaps for score, minus in h]
        return pa.table(
            {
                "query_id": pa.array(np.repeat(q_ids, each), pa.int64()),
                "qb": pa.array(np.full(len(best), rows[0]["qb"] if rows else 0, np.int32)),
                "mark": pa.array(np.repeat(marks, each), pa.int64()),
                "nth": pa.array(np.repeat(_nth(q_ids, marks), each).astype(np.int32)) if len(q_ids) else pa.array([], pa.int32()),
                "vec_id": pa.array([i for _, i in best], pa.int64()),
                "score": pa.array([s for s, _ in best], pa.float64()),
            }
        )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_cell: int = QUERY_CELL, cell: int = CELL_ROWS) -> DataFrame:
    """For each query (vec_id, embedding) its k candidates with the largest inner products: query_id, rank, vec_id, score."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        fit = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        if dict(df.dtypes)["embedding"] not in ("array<float>", "array<double>"):
            v = v.cast("array<double>")
        return df.filter(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))

    usual = usable(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    pick = lambda df: usable(df).join(F.broadcast(usual), F.size("v") == F.col("d"), "left_semi")
    packed = lambda df, role: df.mapInArrow(_pack(role, block), "ids array<bigint>, vectors binary").withColumn("n", F.size("ids")).withColumn("role", F.lit(role)).withColumn("at", F.xxhash64("ids"))
    q, c = packed(pick(queries), "q"), packed(pick(vectors), "c")
    # blocks are dealt by hash to a grid whose sides follow the numbers of rows
    q_cells, c_cells = (max(1, -(-(df.agg(F.sum("n")).first()[0] or 0) // size)) for df, size in ((q, query_cell), (c, cell)))
    q = q.withColumn("qb", F.pmod("at", F.lit(q_cells)).cast("int")).withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(c_cells - 1))))
    c = c.withColumn("cg", F.pmod("at", F.lit(c_cells)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_cells - 1))))
    cells = q.select("qb", "cg", "role", "n", "ids", "vectors").union(c.select("qb", "cg", "role", "n", "ids", "vectors"))
    tops = cells.groupBy("qb", "cg").applyInArrow(_cell(k, np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64), OUT)
    # the same queries are in all cells of a query block, so id, vector and number name a query row there
    by = W.partitionBy("query_id", "qb", "mark", "nth").orderBy(F.desc("score"), "vec_id")
    return tops.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS row_no, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (SELECT a.row_no, a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
