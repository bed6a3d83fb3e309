"""The grid of a topic-map experiment: models, seeds and parameters; what it would do, its runs, and their summaries.

The driver walks the configurations; each run is Spark work. Reductions are made once for each model and seed and shared.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import learn, metrics


@dataclass(frozen=True)
class Grid:
    """Seeds, numbers of clusters and least cluster sizes, and the dimensions of the reduction."""

    seeds: tuple[int, ...]
    ks: tuple[int, ...]
    sizes: tuple[int, ...] = ()
    dimensions: int = 5


@dataclass(frozen=True)
class Run:
    representation: str
    algorithm: str
    parameter: int
    seed: int

    @property
    def run_id(self) -> str:
        return f"{self.representation}-{self.algorithm}{self.parameter}-s{self.seed}"


def config_hash(declaration: Mapping[str, object]) -> str:
    """SHA-256 of the canonical JSON of a declaration."""
    return hashlib.sha256(json.dumps(declaration, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def pinned(declaration: Mapping[str, object], digest: str) -> None:
    """Refuses a declaration that was changed."""
    if config_hash(declaration) != digest:
        raise ValueError("the declaration is not the pinned one")


def runs(representations: Sequence[str], grid: Grid) -> list[Run]:
    return [Run(r, a, p, s) for r in representations for s in grid.seeds for a, ps in (("kmeans", grid.ks), ("density", grid.sizes)) for p in ps]


def forecast(representations: Sequence[str], grid: Grid) -> dict[str, int]:
    """What the grid would do, without doing it."""
    n = len(runs(representations, grid))
    return {"reductions": len(representations) * len(grid.seeds), "clusterings": n, "metric_calls": n, "stability_pairs": len(representations) * (len(grid.ks) + len(grid.sizes)) * len(grid.seeds) * (len(grid.seeds) - 1) // 2}


def execute(vectors: Mapping[str, DataFrame], grid: Grid, reduce: Callable[[DataFrame, int, int], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels of all runs, one row of metrics per run). ``reduce`` is a port: (rows, dimensions, seed) -> id, vec. ``keep`` writes a run's frame where
    it stays (a checkpoint, by default) so that what was cached for it can go before the next."""
    reduce = reduce or (lambda rows, k, seed: learn.reduce(rows, k))
    keep = keep or kept
    labels, rows = [], []
    for name, vec in vectors.items():
        vec = vec.persist()
        for seed in grid.seeds:
            small = reduce(vec, grid.dimensions, seed).persist()
            for run in (r for r in runs([name], grid) if r.seed == seed):
                found = learn.kmeans(small, run.parameter, seed) if run.algorithm == "kmeans" else learn.density(small, run.parameter).select("id", "label")
                found = keep(found.select("id", F.col("label").cast("int").alias("label")))
                key = [F.lit(v).alias(k) for k, v in ({"run_id": run.run_id} | asdict(run)).items()]
                labels.append(found.select(*key, "id", "label"))
                noise = found.agg(F.avg((F.col("label") == -1).cast("double")).alias("noise_fraction"))
                rows.append(keep(metrics.silhouette(vec, found).crossJoin(noise)).select(*key, "*"))
            small.unpersist()
        vec.unpersist()
    return _union(labels), _union(rows)


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, if the session has a checkpoint folder, else cached."""
    sc = df.sparkSession.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def baseline(weights: DataFrame, ks: Sequence[int], seed: int, starts: int = 10) -> DataFrame:
    """k-means on sparse term weights (doc, term, weight) of unit rows for each k: k, doc, label. The vectors stay sparse."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors, VectorUDT

    names = weights.select("term").distinct().groupBy().agg(F.array_sort(F.collect_list("term")).alias("t")).select(F.posexplode("t").alias("at", "term"))
    size = names.count()

    @F.udf(VectorUDT())
    def vector(cells):
        return Vectors.sparse(size, sorted((c["at"], float(c["weight"])) for c in cells))

    rows = weights.join(names, "term").groupBy("doc").agg(vector(F.collect_list(F.struct("at", "weight"))).alias("features")).persist()
    out = []
    for k in ks:
        models = [KMeans(k=k, seed=seed + s, maxIter=50).fit(rows) for s in range(starts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        out.append(best.transform(rows).select(F.lit(k).alias("k"), "doc", F.col("prediction").alias("label")))
    return _union(out)


def stability(labels: DataFrame, noise: str = "own_label") -> DataFrame:
    """Adjusted Rand index of each pair of seeds of a configuration: all pairs at once, from their contingency cells."""
    one = labels.select("representation", "algorithm", "parameter", "seed", "id", "label")
    if noise == "exclude_either":
        one = one.filter("label <> -1")
    by = ["representation", "algorithm", "parameter"]
    pairs = one.alias("x").join(one.withColumnsRenamed({"seed": "seed_b", "label": "label_b"}).alias("y"), [*by, "id"]).filter("seed < seed_b")
    cells = pairs.groupBy(*by, "seed", "seed_b", "label", "label_b").agg(F.count("*").alias("n"))
    key, c2 = [*by, "seed", "seed_b"], lambda c: F.sum((c * (c - 1) / 2).cast("double"))
    margin = lambda side, name: cells.groupBy(*key, side).agg(F.sum("n").alias("m")).groupBy(*key).agg(c2(F.col("m")).alias(name))
    both = cells.groupBy(*key).agg(c2(F.col("n")).alias("ij"), F.sum("n").alias("n")).join(margin("label", "a"), key).join(margin("label_b", "b"), key)
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("n") * (F.col("n") - 1) / 2)
    room = (F.col("a") + F.col("b")) / 2 - expected
    return both.select(*by, F.col("seed").alias("run_a"), F.col("seed_b").alias("run_b"), F.when(room == 0, 1.0).otherwise(F.try_divide(F.col("ij") - expected, room)).alias("ari"))


def repeats(first: DataFrame, second: DataFrame) -> bool:
    """Do two fits give the same labels?"""
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).first()
    return total(first) == total(second)


def declared_pairs(seeds: Sequence[int]) -> list[tuple[int, int]]:
    return list(combinations(seeds, 2))
