"""Guards: sensitive strings and where they leak, expected counts, equality checks that stop a job."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

#: Characters of the needles that are sent to the workers at once; more are searched for part by part.
NEEDLE_CHARS = 4_000_000


def folded(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sensitive(df: DataFrame, columns: list[str], least_sentence: int) -> DataFrame:
    """Distinct folded values and their long sentences."""
    values = df.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("v")).filter("v is not null")
    parts = values.select(F.explode(F.concat(F.array(folded(F.col("v"))), F.filter(F.transform(F.split("v", r"[.\n]"), folded), lambda s: F.length(s) >= least_sentence))).alias("needle"))
    return parts.filter("needle <> ''").distinct()


class Finder:
    """Which of some needles occur in a text: one pass over it by an Aho-Corasick automaton, needle by needle without that library."""

    def __init__(self, needles: Sequence[str]):
        self.needles = list(needles)
        self.machine = None
        if ahocorasick is not None and any(self.needles):
            self.machine = ahocorasick.Automaton()
            for k, needle in enumerate(self.needles):
                if needle:
                    self.machine.add_word(needle, k)
            self.machine.make_automaton()

    def find(self, text: str) -> list[str]:
        if self.machine is None:
            return [n for n in self.needles if n in text]
        found = {k for _, k in self.machine.iter(text)}
        return [n for k, n in enumerate(self.needles) if k in found or not n]


def _search(needles: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(needles.value)
        for batch in batches:
            found = [finder.find(t) if t is not None else [] for t in batch.column("hay").to_pylist()]
            at = [k for k, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array([n for f in found for n in f], pa.string())], ["id", "needle"])

    return run


def leaks(df: DataFrame, id_col: str, text_col: str, needles: DataFrame, chars: int = NEEDLE_CHARS) -> DataFrame:
    """Needles that occur in the folded text, by document. The needles are dealt to parts of about ``chars`` characters, and each part is looked
    for in one pass over the texts, which are not moved."""
    hay = df.select(F.col(id_col).alias("id"), folded(F.col(text_col)).alias("hay"))
    wanted = needles.select("needle").filter("needle is not null").distinct()
    parts = max(1, math.ceil((wanted.agg(F.sum(F.length("needle"))).first()[0] or 0) / chars))
    placed = wanted.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(parts)))
    schema = f"id {hay.schema['id'].dataType.simpleString()}, needle string"
    out: DataFrame | None = None
    for part in range(parts):
        own = df.sparkSession.sparkContext.broadcast([r.needle for r in placed.filter(F.col("part") == part).select("needle").collect()])
        found = hay.mapInArrow(_search(own), schema)
        out = found if out is None else out.unionByName(found)
    return out


def refuse_leaks(found: DataFrame, what: str) -> None:
    """Raises with the number of documents that leak, and never with what leaks."""
    n = found.select("id").distinct().count()
    if n:
        raise ValueError(f"{n} {what} hold a sensitive string")


def check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass: rule, broken."""
    return df.agg(F.array(*(F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(rule, F.lit(False))).alias("broken")) for name, rule in rules.items())).alias("r")).select(F.inline("r"))


def require(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df``; raises with all broken rules."""
    broken = [f"{r.rule} ({r.broken} rows)" for r in check(df, rules).collect() if r.broken]
    if broken:
        raise ValueError("broken rules: " + ", ".join(broken))
    return df
