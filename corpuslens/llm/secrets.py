"""Secret scans with an incremental blob ledger.

Every text is content-addressed by SHA-256; a blob that many paths (documents, or versions of one) hold is scanned once. The ledger, a table
in Parquet, holds one row for each (blob, rule, rule version) scanned, with its spans, or none; a run scans only the pairs that it lacks,
adds them, and joins the findings of the rules' present versions, old and new, to all paths of a blob. A blob that surely has no second path
(a bitmap of bounded size tells) is scanned where it lies; only texts of blobs that may have copies are shuffled, after one of each
has been kept per task. Against a ledger with rows the texts that it may lack are joined with it by blob.

Spans are code points of the whole match, end exclusive. Besides the base kinds there is ``pem``, the header line of a private key.
Defined results: null text is empty; null and repeated ids are paths like any other; a pair that two ledger rows hold counts once; kinds
that the rules don't name are no findings; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import cut_lineage, join_groups, lean, maybe_in, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches, of which those whose group has ``least`` characters count."""

    version: int
    pattern: str
    group: int
    least: int
    #: A text without it has no match; "" tells nothing.
    needs: str = ""


# The base kinds, in the order in which spans at one place are listed; letters of key words in either case, ASCII only.
RULES: dict[str, Rule] = {
    "assign": Rule(
        1,
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    "access": Rule(1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    "hex": Rule(1, r"[0-9a-f]{24,}", 0, 24),
    "pem": Rule(1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
}
BASE = ("assign", "access", "hex")


def find(text: str, rule: Rule, compiled: re.Pattern[str]) -> list[tuple[int, int]]:
    if rule.needs and rule.needs not in text:
        return []
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


LEDGER = "blob binary, kind string, version int, starts array<int>, ends array<int>"


def _scanner(rules: Mapping[str, Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {kind: re.compile(r.pattern) for kind, r in rules.items()}
        for batch in batches:
            rows = []
            for blob, text, todo in zip(*(batch.column(c).to_pylist() for c in ("blob", "t", "todo")), strict=True):
                for kind in todo:
                    spans = find(text, rules[kind], compiled[kind])
                    rows.append((blob, kind, rules[kind].version, [s for s, _ in spans], [e for _, e in spans]))
            types = (pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["blob", "kind", "version", "starts", "ends"])

    return run


def _blob() -> Column:
    return F.unhex(F.sha2(text_or_empty(), 256)).alias("blob")


def _current(ledger: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Ledger rows of the rules' present versions."""
    return ledger.filter(" or ".join(f"(kind = '{kind}' and version = {r.version})" for kind, r in rules.items()))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """New ledger rows: for each (blob, kind, version) not in ``ledger``, the starts and ends of its findings, if any."""
    blobs = docs.select(_blob(), text_or_empty().alias("t"))
    copied = cut_lineage(blobs.groupBy("blob").count().filter("count > 1").select("blob"))
    flagged = maybe_in(blobs, "blob", copied)
    once = flagged.filter(~F.col("maybe")).select("blob", "t").union(flagged.filter("maybe").groupBy("blob").agg(F.first("t").alias("t")))
    every = F.array(*(F.lit(kind) for kind in rules))
    if ledger is None:
        todo = once.withColumn("todo", every)
    else:
        seen = _current(ledger, rules).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        todo = once.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).filter("size(todo) > 0")
    return todo.select("blob", "t", "todo").mapInArrow(lean(_scanner(rules)), LEDGER)


def update(docs: DataFrame, path: str, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """The ledger at ``path``, a folder that all executors share, after a scan of what it lacked. The folder is made if there is none."""
    spark = docs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(LEDGER).parquet(path) if there else None
    scan(docs, known, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """One row per path: doc_id, and spans, an array of (start, rank of the kind, end, kind) in order, by the rules' present versions."""
    rank = F.array_position(F.array(*(F.lit(kind) for kind in rules)), F.col("kind")).cast("int")
    spans = _current(ledger, rules).filter("size(starts) > 0").select("blob", "kind", rank.alias("rank"), F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    span = F.struct(F.col("s.starts").alias("start"), "rank", F.col("s.ends").alias("end"), "kind")
    per_blob = spans.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    paths = docs.select("doc_id", _blob())
    groups = paths.groupBy("blob").agg(F.count("*").alias("n")).join(per_blob, "blob", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return join_groups(paths, groups, "blob", "n").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(paths: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return paths.select("doc_id", *(count(kind) for kind in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql_kind(kind: str, rank: int) -> str:
    """The spans of a kind in SQL: where the parts between matches and the matches before it end."""
    rule = RULES[kind]
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT text_key, '{kind}' AS kind, {rank} AS rank, start, start + len(whole) AS "end" FROM (
  SELECT text_key, whole, part, CAST(list_sum([len(x) FOR x IN parts[1:i]]) + coalesce(list_sum([len(x) FOR x IN wholes[1:i - 1]]), 0) AS BIGINT) AS start FROM (
    SELECT text_key, unnest(wholes) AS whole, unnest(groups) AS part, unnest(range(1, len(wholes) + 1)) AS i, wholes, parts FROM (
      SELECT text_key, regexp_extract_all(t, '{pattern}') AS wholes, regexp_extract_all(t, '{pattern}', {rule.group}) AS groups, string_split_regex(t, '{pattern}') AS parts FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE len(part) >= {rule.least}"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT DISTINCT t AS text_key, t FROM docs),
s AS ({" UNION ALL ".join(_sql_kind(kind, k) for k, kind in enumerate(RULES, 1))}),
g AS (SELECT text_key, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (kind <> 'pem') AS base, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM s GROUP BY text_key)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN g ON t = text_key
"""
