"""Cases for a session with experts: drawn by stratum in a hashed order, unusable ones replaced by the next, with examples and blind codes; a sheet
of them in Markdown, and the key from codes to what is behind them, kept apart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.operators import search
from corpuslens.operators.sampling import hash_order


@dataclass(frozen=True)
class Sizes:
    """Cases of each stratum, and examples and terms shown with each."""

    per_stratum: int
    examples: int = 3
    terms: int = 8


def draw(candidates: DataFrame, sample: str, seed: str, per_stratum: int) -> tuple[DataFrame, DataFrame]:
    """(cases, replaced) of candidates (stratum, id, and perhaps reason, why a row can't be used): each stratum's first usable rows in a hashed order.
    ``replaced`` are the unusable rows that stood before the last case drawn."""
    rows = candidates if "reason" in candidates.columns else candidates.withColumn("reason", F.lit(None).cast("string"))
    by = W.partitionBy("stratum").orderBy(hash_order(f"{seed}:{sample}", "stratum", "id"), "id")
    placed = rows.withColumn("place", F.row_number().over(by)).withColumn("usable", F.count_if(F.col("reason").isNull()).over(by))
    cases = placed.filter((F.col("usable") <= per_stratum) & F.col("reason").isNull())
    last = cases.groupBy("stratum").agg(F.max("place").alias("last"))
    replaced = placed.filter("reason is not null").join(last, "stratum").filter("place < last").select("stratum", "id", "reason")
    return cases.drop("reason", "usable"), replaced


def coded(cases: DataFrame, sample: str, seed: str) -> DataFrame:
    """``cases`` with a code each, the sample's letter and a number in another hashed order, so that it tells nothing of the stratum. Cases are few."""
    nth = F.row_number().over(W.orderBy(hash_order(f"{seed}:{sample}:code", "id"), "id"))
    return cases.withColumn("code", F.format_string(f"{sample}%02d", nth))


def examples(members: DataFrame, n: int, seed: str) -> DataFrame:
    """topic, examples: ``n`` members (topic, id) of each topic in a hashed order."""
    by = W.partitionBy("topic").orderBy(hash_order(seed, "topic", "id"), "id")
    first = members.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= n)
    return first.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("examples"))


def assignments(sample: DataFrame, labels: DataFrame, topics: DataFrame, sizes: DataFrame, seed: str, s: Sizes) -> DataFrame:
    """Sample A: late documents (id, program, topic, atypical) with the terms, examples and saturation of their early topic: code first. A topic that
    the early map lacks is refused."""
    unknown = sample.join(labels.select(F.col("label").alias("topic")).distinct(), "topic", "left_anti").limit(1).count()
    if unknown:
        raise ValueError("a document is assigned to a topic that the map lacks")
    cases, _ = draw(sample.withColumn("stratum", F.col("program")), "A", seed, s.per_stratum)
    words = topics.filter(F.col("rank") <= s.terms).groupBy(F.col("label").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    shown = examples(labels.filter("label <> -1").select(F.col("label").alias("topic"), "id"), s.examples, f"{seed}:A:examples")
    level = search.saturation(sizes).select("topic", F.concat(F.lit("Q"), F.col("quartile").cast("string")).alias("saturation"))
    joined = coded(cases, "A", seed).join(words, "topic", "left").join(shown, "topic", "left").join(level, "topic", "left")
    return joined.select("code", "id", "program", "topic", "terms", "examples", "atypical", "saturation")


def queries(cases: DataFrame, unusable: DataFrame, rows: DataFrame, early: DataFrame, cents: DataFrame, seed: str, s: Sizes, ranking: int = 10, mmr_weight: float = 0.7, neighbours: int = 3) -> tuple[list[dict], DataFrame]:
    """Sample B: some of the cases (id, program, topic) run as queries against the early documents, which none of them may be among; each with its
    ranking, its antecedents and the topics next to it. Returns (queries, replaced)."""
    if cases.select("id").join(early.select("id"), "id").limit(1).count():
        raise ValueError("a query is among the candidates of its own ranking")
    given = cases.withColumn("stratum", F.col("program")).join(unusable.select("id", "reason"), "id", "left")
    drawn, replaced = draw(given, "B", seed, s.per_stratum)
    out = []
    for case in coded(drawn, "B", seed).orderBy("code").collect():
        one = rows.filter(F.col("id") == case.id)
        near = search.assign(one, cents).first()
        if near.topic != case.topic:
            raise ValueError("a query's topic differs from the one recorded for it")
        sims = search.scores(cents.select(F.col("topic").alias("id"), F.col("centroid").alias("vec")), one).filter(F.col("id") != near.topic)
        lines = [r.id for r in sims.orderBy(F.desc(F.round("score", 9)), "id").limit(neighbours).collect()]
        ranked = [r.id for r in search.top_k(early, one, ranking).collect()]
        first = [r.id for r in search.mmr(early, one, ranking, mmr_weight, 4 * ranking).orderBy("rank").collect()]
        out.append({"code": case.code, "id": case.id, "topic": near.topic, "ranking": ranked, "antecedents": first, "neighbours": lines})
    return out, replaced


def topics_sample(sizes: DataFrame, members: DataFrame, topics: DataFrame, n: int, seed: str, s: Sizes) -> DataFrame:
    """Sample C: ``n`` topics with their terms and examples."""
    cases, _ = draw(sizes.select(F.lit("all").alias("stratum"), F.col("topic").alias("id"), "size"), "C", seed, n)
    words = topics.filter(F.col("rank") <= s.terms).groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    shown = examples(members, s.examples, f"{seed}:C:examples").withColumnRenamed("topic", "id")
    return coded(cases, "C", seed).join(words, "id", "left").join(shown, "id", "left").select("code", "id", "size", "terms", "examples")


def gaps_sample(gaps: DataFrame, members: DataFrame, per_rule: int, seed: str, s: Sizes) -> DataFrame:
    """Sample D: stable gaps (gap_id, rule) by rule, with examples of their members."""
    cases, _ = draw(gaps.select(F.col("rule").alias("stratum"), F.col("gap_id").alias("id")), "D", seed, per_rule)
    shown = examples(members.select(F.col("gap_id").alias("topic"), "id").distinct(), s.examples, f"{seed}:D:examples").withColumnRenamed("topic", "id")
    return coded(cases, "D", seed).join(shown, "id", "left").select("code", "id", F.col("stratum").alias("rule"), "examples")


def sheet(title: str, cases: Sequence[Mapping[str, object]], hidden: Sequence[str]) -> str:
    """Cases as Markdown, one heading a code, without what the key holds."""
    lines = [f"# {title}", ""]
    for case in sorted(cases, key=lambda c: str(c["code"])):
        lines += [f"## {case['code']}", ""]
        for name, value in case.items():
            if name != "code" and name not in hidden:
                shown = ", ".join(map(str, value)) if isinstance(value, list | tuple) else value
                lines.append(f"- {name}: {'' if shown is None else shown}")
        lines.append("")
    return "\n".join(lines)


def key_rows(cases: Sequence[Mapping[str, object]], hidden: Sequence[str]) -> list[tuple[str, str, str]]:
    """(code, name, value) of what the sheet leaves out."""
    return sorted((str(c["code"]), name, str(c[name])) for c in cases for name in hidden if c.get(name) is not None)
