"""Corpus profile: distributions, histograms, rankings, grids, duplicates, coverage. Each is one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.metadata import band
from corpuslens.functions.text import approximate_sentences, line_breaks, packed
from corpuslens.operators.running import best, running

QUANTILES = (0.25, 0.5, 0.75, 0.95)


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, min, quartiles, P95 (linear interpolation) and max."""
    cuts = F.percentile(value, F.array(*(F.lit(q) for q in QUANTILES))).alias("cuts")
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), cuts, F.max(value).alias("most"))
    return got.select(*by, "n", "mean", "least", *(F.col("cuts")[k].alias(f"p{int(100 * q)}") for k, q in enumerate(QUANTILES)), "most")


def histogram(df: DataFrame, value: str, width: int) -> DataFrame:
    """Counts by bin start, with the empty bins between the first and the last."""
    counts = df.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = counts.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi", F.lit(width).cast("long"))).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranked(df: DataFrame, key: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k most frequent keys (of each group), ties to the smaller key."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), key).limit(k)
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), key)).cast("long")).filter(F.col("rank") <= k)


def year_grid(df: DataFrame, group: str, year: str) -> DataFrame:
    """Counts by group and year with zeros, and marginals (null group or year stands for all)."""
    counts = df.filter(F.col(year).isNotNull()).cube(group, year).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    span = df.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(year))
    grid = df.select(group).distinct().crossJoin(F.broadcast(span)).withColumn("level", F.lit(0).cast("bigint"))
    keys = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (group, year, "level")]
    full = grid.alias("g").join(counts.alias("c"), keys[0] & keys[1] & keys[2], "left").select(f"g.{group}", f"g.{year}", F.coalesce("c.n", F.lit(0)).alias("n"), F.lit(0).cast("bigint").alias("level"))
    return full.unionByName(counts.filter("level > 0").select(group, year, "n", "level"))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many groups of equal keys there are, how many rows are in them, and how many rows are extra."""
    size = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return size.agg(F.count("*").alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def canonical(df: DataFrame, key: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """Each row whose key another row has first, with that row's id. The first of a key is an aggregate, so a hot key costs one row a task."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order, id_col)).alias("first")).select(*key, F.col(f"first.{id_col}").alias("duplicate_of"))
    return df.join(first, list(key)).filter(F.col(id_col) != F.col("duplicate_of")).select(id_col, "duplicate_of")


def bands(df: DataFrame, key: str) -> DataFrame:
    """How many keys have 1, 2-5, 6-10, 11-20, 21+ rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).groupBy(band("n").alias("band")).agg(F.count("*").alias("keys"))


def concentration(df: DataFrame, key: str, top: int) -> DataFrame:
    """Distinct keys, rows, and the share of the ``top`` most frequent keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    whole = counts.agg(F.count("*").alias("distinct_keys"), F.sum("n").alias("n_rows"))
    leading = counts.orderBy(F.desc("n"), key).limit(top).agg(F.sum("n").alias("top_rows"))
    return whole.crossJoin(leading).withColumn("top_share", F.try_divide(F.col("top_rows").cast("double"), F.col("n_rows")))


def document_frequency(df: DataFrame, id_col: str, tokens: Column, least: float) -> DataFrame:
    """Tokens that occur in at least the share ``least`` of the documents (inclusive): documents, ratio."""
    seen = df.select(id_col, F.explode(F.array_distinct(tokens)).alias("token"))
    total = df.agg(F.count("*").alias("total"))
    counts = seen.groupBy("token").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(total))
    ratio = F.col("documents").cast("double") / F.col("total")
    return counts.filter(ratio >= least).select("token", "documents", ratio.alias("ratio"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column how many rows have a value, and a non-blank one; one pass."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("present"), F.count_if(F.trim(F.col(c).cast("string")) != "").alias("filled")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def first_per_group(df: DataFrame, group: str, order: str, per_group: int, limit: int) -> DataFrame:
    """The first ``per_group`` rows of each group in order, and of these the first ``limit``."""
    ranked_rows = df.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(order)))
    return ranked_rows.filter(F.col("nth") <= per_group).orderBy(order).limit(limit).drop("nth")


def streaks(df: DataFrame, order: str, fail: Column, by: str) -> DataFrame:
    """Longest run of failures in a row for each key; another outcome resets it."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    islands = df.withColumn("fail", fail).withColumn("island", F.sum((~F.col("fail")).cast("int")).over(w)).filter("fail").groupBy(by, "island").agg(F.count("*").alias("n"))
    return islands.groupBy(by).agg(F.max("n").alias("longest"), F.count("*").alias("streaks"))


def average_rank(df: DataFrame, score: str, id_cols: Sequence[str]) -> DataFrame:
    """Mean rank of ties over n: 1.0 is the highest. Ranks come from counts of distinct scores, added up range by range."""
    counts = df.groupBy(score).agg(F.count("*").alias("m"))
    placed = running(counts, score, {"upto": "m"}).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))
    twice = (2 * F.col("upto") - F.col("m") + 1).cast("long")
    return df.join(placed.select(score, twice.alias("twice_rank"), "total"), score).select(*id_cols, score, "twice_rank", "total", (F.col("twice_rank") / (2.0 * F.col("total"))).alias("percentile_rank"))


def mid_range(rank: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Rows whose percentile rank is in [low, high), both exact fractions."""
    r, n = F.col("twice_rank"), F.col("total") * 2
    return rank.filter((r * low[1] >= n * low[0]) & (r * high[1] < n * high[0]))


def top_share(df: DataFrame, score: str, order: str, share: tuple[int, int]) -> DataFrame:
    """The ceil(share * n) best rows, ties to the earlier one; in no order."""
    k = -(-df.count() * share[0] // share[1])
    return best(df.withColumn("rounded__", F.round(score, 9)), "rounded__", order, k).drop("rounded__")


def stopword_recheck(df: DataFrame, id_col: str, tokens: Column, listed: DataFrame, least: float) -> DataFrame:
    """Listed words with the share of documents that hold them (0 for none), and unlisted words in the share ``least`` or more."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.select(id_col, F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(total))
    shares = counts.select("word", "documents", (F.col("documents").cast("double") / F.col("total")).alias("ratio"))
    known = listed.select("word").distinct().join(shares, "word", "left").select("word", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.lit(True).alias("listed"))
    return known.unionByName(shares.filter(F.col("ratio") >= least).join(listed, "word", "left_anti").withColumn("listed", F.lit(False)))


def length_profile(df: DataFrame, text: str, size: Column, limit: int) -> DataFrame:
    """Characters, words and tokens of the texts that there are, and the share over a token limit; one pass."""
    rows = df.filter(F.trim(text) != "").select(F.length(text).alias("chars"), F.size(F.split(F.trim(text), r"\s+")).alias("words"), size.alias("tokens"))
    stats = [F.struct(F.lit(c).alias("measure"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.max(c).cast("long").alias("most")) for c in ("chars", "words", "tokens")]
    over = F.avg((F.col("tokens") > limit).cast("double")).alias("share_over_limit")
    return rows.agg(F.array(*stats).alias("s"), over).select(F.inline("s"), "share_over_limit")


def code_profile(df: DataFrame, id_col: str, codes: str) -> DataFrame:
    """Rows that hold each code, and each code's first two digits, once a row: level, code, n; rows without any are under (none)."""
    each = df.select(id_col, F.explode(F.when(F.size(codes) > 0, F.col(codes)).otherwise(F.array(F.lit("(none)")))).alias("code"))
    levels = F.inline(F.array(F.struct(F.lit("code").alias("level"), F.col("code").alias("value")), F.struct(F.lit("field").alias("level"), F.when(F.col("code") == "(none)", F.col("code")).otherwise(F.substring_index("code", ".", 1)).alias("value"))))
    return each.select(id_col, levels).distinct().groupBy("level", F.col("value").alias("code")).agg(F.count("*").alias("n"))


def keyword_profile(df: DataFrame, id_col: str, keywords: str, normal, top: int, by: str | None = None) -> DataFrame:
    """Normalised keywords, once a row, the most frequent first; with how many keywords the rows have in the mean and how many rows have none."""
    words = F.array_distinct(F.filter(F.transform(keywords, normal), lambda k: k != ""))
    rows = df.select(id_col, *([by] if by else []), words.alias("w"))
    best = ranked(rows.select(*([by] if by else []), F.explode("w").alias("keyword")), "keyword", top, [by] if by else [])
    total = rows.agg(F.avg(F.size("w")).alias("mean_keywords"), F.count_if(F.size("w") == 0).alias("rows_without"))
    return best.crossJoin(F.broadcast(total))


def advisor_profile(df: DataFrame, advisor: str, notes: str, top: int) -> DataFrame:
    """Rows with and without an advisor, distinct ones, the share of the busiest, and rows with a note."""
    known = df.filter(F.col(advisor).isNotNull())
    whole = df.agg(F.count(advisor).alias("with_advisor"), F.count_if(F.col(advisor).isNull()).alias("without_advisor"), F.count_if(F.size(notes) > 0).alias("with_note"))
    return whole.crossJoin(concentration(known, advisor, top))


def abstract_profile(df: DataFrame, text: str, limit: int) -> DataFrame:
    """One row over the texts that there are: lengths, chunks of ``limit`` tokens that greedy packing of their sentences needs, line breaks, and defects
    (none, blank, without a final mark)."""
    t = F.trim(text)
    there = df.filter(t != "")
    sentences = approximate_sentences(F.col(text))
    sizes = F.transform(sentences, lambda s: F.size(F.split(s, " ")))
    rows = there.select(F.length(t).alias("chars"), F.size(sentences).alias("sentences"), packed(sizes, limit).alias("chunks"), line_breaks(F.col(text)).alias("b"), (~t.rlike(r"[.!?…][\"'»)]*$")).alias("open_end"))
    got = rows.agg(
        F.count("*").alias("texts"), F.avg("chars").alias("mean_chars"), F.median("chars").alias("median_chars"), F.max("chars").cast("long").alias("most_chars"), F.avg("sentences").alias("mean_sentences"),
        F.sum("chunks").alias("chunks"), F.count_if(F.col("chunks") > 1).alias("more_than_one_chunk"), F.sum("b.breaks").alias("breaks"), F.sum("b.inside").alias("breaks_inside"), F.sum("b.hyphen").alias("breaks_after_hyphen"),
        F.count_if("open_end").alias("open_ends"),
    )
    blank = df.agg(F.count_if(F.col(text).isNull()).alias("missing"), F.count_if(t == "").alias("blank"))
    return got.crossJoin(blank)


def metadata_profile(df: DataFrame, id_col: str, *, group: str, year: str, title: str, text: str, language: str, limit: int, top: int) -> dict[str, DataFrame]:
    """The profile of a table of documents by name of its part; the table is cached once and read by all of them."""
    rows = df.persist()
    width = rows.withColumn("title_chars", F.length(title))
    return {
        "calendar": year_grid(rows, group, year),
        "titles": describe(width, "title_chars"),
        "title_histogram": histogram(width, "title_chars", 20),
        "texts": abstract_profile(rows, text, limit),
        "languages": ranked(rows, language, top),
        "presence": completeness(rows, [group, year, title, text, language]),
        "groups": bands(rows, group),
        "duplicates": duplicate_groups(rows.filter(F.trim(text) != ""), [title, text]),
        "frequent_groups": concentration(rows, group, top),
    }
