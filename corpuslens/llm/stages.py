"""The operators as filters and maps of a table of documents, for pipelines. Other columns pass through, whatever their names.

A document is known by its id and the SHA-256 of its text, so documents whose ids are null or repeated are told apart by their texts.
A filtering stage moves only the texts of rows that a bitmap of bounded size calls doubtful; all others stay where they are.

Defined results: null text counts as empty; ids are read as bigint; rows that repeat an id and its text are copies, of which the two dedup
stages keep one and the mix takes each as often; an empty table gives an empty one; the columns of a filtering stage are those of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import exact_dedup, languages, mixing, near, pieces
from corpuslens.llm.common import cut_lineage, join_groups, maybe_in, text_or_empty

#: A document is rejected if no language has so great a share of it, or all learned languages together don't explain so much.
LEAST_SHARE, LEAST_KNOWN = 0.2, 0.5


def _name(doc_id: str, sha: str | Column) -> Column:
    """The name of a document, from its id and the hexadecimal SHA-256 of its text."""
    return F.concat_ws(":", sha, F.col(doc_id).cast("long").cast("string"))


def _named(docs: DataFrame) -> DataFrame:
    """name, and the row as it came."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.sha2(text_or_empty(), 256).alias("sha")).select(_name("id", "sha").alias("name"), "row")


def _keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose decision (name, kept) is true, one for each name."""
    doubtful = cut_lineage(decisions.groupBy("name").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1").select("name", "kept"))
    flagged = maybe_in(_named(docs), "name", doubtful.select("name"))
    once = flagged.filter("maybe").groupBy("name").agg(F.first("row").alias("row"))
    rest = once.join(doubtful, "name", "left").filter("coalesce(kept, true)")
    return flagged.filter("not maybe").select("row.*").unionByName(rest.select("row.*"))


def identified(docs: DataFrame) -> DataFrame:
    """Documents in a language that can be told, by a model of the given labels.

    Rejected are texts without letters, letter junk, texts in languages that are not near a learned one, and mixtures of so many that none has a share.
    """
    model = languages.learn(docs)
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), languages.told(model)("text").alias("told"))
    spoken = (F.col("told.lang_pred") != languages.UNKNOWN) & (F.col("told.known") >= LEAST_KNOWN) & (F.col("told.score") * F.col("told.known") >= LEAST_SHARE)
    return told.filter(spoken).select("row.*")


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each exact text."""
    return _keep(docs, exact_dedup.exact_classes(docs).select(_name("doc_id", "text_sha256").alias("name"), "kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    first = (F.col("text_key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return _keep(docs, near.classes(docs).select(_name("doc_id", F.lower(F.hex("text_key"))).alias("name"), first.alias("kept")))


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them."""
    told = mixing.mix(docs, keep_text_key=True).select(_name("doc_id", "text_key").alias("name"), "times")
    times = cut_lineage(told.groupBy("name").agg(F.max("times").alias("times"), F.count("*").alias("n")))
    taken = join_groups(_named(docs), times, "name", "n").filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass")).select("row.*")


def tokenised(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens, and decoded, the text that the ids give back."""
    return pieces.encode(docs, model, decode=True).withColumn("n_tokens", F.size("ids").cast("long"))
