"""Classes of a repository's records: document type, access, source format, files, inclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.metadata import after_last, values

# Access rights that close a document, by code, with the classes they give; the code of open access.
CLOSING = {"c_f1cf": "embargoed", "c_16ec": "restricted", "c_14cb": "metadata_only"}
OPEN = "c_abf2"


def document_type(types: Column, thesis: str) -> Column:
    """``thesis`` for the exact fragment; another spelling of it or a word for it by fold; else other; null without a type."""
    found = values(types)
    exact = F.exists(found, lambda t: after_last(t) == thesis)
    spelled = F.exists(found, lambda t: F.lower(after_last(t)).isin(thesis.lower(), "thesis", "tesis"))
    return F.when(F.size(found) == 0, F.lit("(none)")).when(exact, "thesis").when(spelled, "thesis_other_spelling").otherwise("other")


def access_class(rights: Column) -> Column:
    """The class of the access rights; a closing right wins over open."""
    found = values(rights)
    has = lambda code: F.exists(found, lambda r: after_last(r, "/") == code)
    out = F.when(F.size(found) == 0, F.lit("missing"))
    for code, name in CLOSING.items():
        out = out.when(has(code), name)
    return out.when(has(OPEN), "open").otherwise("unknown")


def source_format(text_pages: Column, ocr_pages: Column) -> Column:
    return F.when((text_pages > 0) & (ocr_pages > 0), "mixed").when(ocr_pages > 0, "ocr").when(text_pages > 0, "digital")


def item_url(handle: Column, item: Column, resolver: str, pages: str) -> Column:
    """The resolver's address of the handle, or the item's own page."""
    return F.coalesce(F.concat(F.lit(resolver), handle), F.concat(F.lit(pages), item))


def joined_parts(*parts: Column) -> Column:
    """Non-empty parts joined by a blank line; null if there is none."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.nullif(F.array_join(kept, "\n\n"), F.lit(""))


def thesis_files(files: Column) -> Column:
    """Files (bundle, name) that may be the document: PDFs of the original bundle, neither a report of similarity nor an authorisation."""
    name = lambda f: F.lower(F.translate(f["name"], "áéíóúÁÉÍÓÚ", "aeiouAEIOU"))
    return F.filter(files, lambda f: (f["bundle"] == "ORIGINAL") & name(f).endswith(".pdf") & ~name(f).endswith(".rt.pdf") & ~name(f).startswith("autoriz"))


def sections(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per section with text: id, section, text."""
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("section"), F.col(c).alias("text")) for c in columns))).alias("s")
    return df.select(id_col, stack).select(id_col, "s.section", "s.text").filter(F.trim("text") != "")


def included(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``include`` and the first reason to exclude a row, in order."""
    first = F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in reasons.items()))
    return df.withColumn("exclusion_reason", first).withColumn("include", F.col("exclusion_reason").isNull())


def points(df: DataFrame, topics: list | None, programs: list | None, with_noise: bool) -> DataFrame:
    """Map points of the chosen topics and programs (none chosen: all), with noise or without."""
    out = df if with_noise else df.filter("label <> -1")
    if topics:
        out = out.filter(F.col("label").isin(topics) | (F.col("label") == -1))
    return out.filter(F.col("program").isin(programs)) if programs else out


def concerned(df: DataFrame, rules: list | None, programs: list | None) -> DataFrame:
    """Gaps of the chosen rules that concern a chosen program: one of its topics' programs, its source, or its target."""
    out = df.filter(F.col("rule").isin(rules)) if rules else df
    if programs:
        every = F.array_compact(F.array_union(F.col("programs"), F.array("source", "target")))
        out = out.filter(F.arrays_overlap(every, F.array(*(F.lit(p) for p in programs))))
    return out
