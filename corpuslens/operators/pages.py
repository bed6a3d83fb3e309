"""Page texts: running headers, footers and page numbers, found and removed relationally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.metadata import line_key, page_number, stripped


def numbered_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages (doc, page, text): doc, page, line_no, line."""
    return pages.select("doc", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def edges(lines: DataFrame, k: int) -> DataFrame:
    """The first and last k lines of each page that hold more than spaces."""
    up, down = (W.partitionBy("doc", "page").orderBy(o) for o in (F.col("line_no"), F.desc("line_no")))
    full = lines.filter(stripped("line") != "").withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).withColumn("full_lines", F.count("*").over(W.partitionBy("doc", "page")))
    return full.filter((F.col("up") <= k) | (F.col("down") <= k)).withColumn("key", line_key("line")).drop("up", "down")


def running_keys(lines: DataFrame, edge: DataFrame, share: tuple[int, int], least_pages: int) -> DataFrame:
    """Keys of edge lines on at least max(2, ceil(share * pages with text)) pages of a document that has ``least_pages`` of them."""
    with_text = lines.filter(stripped("line") != "").groupBy("doc").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least_pages)
    seen = edge.select("doc", "key", "page").distinct().groupBy("doc", "key").agg(F.count("page").alias("n"))
    needed = F.greatest(F.lit(2), F.expr(f"cast((pages * {share[0]} + {share[1] - 1}) div {share[1]} as bigint)"))
    return seen.join(with_text, "doc").filter(F.col("n") >= needed).select("doc", "key")


def running_edges(lines: DataFrame, k: int, share: tuple[int, int], least_pages: int) -> DataFrame:
    """The edge lines of pages of more than one line, and whether each is ``running``, which digits alone are not."""
    edge = edges(lines, k)
    keys = running_keys(lines, edge, share, least_pages).withColumn("found", F.lit(True))
    running = F.coalesce("found", F.lit(False)) & ~stripped("line").rlike(r"^[0-9]+\z")
    return edge.filter("full_lines > 1").join(keys, ["doc", "key"], "left").withColumn("running", running).drop("found")


def remove_running_lines(pages: DataFrame, k: int = 3, share: tuple[int, int] = (3, 10), least_pages: int = 5) -> DataFrame:
    """doc, page, text without running lines and page numbers at its edges, lines_removed. A page of one line keeps it; digits alone go
    only as a page number."""
    lines = numbered_lines(pages)
    gone = running_edges(lines, k, share, least_pages).filter(page_number("line") | F.col("running")).select("doc", "page", "line_no", F.lit(1).alias("gone"))
    marked = lines.join(gone, ["doc", "page", "line_no"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("line_no", "line"))))
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\s+", ""), r"\s+$", "")
    return marked.groupBy("doc", "page").agg(text.alias("text"), F.coalesce(F.sum("gone"), F.lit(0)).alias("lines_removed"))


def running_counts(pages: DataFrame, k: int = 3, share: tuple[int, int] = (3, 10), least_pages: int = 5) -> DataFrame:
    """page, running: how many of its edge lines are running lines; page numbers that are none don't count. One row a page, whichever documents it
    is in; rows that repeat a document and page each count all its lines."""
    found = running_edges(numbered_lines(pages), k, share, least_pages).groupBy("doc", "page").agg(F.count_if("running").alias("running"))
    return pages.join(found, ["doc", "page"], "left").groupBy("page").agg(F.coalesce(F.sum("running"), F.lit(0)).alias("running"))
