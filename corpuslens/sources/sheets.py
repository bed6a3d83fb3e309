"""Blind sheets for annotators as CSV, since workbooks need a library that isn't here: rows in a hashed order with codes, and their reading back, which
lists every fault at once."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.guards import leaks
from corpuslens.operators.sampling import hash_order
from corpuslens.sources.files import read_csv, write_csv


def write_sheets(rows: DataFrame, folder: str, by: str, code: str, shown: Sequence[str], seed: str) -> list[str]:
    """One CSV for each annotator in the column ``by``: code, the shown columns, empty label and note, in an order that tells nothing."""
    out = []
    for (name,) in rows.select(by).distinct().orderBy(by).collect():
        if not re.fullmatch(r"[A-Za-z0-9_-]+", str(name)):
            raise ValueError("an annotator's name is a file's name")
        own = rows.filter(F.col(by) == name).select(hash_order(f"{seed}:{name}", code).alias("order__"), code, *shown, F.lit("").alias("label"), F.lit("").alias("note"))
        write_csv(own, f"{folder}/{name}", ["order__"])
        out.append(str(name))
    return out


def read_sheet(spark: SparkSession, path: str, code: str, shown: Sequence[str], levels: Sequence[str], expected: DataFrame) -> tuple[DataFrame, list[str]]:
    """(labels (code, label, note), faults): unknown, repeated and missing codes, missing labels, labels off the scale."""
    schema = ", ".join(f"{c} string" for c in ("order__", code, *shown, "label", "note"))
    rows = read_csv(spark, path, schema).select(code, F.trim("label").alias("label"), "note")
    known = expected.select(code).distinct()
    n = {
        "codes are unknown": rows.join(known, code, "left_anti").count(),
        "codes are missing": known.join(rows, code, "left_anti").count(),
        "codes are repeated": rows.groupBy(code).count().filter("count > 1").count(),
        "labels are missing": rows.filter("label is null or label = ''").count(),
        "labels are off the scale": rows.filter((F.col("label") != "") & ~F.col("label").isin(list(levels))).count(),
    }
    return rows, [f"{v} {k}" for k, v in n.items() if v]


def missing_levels(labels: DataFrame, levels: Sequence[str]) -> list[str]:
    """Levels of the scale that nobody used."""
    used = {r.label for r in labels.select("label").distinct().collect()}
    return [x for x in levels if x not in used]


def notes_with(labels: DataFrame, code: str, needles: DataFrame) -> int:
    """How many notes hold one of the sensitive strings."""
    return leaks(labels.filter("note is not null"), code, "note", needles).select("id").distinct().count()
