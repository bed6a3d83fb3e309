"""Plain files around a job: CSV and report sinks, matrices as tables, a run lock, ports to page texts and encoders."""

from __future__ import annotations

import contextlib
import fcntl
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.guards import require


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One ordered CSV with a header, for small tables."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV that must have the columns of the schema; what can't be read stops the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def dense(df: DataFrame, size: int) -> DataFrame:
    """A matrix as rows (id, vec) of one length without gaps."""
    return require(df, {f"vectors have {size} entries": F.size("vec") == size, "entries are numbers": F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))})


def sparse(df: DataFrame) -> DataFrame:
    """A matrix as cells (doc, term, weight): no zero, no repeated cell."""
    if df.groupBy("doc", "term").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("a cell is repeated")
    return require(df, {"weights are not zero": (F.col("weight") != 0) & ~F.isnan("weight")})


@contextlib.contextmanager
def exclusive_run(folder: str) -> Iterator[None]:
    """Holds the driver's lock on a folder; a second job is refused at once."""
    with (Path(folder) / ".lock").open("w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError(f"{folder} is in use") from None
        yield


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as Markdown; larger ones are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are not a report")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


PAGES = "doc string, page int, text string, source string"


def page_texts(spark: SparkSession, path: str, read_pages: Callable[[bytes], list[str]], read_image: Callable[[bytes, int], str] | None = None, least: int = 50, window: int = 100) -> DataFrame:
    """Page texts of binary files through ports: ``read_pages`` gives the text layer, ``read_image`` reads a page that has too little text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for page, text in enumerate(read_pages(content)):
                    low = len(text.strip()) < least and page < window and read_image is not None
                    seen = read_image(content, page) if low else ""
                    chosen = (seen, "ocr") if seen.strip() else (text, "text_layer")
                    rows.append((name, page, chosen[0], chosen[1] if chosen[0].strip() else "empty"))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "source"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)


def encode(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors of the distinct texts (cache_key, text) through a port that is called once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "vec": encoder(batch["text"].tolist())})

    return texts.dropDuplicates(["cache_key"]).select("cache_key", "text").mapInPandas(run, "cache_key string, vec array<double>")
