"""A public list of research topics over REST: pages by number until the reported count is reached, complete or nothing."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from corpuslens.sources.rest import patient

MOST_PER_PAGE = 200


def topics(fetch: Callable[[str], bytes], url: str, per_page: int = MOST_PER_PAGE, retries: int = 3) -> Iterator[dict]:
    """Records page by page; a count that changes on the way is an error. ``url`` holds {page} and {per_page}."""
    if not 1 <= per_page <= MOST_PER_PAGE:
        raise ValueError(f"pages have 1 to {MOST_PER_PAGE} records")
    total, seen, page = None, 0, 1
    while total is None or seen < total:
        body = json.loads(patient(fetch, url.format(page=page, per_page=per_page), retries))
        if total not in (None, body["meta"]["count"]):
            raise ValueError(f"the count changed from {total} to {body['meta']['count']}")
        total = body["meta"]["count"]
        if not body["results"]:
            break
        yield from body["results"]
        seen += len(body["results"])
        page += 1


def complete(records: list[dict], reported: int) -> list[dict]:
    """The records, if their ids are different and they are as many as reported."""
    ids = Counter(r["id"] for r in records)
    if len(ids) != len(records):
        raise ValueError(f"{len(records) - len(ids)} records are repeated")
    if len(records) != reported:
        raise ValueError(f"{len(records)} records, {reported} reported")
    return records


def read(fetch: Callable[[str], bytes], url: str, per_page: int = MOST_PER_PAGE, retries: int = 3) -> list[dict]:
    """The whole list."""
    count = json.loads(patient(fetch, url.format(page=1, per_page=1), retries))["meta"]["count"]
    return complete(list(topics(fetch, url, per_page, retries)), count)


def table(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Rows (id, record): the record as compact JSON, its keys in the order given, as the raw snapshot holds it."""
    return spark.createDataFrame([(r["id"], json.dumps(r, ensure_ascii=False, separators=(",", ":"), allow_nan=False)) for r in records], "id string, record string")
