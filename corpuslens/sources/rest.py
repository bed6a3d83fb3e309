"""A paged REST listing as a Spark data source: one partition a collection, one request a page, retries with back-off.

``fetch(url)`` is a port: the default uses urllib; tests pass their own. Options: url (with {collection} and {page}), collections (comma-separated),
retries. Rows are (collection, page, item) with the item as JSON text.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that a retry won't change, and the most pages of a collection.
FINAL, MOST_PAGES = (401, 403, 404), 100


def open_url(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as answer:
        return answer.read()


def patient(fetch: Callable[[str], bytes], url: str, retries: int, pause: float = 0.5) -> bytes:
    """Tries again after network errors, 429 and 5xx, doubling the pause; other answers are final."""
    for attempt in range(retries + 1):
        try:
            return fetch(url)
        except urllib.error.HTTPError as e:
            if e.code in FINAL or (e.code != 429 and e.code < 500) or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                raise
        time.sleep(pause * 2**attempt)
    raise AssertionError


def listing(fetch: Callable[[str], bytes], url: str, collection: str, retries: int = 3) -> Iterator[tuple[str, int, str]]:
    """All items of a collection; a changed total or a repeated item is an error."""
    total, seen, page = None, set(), 0
    while True:
        if page >= MOST_PAGES:
            raise ValueError(f"{collection}: more than {MOST_PAGES} pages")
        body = json.loads(patient(fetch, url.format(collection=collection, page=page), retries))
        if total not in (None, body["total"]):
            raise ValueError(f"{collection}: the total changed from {total} to {body['total']}")
        total = body["total"]
        for item in body["items"]:
            if item["uuid"] in seen:
                raise ValueError(f"{collection}: {item['uuid']} is repeated")
            seen.add(item["uuid"])
            yield collection, page, json.dumps(item, sort_keys=True)
        if len(seen) >= total or not body["items"]:
            break
        page += 1
    if len(seen) != total:
        raise ValueError(f"{collection}: {len(seen)} items, {total} reported")


class Collection(InputPartition):
    def __init__(self, name: str):
        self.name = name


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Collection]:
        return [Collection(c) for c in self.options["collections"].split(",")]

    def read(self, partition: Collection) -> Iterator[tuple]:
        yield from listing(open_url, self.options["url"], partition.name, int(self.options.get("retries", 3)))


class RestListing(DataSource):
    """``spark.dataSource.register(RestListing)``; ``spark.read.format("rest_listing").options(...)``."""

    @classmethod
    def name(cls) -> str:
        return "rest_listing"

    def schema(self) -> str:
        return "collection string, page int, item string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)
