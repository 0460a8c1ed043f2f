"""Paged listings as a data source; retries; dictionaries and lists of posts alike. With ``pages`` each page is a
partition; without it one partition reads pages in order until an empty one, or the cap ``max_pages``, ends the
listing. As a stream, a batch reads the next pages; an empty one is asked for again by the next batch, so that pages
which come later are read, each once."""

from __future__ import annotations

import importlib
import json
import sys
import time
import urllib.request
from pathlib import Path

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

RETRIES, FIRST_WAIT, MORE_WAIT = 4, 1.0, 1.5


def fetch_url(location: str, page: int, limit: int) -> str:
    """The text of a page; ``location`` has {page} and {limit}."""
    with urllib.request.urlopen(location.format(page=page, limit=limit), timeout=60) as answer:
        return answer.read().decode()


def read_file(location: str, page: int, limit: int) -> str:
    """The text of a page kept as a file, <location>/<page>.json, on a mounted folder."""
    with open(f"{location}/{page}.json", encoding="utf-8") as f:
        return f.read()


def read_folder(location: str, page: int, limit: int) -> str:
    """The text of a page that Spark has written below ``location`` (partitioned by page), on a mounted folder; empty
    if there is none."""
    folder = Path(location.removeprefix("file://").removeprefix("file:")) / f"page={page}"
    return "".join(f.read_text(encoding="utf-8") for f in sorted(folder.glob("part-*")))


def posts_of(text: str) -> list[dict]:
    """Posts of an answer: a list, {"post": [...]}, {"posts": [...]} or one post; anything else is none."""
    data = json.loads(text) if text.strip() else []
    if isinstance(data, dict):
        data = data.get("post", data.get("posts", []))
    data = [data] if isinstance(data, dict) else data
    return [p for p in data if isinstance(p, dict)] if isinstance(data, list) else []


class PagedSource(DataSource):
    """Options: location, pages, max_pages, limit, tags, fetcher (module:function, by default urllib); for a stream
    pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, position int, post_id string, post string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagedStreamReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        pages = min(int(self.options.get("pages", 0)), self.cap())
        return [InputPartition(k) for k in range(pages)] or [InputPartition(None)]

    def cap(self) -> int:
        """Pages that are read at most."""
        return int(self.options.get("max_pages", sys.maxsize))

    def read(self, partition):
        if partition.value is not None:
            yield from self.rows(partition.value)
            return
        for page in range(self.cap()):
            rows = list(self.rows(page))
            if not rows:
                return
            yield from rows

    def rows(self, page: int) -> Iterator[tuple[int, int, str, str]]:
        for k, post in enumerate(self.page(page)):
            yield page, k, str(post.get("id", "")), json.dumps(post, sort_keys=True, ensure_ascii=False)

    def page(self, number: int) -> list[dict]:
        """The posts of a page, after some tries."""
        module, _, function = self.options.get("fetcher", "sparloom.sources.pages:fetch_url").partition(":")
        fetch, limit = getattr(importlib.import_module(module), function), int(self.options.get("limit", 100))
        for attempt in range(RETRIES):
            try:
                return posts_of(fetch(self.options["location"], number, limit))
            except (OSError, ValueError):
                if attempt == RETRIES - 1:
                    raise
                time.sleep(FIRST_WAIT + MORE_WAIT * attempt)
        return []


#: Posts of a batch beyond which batches grow no more.
BATCH_POSTS = 50_000


class PagedStreamReader(SimpleDataSourceStreamReader):
    """The offset is the next page to read. The first batch is at most ``pages_per_batch`` pages; each batch that was
    full may be followed by one of twice as many pages, until a batch brings ``BATCH_POSTS`` posts, so a listing of any
    length takes about as many batches as it has times as many posts."""

    def __init__(self, options):
        self.pages = PagedReader(options)
        self.per_batch = int(self.pages.options.get("pages_per_batch", 10))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, page, end = [], start["page"], start["page"] + self.per_batch
        while page < min(self.pages.cap(), end) and len(rows) < BATCH_POSTS:
            found = list(self.pages.rows(page))
            if not found:
                break
            rows += found
            page += 1
        if page == end and 2 * len(rows) <= BATCH_POSTS:
            self.per_batch *= 2
        return iter(rows), {"page": page}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for page in range(start["page"], end["page"]):
            yield from self.pages.rows(page)

    def commit(self, end: dict) -> None:
        """Nothing is held for pages that have been read."""


def append_pages(spark: SparkSession, options: dict[str, str], path: str, checkpoint: str) -> DataFrame:
    """Appends the pages that have come since ``checkpoint`` to the rows in ``path``, and reads these."""
    spark.dataSource.register(PagedSource)
    source = spark.readStream.format("paged").options(**options).load()
    query = source.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(path)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(source.schema).parquet(path)
