"""Searching for articles and fetching what is known of them, by URL templates: a service's, or file URLs of its kept answers.

A search is a table: every page of every topic and licence is a fetch of its own, dealt to as many tasks as the service may be asked by at once. What the
answers hold is taken out by built-in functions. The interval between requests is the service's, over all tasks together.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loam.config import LICENCE_FILTERS
from loam.functions import text as T
from loam.sources.articles import INTEGRITY

#: Attempts at a request; the wait between them doubles.
ATTEMPTS = 3


class Client:
    """Requests one after the other, at least ``interval`` seconds apart."""

    def __init__(self, interval: float = 0.0, timeout: float = 60.0):
        self.interval, self.timeout, self.last = interval, timeout, 0.0

    def get(self, url: str) -> bytes:
        """What is there; None of a service's errors is passed over, but those that may pass are met with another attempt."""
        for attempt in range(ATTEMPTS):
            time.sleep(max(0.0, self.last + self.interval * 2**attempt - time.monotonic()))
            self.last = time.monotonic()
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as r:
                    return r.read()
            except urllib.error.HTTPError as e:
                if attempt == ATTEMPTS - 1 or e.code != 429 and e.code < 500:
                    raise
            except urllib.error.URLError as e:
                if attempt == ATTEMPTS - 1 or isinstance(e.reason, FileNotFoundError):
                    raise
        raise AssertionError


def filled(template: str, **values) -> str:
    return template.format(**{k: urllib.parse.quote(str(v), safe="") for k, v in values.items()})


@dataclass
class _Pages(InputPartition):
    pages: list[tuple[str, str, str, int]]


class ArticleSearch(DataSource):
    """Rows (topic, licence, page, body), the service's answer to each page of each search.

    Options: ``url``, a template of {topic}, {licence}, {query}, {start} and {size}; ``searches``, JSON of [[topic, query], ...]; ``size`` of a page (100); ``most``,
    the articles of a search that are asked for (250); ``tasks`` (1), which share the requests; ``interval``, seconds between any two requests (0.36).
    """

    @classmethod
    def name(cls) -> str:
        return "article_search"

    def schema(self) -> str:
        return "topic string, licence string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader({k.lower(): v for k, v in self.options.items()})


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.searches = options["url"], json.loads(options["searches"])
        self.size, self.most = int(options.get("size", 100)), int(options.get("most", 250))
        self.tasks, self.interval = int(options.get("tasks", 1)), float(options.get("interval", 0.36))
        if min(self.size, self.most, self.tasks) < 1 or self.interval < 0:
            raise ValueError("size, most and tasks must be positive, and the interval not negative")

    def partitions(self) -> list[_Pages]:
        pages = [
            (topic, licence, f"({q}) AND {f} {INTEGRITY}", start)
            for topic, q in self.searches for licence, f in LICENCE_FILTERS.items() for start in range(0, self.most, self.size)
        ]
        return [_Pages(pages[k :: self.tasks]) for k in range(min(self.tasks, len(pages)))]

    def read(self, part: _Pages) -> Iterator:
        client = Client(self.interval * self.tasks)
        over = set()
        for topic, licence, q, start in part.pages:
            if (topic, licence) not in over:
                body = client.get(filled(self.url, topic=topic, licence=licence, query=q, start=start, size=min(self.size, self.most - start))).decode()
                if not json.loads(body).get("esearchresult", {}).get("idlist"):
                    over.add((topic, licence))
                yield topic, licence, start // self.size, body


def search(spark: SparkSession, url: str, searches: Sequence[tuple[str, str]], **options) -> DataFrame:
    """(topic, licence, rank, id): the articles that each search finds, ranked from 0 by the service's order; a row for every search that finds it."""
    spark.dataSource.register(ArticleSearch)
    size = int(options.get("size", 100))
    pages = spark.read.format("article_search").options(url=url, searches=json.dumps([[t, q] for t, q in searches]), **options).load()
    ids = F.from_json("body", "esearchresult struct<idlist: array<string>>")["esearchresult"]["idlist"]
    found = pages.select("topic", "licence", "page", F.posexplode(ids).alias("i", "id"))
    return found.select("topic", "licence", (F.col("page") * size + F.col("i")).alias("rank"), "id")


def fetched(ids: DataFrame, url: str, tasks: int = 1, interval: float = 0.36) -> DataFrame:
    """``ids`` (id) to (id, body, error): what is at ``url``, a template of {id}, once for each distinct id; an article that can't be had has an error and no body."""

    def run(batches):
        client = Client(interval * tasks)
        for b in batches:
            rows = []
            for i in b.column("id").to_pylist():
                try:
                    rows.append((i, client.get(filled(url, id=i)).decode(), None))
                except (OSError, UnicodeDecodeError) as e:
                    rows.append((i, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, names=["id", "body", "error"])

    once = ids.select(F.col("id").cast("string").alias("id")).filter("id IS NOT NULL").distinct().repartition(tasks)
    return once.mapInArrow(run, "id string, body string, error string")


def record(xml: Column) -> Column:
    """Of an article's XML record, its texts of rights, language, title and identifier; of a header's fields of the same names, none."""

    def texts(field: str) -> Column:
        found = F.xpath(xml, F.lit(f"//*[local-name()='metadata']//*[local-name()='{field}']/text()"))
        return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), T.strip), lambda x: x != "").alias(field)

    return F.struct(*[texts(f) for f in ("rights", "language", "title", "identifier")])
