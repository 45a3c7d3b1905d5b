"""Paged services as Spark sources: each page is a partition, fetched by the task that reads it.

    register(spark)
    spark.read.format("paged_layer").option("url", "https://host/layer").load()
    spark.readStream.format("paged_series").option("url", "https://host/series").load()

The driver asks for the number of rows only.  A page that fails is fetched again by its task, and then by Spark's own
retries; what other tasks have read stays.  As a stream, an offset is the number of rows read so far, so a query that
is started again goes on where its checkpoint ends, and rows that a service has added since are its next batch.
Services must list rows in one order to which they only append, as with ids that grow.

Rows are (pos, page, feature): the row's number, its page, and the row as JSON.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "pos bigint, page bigint, feature string"
#: Answers that may be better the next time.
AGAIN = (408, 429, 500, 502, 503, 504)


class PageError(Exception):
    """A page that a service did not give."""


class Page(InputPartition):
    def __init__(self, number: int, start: int, rows: int):
        super().__init__(number)
        self.number, self.start, self.rows = number, start, rows


class _Service:
    """What both kinds share: requests with retries.  ``key_env`` names the variable of the tasks' environment that
    holds a key, so that no plan, log or row has it."""

    def __init__(self, options: dict):
        self.url = options["url"].rstrip("/")
        self.tries, self.wait, self.timeout = int(options.get("tries", 4)), float(options.get("waitseconds", 0.5)), float(options.get("timeoutseconds", 60))
        self.size = int(options.get("pagerows", 1000))
        self.key_env = options.get("keyenv")

    def ask(self, path: str = "", **params) -> dict:
        if self.key_env:
            params["api_key"] = os.environ[self.key_env]
        said = None
        for k in range(self.tries):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            try:
                with urllib.request.urlopen(f"{self.url}{path}?{urllib.parse.urlencode(params)}", timeout=self.timeout) as r:
                    doc = json.loads(r.read())
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN:
                    raise PageError(f"the service answered {e.code}") from None
                said = e.code
                continue
            except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
                said = type(e).__name__
                continue
            if isinstance(doc, dict) and "error" in doc:
                raise PageError(f"the service says {doc['error']}")
            return doc
        raise PageError(f"no answer after {self.tries} tries, the last was {said}")


class LayerService(_Service):
    """A feature layer: its count, then resultOffset and resultRecordCount, in the order of its object ids."""

    def total(self) -> int:
        return int(self.ask("/0/query", where="1=1", returnCountOnly="true", f="json")["count"])

    def plan(self) -> None:
        meta = self.ask("/0", f="json")
        self.size = min(self.size, int(meta.get("maxRecordCount") or self.size))
        self.order = meta.get("objectIdField") or "OBJECTID"

    def rows(self, start: int, n: int) -> list:
        return self.ask("/0/query", where="1=1", outFields="*", f="geojson", orderByFields=self.order, resultOffset=start, resultRecordCount=n).get("features") or []


class SeriesService(_Service):
    """A keyed series: offset and length, and the total beside the data."""

    def total(self) -> int:
        return int((self.ask(offset=0, length=1).get("response") or {}).get("total") or 0)

    def plan(self) -> None:
        pass

    def rows(self, start: int, n: int) -> list:
        return (self.ask(offset=start, length=n).get("response") or {}).get("data") or []


def _pages(size: int, start: int, end: int) -> list[Page]:
    """Pages of equal places whatever the stretch, so that a page has the same number in every run."""
    out, at = [], start
    while at < end:
        stop = min(end, (at // size + 1) * size)
        out.append(Page(at // size, at, stop - at))
        at = stop
    return out


def _read(service, page: Page | None) -> Iterator[tuple]:
    got = 0
    while page is not None and got < page.rows:  # a service may give fewer rows at once than asked for
        rows = service.rows(page.start + got, page.rows - got)[: page.rows - got]
        if not rows:
            raise PageError(f"page {page.number} has {got} of {page.rows} rows")
        for i, row in enumerate(rows, got):
            yield page.start + i, page.number, json.dumps(row)
        got += len(rows)


class _Reader(DataSourceReader):
    def __init__(self, service):
        self.service = service
        service.plan()

    def partitions(self) -> list[Page]:
        return _pages(self.service.size, 0, self.service.total())

    def read(self, partition: Page) -> Iterator[tuple]:
        return _read(self.service, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, service):
        self.service = service
        service.plan()

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.service.total()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return _pages(self.service.size, start["rows"], end["rows"])

    def read(self, partition: Page) -> Iterator[tuple]:
        return _read(self.service, partition)


class _Paged(DataSource):
    service: type

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.service({k.lower(): v for k, v in self.options.items()}))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.service({k.lower(): v for k, v in self.options.items()}))


class PagedLayer(_Paged):
    """Options: url, pageRows, tries, waitSeconds, timeoutSeconds, keyEnv."""

    service = LayerService

    @classmethod
    def name(cls) -> str:
        return "paged_layer"


class PagedSeries(_Paged):
    """Options as for ``paged_layer``."""

    service = SeriesService

    @classmethod
    def name(cls) -> str:
        return "paged_series"


def register(spark: SparkSession) -> None:
    for source in (PagedLayer, PagedSeries):
        spark.dataSource.register(source)
