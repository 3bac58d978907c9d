"""Paged web sources as a Spark data source: pages are read by the tasks, not by the driver.

    spark.dataSource.register(Paged)
    spark.read.format("paged").schema("id long, name string").option("fetch", "module:function").load()

The function gets (offset, limit, options) and returns a list of dicts; the total comes
from its `count` (module:function of options), so that pages are dealt to tasks. In
cursor mode pages follow one another in one task, as the next page's cursor is known only
then.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _function(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int | None):
        self.start, self.stop = start, stop


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the columns with .schema(...)")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options), schema)


class PagedReader(DataSourceReader):
    """Options: fetch, count, page (rows a request), pages (requests a task), mode (offset, page or cursor)."""

    def __init__(self, options: dict, schema):
        self.options, self.schema, self.size = options, schema, int(options.get("page", 1000))

    def partitions(self):
        if self.options.get("mode", "offset") == "cursor" or "count" not in self.options:
            return [_Range(0, None)]
        total, step = _function(self.options["count"])(self.options), self.size * int(self.options.get("pages", 10))
        return [_Range(s, min(total, s + step)) for s in range(0, total, step)] or [_Range(0, 0)]

    def read(self, partition):
        fetch, at, cursor = _function(self.options["fetch"]), partition.start, None
        mode = self.options.get("mode", "offset")
        while partition.stop is None or at < partition.stop:
            limit = self.size if partition.stop is None else min(self.size, partition.stop - at)
            if mode == "cursor":
                rows, cursor = fetch(cursor, limit, self.options)
            else:
                rows = fetch(at // self.size if mode == "page" else at, limit, self.options)
            for r in rows:
                yield tuple(r.get(f.name) for f in self.schema.fields)
            at += len(rows)
            if not rows or (mode == "cursor" and cursor is None) or (mode != "cursor" and len(rows) < limit):
                return


def fetch_json(offset: int, limit: int, options: dict) -> list[dict]:
    """Records of a web service that takes offset and limit and answers with JSON: options url, records (the field that holds the list), timeout."""
    query = urllib.parse.urlencode({"offset": offset, "limit": limit} | json.loads(options.get("params", "{}")))
    with urllib.request.urlopen(f"{options['url']}?{query}", timeout=float(options.get("timeout", 60))) as answer:  # noqa: S310 - the caller names the service
        body = json.load(answer)
    return body[options["records"]] if "records" in options else body


def count_json(options: dict) -> int:
    """The total that the service names: options url, total (a dotted field)."""
    with urllib.request.urlopen(f"{options['url']}?{urllib.parse.urlencode({'limit': 1})}", timeout=float(options.get("timeout", 60))) as answer:  # noqa: S310
        body = json.load(answer)
    for part in options.get("total", "total").split("."):
        body = body[part]
    return int(body)
