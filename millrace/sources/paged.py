"""A source that answers page by page, as a Spark data source: one partition per window, continued, patient, paced.

``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged").option("site", ...)`` or ``readStream``.
Options: ``site``, where the source is; ``ask``, the function "module:name" that asks it (``ask_folder`` by default);
``interval``, seconds between two requests of the whole read; ``parallel``, how many partitions run at once at most;
``tries``.  A source has windows 0, 1, 2 ..., each answered in parts with a token to go on.

The interval is kept by all partitions together: each of ``parallel`` asks every ``parallel * interval`` seconds.  Filters
on ``window`` choose the partitions, so windows that are not wanted are never asked for."""

from __future__ import annotations

import glob
import importlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan, SimpleDataSourceStreamReader

from millrace.sources.connectors import continued, patiently, spaced

SCHEMA = "window int, source_id string, title string, body string"
#: Answers (items, token to go on with or None) of a window, and the number of windows if the window is None.
Ask = Callable[[str, int | None, str | None], tuple[list[dict], str | None] | int]


def ask_folder(site: str, window: int | None, token: str | None, size: int = 50) -> tuple[list[dict], str | None] | int:
    """A site of files as ``publish`` lays them out: ``size`` items a part, the token is where the next one begins."""
    root = site.removeprefix("file:")
    if window is None:
        with open(os.path.join(glob.glob(f"{root}/index/part-*.txt")[0])) as f:
            return int(f.read())
    lines = [line for path in sorted(glob.glob(f"{root}/items/window={window}/part-*.json")) for line in open(path)]  # of one window
    first = int(token or 0)
    return [json.loads(line) for line in lines[first : first + size]], str(first + size) if first + size < len(lines) else None


def publish(docs: DataFrame, site: str, per_window: int) -> str:
    """Lay docs (id long, title, body) out as a site in a shared folder, ``per_window`` ids a window; returns the site."""
    rows = docs.select(F.floor(F.col("id") / per_window).cast("int").alias("window"), F.col("id").cast("string").alias("source_id"), "title", "body")
    rows.repartition("window").sortWithinPartitions("window", F.col("source_id").cast("long")).write.partitionBy("window").json(f"{site}/items")
    docs.agg(F.coalesce(F.floor(F.max("id") / per_window) + 1, F.lit(0)).cast("string").alias("value")).coalesce(1).write.text(f"{site}/index")
    return site


@dataclass
class Window(InputPartition):
    number: int
    parallel: int


class _Asking:
    """What readers share: the options, and a window's rows from parts that are asked for patiently and at intervals."""

    def __init__(self, options: dict):
        module, name = options.get("ask", "millrace.sources.paged:ask_folder").split(":")
        self.ask: Ask = getattr(importlib.import_module(module), name)
        self.site, self.interval, self.tries = options["site"], float(options.get("interval", 0)), int(options.get("tries", 3))
        self.parallel = int(options.get("parallel", 8))

    def windows(self) -> int:
        return patiently(lambda: self.ask(self.site, None, None), self.tries)

    def rows(self, window: int, parallel: int) -> Iterator[tuple]:
        ask = spaced(lambda token: patiently(lambda: self.ask(self.site, window, token), self.tries), self.interval * parallel)
        for item in continued(ask):
            yield (window, item.get("source_id"), item.get("title"), item.get("body"))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.asking, self.low, self.high, self.only = _Asking(options), 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  name of the interface
        for f in filters:
            if getattr(f, "attribute", None) != ("window",):
                yield f
            elif isinstance(f, EqualTo):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, In):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan):
                self.high = f.value if self.high is None else min(self.high, f.value)
            else:
                yield f

    def partitions(self) -> list[Window]:
        n = self.asking.windows()
        found = [w for w in range(self.low, n if self.high is None else min(n, self.high)) if self.only is None or w in self.only]
        return [Window(w, min(self.asking.parallel, len(found))) for w in found]

    def read(self, partition: Window | None) -> Iterator[tuple]:
        if partition is not None:  # Spark asks for None where there is no partition
            yield from self.asking.rows(partition.number, partition.parallel)


class PagedStream(SimpleDataSourceStreamReader):
    """A window a batch; windows that have come since are the next batches."""

    def __init__(self, options: dict):
        self.asking = _Asking(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"window": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["window"] >= self.asking.windows():
            return iter(()), start
        return iter(list(self.asking.rows(start["window"], 1))), {"window": start["window"] + 1}  # of one window

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for window in range(start["window"], end["window"]):
            yield from self.asking.rows(window, 1)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> PagedStream:  # noqa: N802
        return PagedStream(self.options)


def paged(spark: SparkSession, site: str, **options: str) -> DataFrame:
    """The rows of a site; filters on ``window`` are pushed down."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").options(site=site, **options).load()
