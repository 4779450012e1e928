"""Named sources of documents, read through the policy of the source they speak for."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.tables import POLICIES

Reader = Callable[[SparkSession, str], DataFrame]
CONNECTORS: dict[str, Reader] = {}
TIERS = {p[0]: p[1] for p in POLICIES}


def connector(source: str) -> Callable[[Reader], Reader]:
    """Register a reader under the source of a policy."""

    def put(f: Reader) -> Reader:
        if source not in TIERS:
            raise ValueError(f"no policy for source {source}")
        CONNECTORS[source] = f
        return f

    return put


def enabled() -> list[str]:
    return sorted(s for s in CONNECTORS if TIERS[s] != "disabled")


def read(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The documents of a source.  A disabled source is refused; bodies are dropped unless the tier has the full text."""
    if TIERS.get(source) == "disabled":
        raise PermissionError(f"source {source} is disabled")
    docs = CONNECTORS[source](spark, path)
    return docs if TIERS[source] == "full_text" or "body" not in docs.columns else docs.withColumn("body", F.lit(""))


@connector("wiki")
def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a table ``pages`` under path: source_id, title (from the address) and body."""
    pages = spark.read.parquet(f"{path}/pages.parquet")
    return pages.select(F.col("page_id").cast("string").alias("source_id"), F.regexp_extract("url", "([^/]+)/?$", 1).alias("title"), F.col("html").alias("body"))


@connector("guides")
def guide_pages(spark: SparkSession, path: str) -> DataFrame:
    return wiki_pages(spark, path)


@connector("scraped")
def scraped_pages(spark: SparkSession, path: str) -> DataFrame:
    return wiki_pages(spark, path)


def batched(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """(group, batch, ids): what one request asks for, size ids of a group at most, in order."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.select(group, order, F.floor(nth / size).alias("batch")).groupBy(group, "batch").agg(F.sort_array(F.collect_list(order)).alias("ids"))


class Busy(Exception):
    """A source that asks to come again later: status 429 or 5xx, with the seconds it names, if any."""

    def __init__(self, status: int, after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.after = status, after


def patiently[T](call: Callable[[], T], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> T:
    """call(), again when the source is busy or does not answer: after what a 429 names, 60 s at most, else after
    1, 2, 4 ... seconds, 30 at most.  The last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except (Busy, ConnectionError) as e:
            if n == tries - 1:
                raise
            named = e.after if isinstance(e, Busy) and e.status == 429 else None
            wait(min(named, 60.0) if named is not None else min(2.0**n, 30.0))
    raise ValueError("at least one try")


def spaced[**P, T](call: Callable[P, T], interval: float, clock: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable[P, T]:
    """call, at least ``interval`` seconds after its last beginning."""
    last: list[float] = []

    def run(*args: P.args, **more: P.kwargs) -> T:
        if last and (left := last[0] + interval - clock()) > 0:
            wait(left)
        last[:] = [clock()]
        return call(*args, **more)

    return run


def continued(ask: Callable[[str | None], tuple[list, str | None]], most: int = 10_000) -> Iterator:
    """All items of a source that answers in parts, each with where to go on; an end that never comes is an error."""
    token: str | None = None
    for _ in range(most):
        items, token = ask(token)
        yield from items
        if token is None:
            return
    raise ValueError(f"more than {most} parts")


Provider = Callable[[list[str]], list[list[float]]]


def embedded(df: DataFrame, id_col: str, text_col: str, provider: Provider, dim: int, size: int = 96, tries: int = 3) -> DataFrame:
    """(id, embedding) through an outside provider that takes ``size`` texts a call.

    Blank and null texts get a zero vector without a call; a call that fails is tried again later, and
    after ``tries`` the task fails, so that Spark runs it again elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            vectors: list[list[float]] = [[0.0] * dim for _ in texts]
            wanted = [i for i, t in enumerate(texts) if t.strip()]
            for k in range(0, len(wanted), size):
                some = wanted[k : k + size]
                got = patiently(lambda: provider([texts[j] for j in some]), tries)  # noqa: B023
                for i, v in zip(some, got, strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["id", "embedding"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


Answerer = Callable[[list[str]], list[str]]


def answered(df: DataFrame, id_col: str, prompt_col: str, provider: Answerer | None = None, size: int = 16, tries: int = 3) -> DataFrame:
    """(id, answer) of each prompt through an outside model that takes ``size`` prompts a call.

    Without a provider, and for null and blank prompts, the answer is null and nothing is called."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"))
    if provider is None:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(1).to_pylist()
            answers: list[str | None] = [None] * len(prompts)
            wanted = [i for i, p in enumerate(prompts) if p and p.strip()]
            for k in range(0, len(wanted), size):
                some = wanted[k : k + size]
                got = patiently(lambda: provider([prompts[j] for j in some]), tries)  # noqa: B023
                for i, answer in zip(some, got, strict=True):
                    answers[i] = answer
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string())], ["id", "answer"])

    return rows.mapInArrow(run, f"id {kind}, answer string").withColumnRenamed("id", id_col)
