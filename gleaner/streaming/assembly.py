"""Documents from pages that arrive in any order: a document goes on when its pages are
in, once, and its chunks are made once; no source is written again.

Pages say how many their document has (``n_pages``, null if unknown) and when they were
seen.  They wait in the state of their source.  The document is complete when as many
pages are there; one that isn't goes on as it is when ``wait`` has passed in event time
since its last page.  A page that comes twice before that keeps its later text (of
equal times the greatest); one that comes after its document went on is passed on as
late, unless it says the same again.  Pages without a source or number are dropped.  One
source's pages are one state key; a task holds one page more than what it gives out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.plans.retrieve import chunks_of
from gleaner.sources.files import clean_pages

PAGE = "source string, file_path string, page int, text string, n_pages int, seen timestamp"
#: ``state``: complete, partial (the wait was over) or late.
OUT = "source string, file_path string, page int, text string, state string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


class Assembly(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "file_path string, text string, seen long")
        self.facts = handle.getValueState("facts", "n_pages int, timer long, done boolean")

    def _given(self, source: str, state: str) -> Iterator[pd.DataFrame]:
        """The pages in order; their texts are kept as digests from here on."""
        for (page,) in sorted(self.pages.keys()):
            file_path, text, seen = self.pages.getValue((page,))
            yield pd.DataFrame({"source": [source], "file_path": [file_path], "page": [page], "text": [text], "state": [state]})
            self.pages.updateValue((page,), (file_path, _digest(text), seen))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (source,) = key
        expected, timer, done = self.facts.get() or (0, 0, False)
        latest = 0
        for batch in rows:
            for file_path, page, text, n_pages, seen in zip(batch["file_path"], batch["page"], batch["text"], batch["n_pages"], batch["seen"], strict=True):
                page, text, at = int(page), text or "", int(pd.Timestamp(seen).timestamp() * 1000)
                latest, expected = max(latest, at), max(expected, 0 if pd.isna(n_pages) else int(n_pages))
                before = self.pages.getValue((page,)) if self.pages.containsKey((page,)) else None
                if done:
                    if before is None or before[1] != _digest(text):
                        self.pages.updateValue((page,), (file_path, _digest(text), at))
                        yield pd.DataFrame({"source": [source], "file_path": [file_path], "page": [page], "text": [text], "state": ["late"]})
                elif before is None or (at, text) >= (before[2], before[1]):
                    self.pages.updateValue((page,), (file_path, text, at))
        if done:
            return
        if timer:
            self.handle.deleteTimer(timer)
        if expected and sum(1 for _ in self.pages.keys()) >= expected:
            yield from self._given(source, "complete")
            self.facts.update((expected, 0, True))
        else:
            timer = max(latest, timer - self.wait_ms, timerValues.getCurrentWatermarkInMs()) + self.wait_ms
            self.handle.registerTimer(timer)
            self.facts.update((expected, timer, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, timer, done = self.facts.get()
        if not done and expiredTimerInfo.getExpiryTimeInMs() == timer:
            yield from self._given(key[0], "partial")
            self.facts.update((expected, 0, True))

    def close(self) -> None:
        pass


def assembled(pages: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """OUT rows of a stream of PAGE rows."""
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    rows = pages.where("source is not null and page is not null and seen is not null").withWatermark("seen", "0 seconds")
    return rows.groupBy("source").transformWithStateInPandas(statefulProcessor=Assembly(ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start in the block keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def chunk_documents(spark: SparkSession, folder: str, out: str, checkpoint: str, wait: str = "10 minutes"):
    """Starts a query over the JSON files in ``folder`` that adds the chunks of each document
    to ``out``, by batch, and late pages to ``out``-late.  A repeated batch writes its own
    partition again."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            whole = clean_pages(batch.where("state <> 'late'").drop("state"))
            for rows, path in ((chunks_of(whole), out), (batch.where("state = 'late'").drop("state"), f"{out}-late")):
                rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        finally:
            batch.unpersist()

    with rocks(spark):
        stream = assembled(spark.readStream.schema(PAGE).json(folder), wait)
        return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
