"""Requests to an outside service, answered once: a Parquet ledger of what was answered.

Equal prompts to one model are one request, named by a hash.  Each run asks what the
ledger lacks, in rounds: a round's requests are dealt to a fixed number of tasks, each
of which keeps to its share of the rate and tries again after a failure, waiting
longer each time.  A round is appended when it is done, so a job that dies loses one round
at most, and the next run goes on from there.  A request that failed ``tries`` times in
``runs`` runs is left with its error.

Null prompts are no requests and have no answer.  Repeated rows are answered alike.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from gleaner.sources.services import Encoder, Generator, Reranker
from gleaner.sources.tables import stored

LEDGER = "request string, answer string, error string, tries int"


def request_id(prompt: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), prompt), 256)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(request, answer, error, runs): one row a request, answered or last failed."""
    rows = stored(spark, path, LEDGER)
    return rows.groupBy("request").agg(F.max("answer").alias("answer"), F.max("error").alias("error"), F.count("*").alias("runs")).withColumn("error", F.when(F.col("answer").isNull(), F.col("error")))


def _asking(generator: Generator, tries: int, wait: float, pause: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = -1e9
        for rows in batches:
            for request, prompt in zip(rows["request"], rows["prompt"], strict=True):
                answer = error = None
                n = 0
                while answer is None and n < tries:
                    time.sleep(max(0.0, last + pause - time.monotonic(), wait * 2 ** (n - 1) if n else 0.0))
                    last, n = time.monotonic(), n + 1
                    try:
                        answer, error = generator(prompt), None
                    except Exception as e:  # a service's failure is a result here
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"request": [request], "answer": [answer], "error": [error], "tries": [n]})

    return run


def answered(prompts: DataFrame, generator: Generator, path: str, model: str = "", rounds: int = 10, tasks: int = 8, tries: int = 3, runs: int = 3, wait: float = 0.5, rate: float | None = None) -> DataFrame:
    """(query_id, answer, error) of ``prompts`` (query_id, prompt).  ``rate``: requests
    a second of all tasks together.  The ledger at ``path`` is brought up to date first."""
    spark = prompts.sparkSession
    asked = prompts.where("prompt is not null").select(request_id(F.col("prompt"), model).alias("request"), "prompt").dropDuplicates(["request"])
    settled = ledger(spark, path).where(F.col("answer").isNotNull() | (F.col("runs") >= runs)).select("request")
    open_ = asked.join(settled, "request", "left_anti").withColumn("round", F.pmod(F.xxhash64("request"), F.lit(rounds)))
    ask = _asking(generator, tries, wait, tasks / rate if rate else 0.0)
    for n in sorted(r["round"] for r in open_.select("round").distinct().collect()):  # ``rounds`` numbers at most
        mine = open_.where(F.col("round") == n).select("request", "prompt").repartition(tasks, "request")
        mine.mapInPandas(ask, LEDGER).write.mode("append").parquet(path)
    known = ledger(spark, path)
    rows = prompts.withColumn("request", request_id(F.col("prompt"), model))
    return rows.join(known, "request", "left").select("query_id", "answer", "error")


def batch_encoder(make: Callable[[], Encoder], batch: int = 32) -> Callable[[Column], Column]:
    """text -> vector (array<float>): a model that each worker makes once."""

    def loaded():
        encoder = make()
        return lambda texts: np.asarray(encoder(["" if t is None else str(t) for t in texts]), np.float32)

    return predict_batch_udf(loaded, return_type=ArrayType(FloatType()), batch_size=batch)


def batch_scorer(make: Callable[[], Reranker], batch: int = 32) -> Callable[[Column, Column], Column]:
    """(question, text) -> score, for ranking.rerank(): a cross-encoder that each
    worker makes once."""

    def loaded():
        reranker = make()
        return lambda questions, texts: np.asarray(reranker(list(zip(map(str, questions), map(str, texts), strict=True))), np.float64)

    return predict_batch_udf(loaded, return_type=DoubleType(), batch_size=batch)
