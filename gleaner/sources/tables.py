"""Intermediate tables: where a plan has its process boundaries, a written table in
the folder that all executors share ends the lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint
    folder, else, on a local master only, one in /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (folder or "/tmp/checkpoints/gleaner").rstrip("/")


def save(df: DataFrame, name: str, folder: str = "gleaner-tables") -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as a shuffle has, whatever their size:
    a small file of rows that each cost much would be one task, and adaptive execution
    would put small partitions together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{folder}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_saved(spark: SparkSession) -> None:
    """Removes every table that save() wrote; call it when no result that reads them is
    needed any more."""
    _drop(spark, "gleaner-tables")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A save() whose tables are removed at the end of the block."""
    folder = f"gleaner-scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, name: save(df, name, folder)
    finally:
        _drop(spark, folder)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
