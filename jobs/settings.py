"""What the jobs' command lines share: settings from a small JSON file, logging."""

from __future__ import annotations

import json
import logging
from dataclasses import fields

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def read_settings(spark: SparkSession, path: str | None, kind: type):
    """``kind`` (a dataclass) with the values of a JSON file, which Spark reads, so
    any path it knows will do.  Names that the job doesn't have are an error."""
    values = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    unknown = sorted(set(values) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**values)


def log_to_terminal() -> None:
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    LOG.setLevel(logging.INFO)
