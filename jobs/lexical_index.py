"""Keeps a lexical index of documents up to date as files of them arrive.

    python -m jobs.lexical_index --documents PATH --out PATH --checkpoint PATH [--config FILE]

A file stream takes the Parquet files below ``--documents`` that its checkpoint doesn't
know, some at a time, and stops when there are none left.  Each micro-batch inserts
its documents, replaces those whose id is known, and removes those marked deleted.  Only
the id ranges that a batch touches are written again (``part=`` folders, dynamic partition
overwrite).  A batch that is repeated after a failure writes the same; a run without new
files writes nothing.  Of one id in one batch the greatest text stays; of two
batches, the later.  Files are taken by name: a file that is changed under its old name is
not seen again.

``--out`` gets the tables ``postings`` and ``blocks`` of ``gleaner.operators.lexindex``,
which ``lexindex.search`` and the job ``retrieval_report`` read.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import lexindex
from gleaner.session import session
from jobs.settings import LOG, log_to_terminal, read_settings


@dataclass(frozen=True)
class Settings:
    id_column: str = "doc_id"
    text_column: str = "text"
    deleted_column: str = ""  # a boolean of the input; none by default
    part_ids: int = lexindex.PART_IDS
    block_ids: int = lexindex.BLOCK_IDS
    files_a_batch: int = 200


def as_changes(rows: DataFrame, settings: Settings) -> DataFrame:
    gone = F.col(settings.deleted_column) if settings.deleted_column else F.lit(False)
    return rows.select(F.col(settings.id_column).alias("id"), F.col(settings.text_column).alias("text"), gone.alias("gone"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Takes what is new and waits for the end.  Returns what this run did: batches,
    documents, deleted, and the postings in the parts that it wrote."""
    total = {"batches": 0, "documents": 0, "deleted": 0, "parts": 0, "postings": 0}

    def take(batch: DataFrame, number: int) -> None:
        counts = lexindex.update(batch.sparkSession, out, as_changes(batch, settings), settings.part_ids, settings.block_ids)
        for name, n in {"batches": 1, **counts}.items():
            total[name] += n
        LOG.info("batch %d: took %d documents and %d deletions, wrote %d postings in %d parts", number, *(counts[c] for c in ("documents", "deleted", "postings", "parts")))

    schema = spark.read.parquet(documents).schema
    # With a pattern, Spark's file stream takes a single file as well as a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings.files_a_batch).option("recursiveFileLookup", "true").parquet(f"{documents}{{,}}")
    LOG.info("reading %s, index %s, checkpoint %s", documents, out, checkpoint)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("done: %s", total)
    return total


def whole(spark: SparkSession, out: str) -> DataFrame:
    """Both tables of the index as one: ``kind`` is posting or block."""
    kept = lexindex.postings(spark, out).withColumn("kind", F.lit("posting"))
    return kept.unionByName(lexindex.blocks(spark, out).withColumn("kind", F.lit("block")), allowMissingColumns=True)


def main(argv: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(description="Keeps a lexical index of documents up to date.")
    for name in ("documents", "out", "checkpoint"):
        options.add_argument(f"--{name}", required=True)
    options.add_argument("--config", help="JSON file of settings")
    given = options.parse_args(argv)
    log_to_terminal()
    spark = session("lexical_index")
    try:
        run(spark, given.documents, given.out, given.checkpoint, read_settings(spark, given.config, Settings))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
