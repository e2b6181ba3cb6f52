"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing
to target weights, sharding.  Each stage works on all that its predecessor kept.
Stages decide on rows: doc_id and a 128-bit hash of the text name one, null-safe."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, mixing, neardup, sharding, toxicity
from gleaner.llm.common import keep_rows, released, row_key, save, shared_dir, table, unique

#: Of the draw by which a row gets the part of a copy that blocks cut off.
_SEED = 11
_ROW = ["doc_id", "key_a", "key_b"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject.  Fits on ``docs``.  Each row is decided
    on by itself, also among rows of one doc_id or of none."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rejected = save(toxicity.score(docs, model, keyed=True).where("predicted = 1").select(*_ROW), "toxic-ids")
    return keep_rows(docs, rejected, "left_anti")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest by doc_id, nulls last, and text's hash) of each class
    of near duplicates.  Rows that repeat a doc_id and a text are one document and stay
    together; documents without words are no copies of each other."""
    rest = save(neardup.classes(docs, size=5, percent=80, keyed=True).where("not stays").select(*_ROW), "near-ids")
    return keep_rows(docs, rest, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage like a benchmark item."""
    leaks = save(decontam.find(docs, table(spark, sf_dir, "benchmark"), keyed=True).select(*_ROW), "leak-ids")
    return keep_rows(docs, leaks, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: a row for each whole copy, and one more
    with the probability of the rest.  Rows that repeat a doc_id and a text share what
    the mix takes of them evenly.  Rows without a word stay as they are, once: no mix
    takes words of them."""
    taken = mixing.mix(docs).docs.where("size > 0")
    exact = F.sum("taken") / F.sum("size")
    chance = F.pmod(F.xxhash64(*_ROW, F.lit(_SEED)), F.lit(1_000_000)) / 1e6
    i, a, b, x, y, n, one = map(unique, ("id", "a", "b", "x", "y", "copies", "copy"))
    counts = taken.groupBy(*_ROW).agg(exact.alias("exact")).withColumn("copies", (F.floor("exact") + F.when(chance < F.col("exact") - F.floor("exact"), 1).otherwise(0)).cast("int"))
    counts = save(counts.select(F.col("doc_id").alias(i), F.col("key_a").alias(a), F.col("key_b").alias(b), F.col("copies").alias(n)), "copies").hint("shuffle_hash")
    mine, mine_too = row_key()
    rows = docs.select("*", mine.alias(x), mine_too.alias(y))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.col(x) == F.col(a)) & (F.col(y) == F.col(b))
    copied = rows.join(counts, same, "left").withColumn(one, F.explode(F.array_repeat(F.lit(1), F.coalesce(n, F.lit(1)))))
    return copied.drop(i, a, b, x, y, n, one)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.assign(docs, 16)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Trained scores and iterated components aren't expressible in SQL; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the
    shared folder and read again for the next, and what the stage saved on its way is
    removed."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/gleaner/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with released(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
