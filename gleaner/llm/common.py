"""What the operators share: reading tables, word rules, durable tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of every contract: the six ASCII space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the
    session, else the context's checkpoint folder, else, on a local master only, one
    in /tmp.  A cluster without such a folder would lose what a lost machine held."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (set_dir or "/tmp/checkpoints/gleaner").rstrip("/")


#: Paths that save() has written inside the innermost ``released``, if there is one.
_INSIDE: ContextVar[list[str] | None] = ContextVar("inside", default=None)


def save(df: DataFrame, name: str, rows: int = 1_000, size: str = "8m") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back:
    lineage ends there, and a lost executor costs nothing that was written.
    Meanwhile Python workers get at most ``rows`` rows and ``size`` at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        if (inside := _INSIDE.get()) is not None:
            inside.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes, on leaving, the tables that save() wrote inside and no others; what is
    still to be read of them has to be written elsewhere before."""
    token = _INSIDE.set(inside := [])
    try:
        yield
    finally:
        _INSIDE.reset(token)
        for path in inside:
            _remove(spark, path)


def drop_saved(spark: SparkSession) -> None:
    """Removes every table that save() wrote under the shared folder; call it
    when no result that reads them is needed any more."""
    _remove(spark, f"{shared_dir(spark)}/gleaner")


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Without the six space characters at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def words(c: Column) -> Column:
    """Array of the words of a non-null string; an empty one has no word."""
    cut = trimmed(c)
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, SPACE + "+"))


def n_words(c: Column) -> Column:
    """Number of words as long; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> list[Column]:
    """What tells rows of one doc_id, or of none, apart: 128 bits of their text, as
    the columns ``key_a`` and ``key_b``.  Rows that repeat a doc_id and a text share it."""
    return [F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b")]


def unique(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def keep_rows(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose (doc_id, key_a, key_b) is (left_semi) or isn't (left_anti) in
    ``ids``, null-safe: a decision on one row touches no other of its doc_id.  The ids
    build the hash table, so texts are dealt out at most once and never sorted; Spark
    broadcasts the ids instead while they are under its own measured threshold."""
    i, a, b, x, y = map(unique, ("id", "a", "b", "x", "y"))
    ids = ids.select(F.col("doc_id").alias(i), F.col("key_a").alias(a), F.col("key_b").alias(b)).distinct().hint("shuffle_hash")
    mine, mine_too = row_key()
    keyed = docs.select("*", mine.alias(x), mine_too.alias(y))
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.col(x) == F.col(a)) & (F.col(y) == F.col(b))
    return keyed.join(ids, same, how).drop(x, y)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` as the side of a join that both sides are dealt out by key for.  Spark
    broadcasts a table by its packed size, but the driver builds it unpacked, and for rows
    that grow with the documents that is many times its threshold."""
    return rows.hint("merge")


#: A key is hot if it has more rows than this, and more than one in HOT_SHARE of all:
#: there are at most HOT_SHARE such keys, whatever the size of the data.
HOT_ROWS = 500
HOT_SHARE = 1_000


def hot_keys(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, parts) of the hot keys of ``counts`` (key, c) of a table of ``rows``
    rows: at most HOT_SHARE rows, so they may be broadcast."""
    limit = max(HOT_ROWS, rows // HOT_SHARE)
    return counts.where(F.col("c") > limit).select(key, F.ceil(F.col("c") / limit).cast("int").alias("parts"))


def salted_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has each key once.  The rows of a hot key
    are dealt by the hash of ``by`` into its parts, and ``one``'s row is copied into
    each, so no task meets all rows of a key."""
    k, n, salt = unique("key"), unique("parts"), unique("salt")
    hot = F.broadcast(hot.select(F.col(key).alias(k), F.col("parts").alias(n)))
    left = many.join(hot, F.col(key) == F.col(k), "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(n)), F.lit(0)).cast("int")).drop(k, n)
    right = one.join(hot, F.col(key) == F.col(k), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))).drop(k, n)
    return left.join(right, [key, salt], how).drop(salt)
