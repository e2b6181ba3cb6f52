"""A lexical index that is kept up to date, and exact BM25 over it that skips blocks.

Two Parquet tables below a root, both partitioned by ``part``, a range of ids:

    postings  part, block, token, id, tf, length   one row a token of a document, and one
                                                   with the token EVERY a document
    blocks    part, block, token, df, max_tf, min_length, total_length

A block is a range of ids within a part; its rows say how many documents hold a token,
and bound what one of them can score by it.  Document frequencies, the number of documents
and their lengths are sums over blocks, so they stay exact under inserts, new versions
and deletions without reading other parts.  An update appends to the parts in which it
only has new ids, and writes those again in which it replaces or deletes; it reads and
writes no others.  After an append, a block may have a row of each update for a token.

Ids are whole numbers; rows without one take no part.  A null text is empty, and an
empty document counts.  If an update has an id more than once, its greatest text is
taken, and a text goes before a deletion; deleting what isn't there does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import text as T
from gleaner.operators.retrieval import B, EVERY, FEW_TOKENS, K1, TOKEN_PARTS, inverted, top
from gleaner.sources.tables import save, scratch, stored

POSTINGS = "block long, token string, id long, tf long, length int, part long"
BLOCKS = "block long, token string, df long, max_tf long, min_length int, total_length long, part long"
#: Ids of a part and of a block.
PART_IDS, BLOCK_IDS = 1_000_000, 1_000
#: Parts that an update may touch: their list is broadcast.
MAX_PARTS = 100_000
#: Rows of a file, as long as a part has no more than TOKEN_PARTS of them.
FILE_ROWS = 250_000
#: Queries of a search whose list each block holds.
FEW_QUERIES = 2_000
#: Ids of an update that are broadcast.
FEW_IDS = 1_000_000
#: Blocks that are scored first for a query, to learn which others can matter.
SEEDS = 4
_EACH = ["block", "token", "id", "tf", "length", "part"]


def postings(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, f"{root}/postings", POSTINGS).where("id is not null")


def _bounds_table(spark: SparkSession, root: str) -> DataFrame:
    return stored(spark, f"{root}/blocks", BLOCKS).where("block is not null")


def blocks(spark: SparkSession, root: str) -> DataFrame:
    """The blocks with one row a token."""
    sums = [F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"), F.sum("total_length").alias("total_length")]
    return _bounds_table(spark, root).groupBy("block", "token", "part").agg(*sums)


def latest(changes: DataFrame) -> DataFrame:
    """(id, text, gone): one row an id."""
    rows = changes.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (F.coalesce("gone", F.lit(False)) if "gone" in changes.columns else F.lit(False)).alias("gone"))
    return rows.groupBy("id").agg(F.max(F.struct(~F.col("gone"), "text", "gone")).alias("x")).select("id", "x.text", "x.gone")


def summary(rows: DataFrame, files: int) -> DataFrame:
    """The blocks of postings, dealt by part and file: one shuffle serves their sums and
    their writing."""
    return _dealt(rows.select("part", "block", "token", "tf", "length"), files).groupBy("part", "file", "block", "token").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.sum(F.col("length").cast("long")).alias("total_length")).select("block", "token", "df", "max_tf", "min_length", "total_length", "part", "file")


def _files(rows: DataFrame) -> int:
    """Files a part: so many that one of the largest part of ``rows`` has FILE_ROWS rows, or
    that few parts keep all tasks of a shuffle busy; TOKEN_PARTS at most."""
    size = rows.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("parts")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(TOKEN_PARTS, max(1, -(-(size["most"] or 0) // FILE_ROWS), 2 * tasks // max(size["parts"], 1)))


def _dealt(made: DataFrame, files: int) -> DataFrame:
    """``made`` by part and ``file``, a part's share of tokens."""
    return made.withColumn("file", F.pmod(F.xxhash64("token"), F.lit(files)).cast("int")).repartition("part", "file")


def _write(dealt: DataFrame, path: str, mode: str) -> None:
    dealt.drop("file").sortWithinPartitions("part", "token", "block").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def _and_empty(made: DataFrame, parts: DataFrame, schema: str) -> DataFrame:
    """``made`` and a row without an id for each of ``parts``, so that a part whose last
    document goes is overwritten too."""
    columns = [x.split() for x in schema.split(", ")]
    empty = parts.select(*((F.col(c) if c == "part" else F.lit(None).cast(kind)).alias(c) for c, kind in columns))
    return made.select(*(c for c, _ in columns)).unionByName(empty)


def update(spark: SparkSession, root: str, changes: DataFrame, part_ids: int = PART_IDS, block_ids: int = BLOCK_IDS) -> dict[str, int]:
    """Brings ``changes`` (id, text, and maybe gone, a boolean) into the index at
    ``root``.  Returns numbers of documents taken, deletions asked for, parts and postings
    written.  Doing it again leaves the same, also after a failure half-way: ids that
    are there already make their parts be written again, blocks included."""
    place = lambda ids: F.floor(F.col("id") / ids)
    with scratch(spark) as keep:
        new = keep(latest(changes).withColumn("part", place(part_ids)), "changes")
        counts = new.agg(F.count_if(~F.col("gone")).alias("documents"), F.count_if("gone").alias("deleted")).first().asDict() | {"parts": 0, "postings": 0}
        # Parts are directories: these lists are short and prune the scans.
        touched = keep(new.select("part").distinct(), "touched")
        if (parts := touched.count()) > MAX_PARTS:
            raise ValueError(f"{parts} parts touched at once: ids are too scattered for parts of {part_ids}")
        ids = postings(spark, root).where(F.col("token") == EVERY).join(F.broadcast(touched), "part", "left_semi")
        changed = keep(ids.join(new, "id", "left_semi").select("part").distinct(), "changed")
        # Dealt by id, a document's tokens are counted where it is split.
        fresh = inverted(new.where("not gone").select("id", "text").repartition("id")).withColumn("part", place(part_ids)).withColumn("block", place(block_ids))
        fresh = keep(fresh.select(*_EACH), "fresh")
        if not changed.isEmpty():
            gone = new.select("id")
            gone = F.broadcast(gone) if counts["documents"] + counts["deleted"] <= FEW_IDS else gone
            old = postings(spark, root).join(F.broadcast(changed), "part", "left_semi").join(gone, "id", "left_anti")
            again = old.select(*_EACH).unionByName(fresh.join(F.broadcast(changed), "part", "left_semi").select(*_EACH))
            files = _files(again)
            # The parts that are read are replaced once all is written; the blocks are those
            # of what was written.
            _write(_and_empty(_dealt(again, files), changed, POSTINGS), f"{root}/postings", "overwrite")
            written = postings(spark, root).join(F.broadcast(changed), "part", "left_semi")
            _write(_and_empty(summary(written, files), changed, BLOCKS), f"{root}/blocks", "overwrite")
            counts["parts"], counts["postings"] = changed.count(), written.count()
        added = fresh.join(F.broadcast(changed), "part", "left_anti")
        size = added.agg(F.countDistinct("part").alias("parts"), F.count("*").alias("postings")).first()
        if size["postings"]:  # postings first: blocks without them would be counted twice
            files = _files(added)
            _write(_dealt(added.select(*_EACH), files), f"{root}/postings", "append")
            _write(summary(added, files), f"{root}/blocks", "append")
    return counts | {c: counts[c] + size[c] for c in ("parts", "postings")}


def _weights(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, token, weight, average): the query's count times the token's rarity,
    and the documents' mean length."""
    asked = queries.select("query_id", F.explode(T.lexical_tokens(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    facts = index.where(F.col("token") == EVERY).agg(F.sum("df").alias("n"), F.greatest(F.sum("total_length") / F.sum("df"), F.lit(1.0)).alias("average"))
    df = index.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df"))
    n, average = facts.select("n").scalar(), facts.select("average").scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(df, "token").select("query_id", "token", (F.col("qtf") * idf).alias("weight"), average.alias("average"))


def _part(tf: str, length: str):
    long = F.greatest(length, F.lit(1)) / F.col("average")
    return F.col("weight") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * long))


def _few(weights: DataFrame) -> bool:
    """Whether all tokens of the queries are broadcast, and a block's queries are a list."""
    size = weights.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries")).first()
    return size["n"] <= FEW_TOKENS and size["queries"] <= FEW_QUERIES


def bounds(weights: DataFrame, index: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, block, bound): what a document of the block can score at most.  A
    token of every block is joined in TOKEN_PARTS parts.  ``few``: the blocks' rows of asked
    tokens are dealt by block, once, and meet the queries there."""
    if few:
        own = index.join(F.broadcast(weights.select("token").distinct()), "token", "left_semi").repartition("block")
        each = own.groupBy("block", "token").agg(F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length")).join(F.broadcast(weights), "token")
        return each.groupBy("query_id", "block").agg(F.sum(_part("max_tf", "min_length")).alias("bound"))
    salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TOKEN_PARTS - 1))))
    rows = index.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(TOKEN_PARTS)).cast("int")).join(salted, ["token", "salt"])
    each = rows.repartition("query_id", "block").groupBy("query_id", "block", "token", "weight", "average").agg(F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))
    return each.groupBy("query_id", "block").agg(F.sum(_part("max_tf", "min_length")).alias("bound"))


def scores(wanted: DataFrame, weights: DataFrame, rows: DataFrame, digits: int, few: bool = False) -> DataFrame:
    """(query_id, id, lexical_score) of the documents in ``wanted`` (query_id, block).
    ``few``: postings of asked tokens are dealt by block, once, and scores add up there, so
    nothing of a query and a document is shuffled."""
    if few:
        asking = wanted.groupBy("block").agg(F.collect_list("query_id").alias("asking"))
        own = rows.join(F.broadcast(weights.select("token").distinct()), "token", "left_semi").select("block", "token", "id", "tf", "length").repartition("block").join(asking, "block")
        found = own.join(F.broadcast(weights), "token").where(F.array_contains("asking", F.col("query_id"))).groupBy("query_id", "block", "id")
        return found.agg(F.round(F.sum(_part("tf", "length")), digits).alias("lexical_score")).where("lexical_score > 0").select("query_id", "id", "lexical_score")
    asked = wanted.select("query_id", "block").join(weights, "query_id")
    found = rows.join(asked, ["block", "token"]).groupBy("query_id", "id").agg(F.round(F.sum(_part("tf", "length")), digits).alias("lexical_score"))
    return found.where("lexical_score > 0")


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = 20, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """BM25 of ``queries`` (query_id, question): (query_id, id, lexical_score,
    lexical_rank), the best ``k`` of all documents, ties to the smaller id; and
    (query_id, n_blocks, n_scored), how many blocks hold a token of the query and how many
    were scored.

    A query's SEEDS most promising blocks are scored first.  Their k-th best score is a
    threshold: a block whose bound is below it holds none of the best k and is skipped."""
    index = _bounds_table(spark, root)
    weights = save(_weights(queries, index), "weights")
    few = _few(weights)
    limit = save(bounds(weights, index, few), "bounds")
    rows = postings(spark, root)
    promising = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    seeds = limit.withColumn("r", F.row_number().over(promising)).where(F.col("r") <= SEEDS)
    first = top(scores(seeds, weights, rows, digits, few), "lexical_score", k, ["id"], "r").where(F.col("r") == k)
    known = first.select("query_id", F.col("lexical_score").alias("least"))
    enough = F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 2 * 10.0**-digits
    wanted = save(limit.join(known, "query_id", "left").withColumn("scored", enough), "wanted")
    best = top(scores(wanted.where("scored"), weights, rows, digits, few), "lexical_score", k, ["id"], "lexical_rank")
    return best, wanted.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.count_if("scored").alias("n_scored"))
