"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

State:
  postings  (key, doc_id), one row for each line key of each document;
  counts    (key, n_docs, max_doc), the exact reference counts;
  filters   (shard, body), one cuckoo filter per shard of the keys' hash space,
            holding the keys that ``min_docs`` documents or more refer to.
Postings and counts are runs of written tables: a change writes one run of what it
touches and a posting that is gone again is a run's -1; more than RUNS of them are
merged into one.  ``insert`` and ``delete`` change all three alike, so deleting what
was inserted restores the state.  A filter that fills up is rebuilt at twice its
size, and all of them with more shards when a shard holds more than twice SHARD_KEYS.

Applying: the lines' keys are dealt to their shard's filter, and a line whose key it
doesn't hold stays for sure; the few others are checked against the exact counts by
key.  Shards and keys with many lines are dealt out in parts, so neither a common line
nor the number of shards loads one task, at any size.

Keys are 128-bit hashes of the line in UTF-8 with the six space characters
stripped at both ends and A-Z lower-cased; only keys of ``min_chars`` code points
count.  Null or empty text: one empty line.  Rows with one doc_id (null included)
are one document as holders; each row keeps and loses lines of its own.  Other columns
are ignored, whatever their names; an empty table gives an empty state and result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE_CHARS, hot_keys, row_key, salted_join, save

#: Runs of postings and counts before they are merged.
RUNS = 8
SHARD_KEYS = 65_536
SLOTS = 4
_SPACE = SPACE_CHARS.encode()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports deletion.  A fingerprint
    of 0 marks a free slot."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of_size(cls, keys: int) -> "CuckooFilter":
        return cls(1 << max(4, (int(keys / 0.8) // SLOTS).bit_length()))

    @staticmethod
    def places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each 64-bit hash."""
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (hashes & np.uint64(buckets - 1)).astype(np.int64)
        return mark, first, CuckooFilter.other(first, mark, buckets)

    @staticmethod
    def other(bucket, mark, buckets: int):
        return (bucket ^ (mark.astype(np.int64) * 0x5BD1E995)) & (buckets - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(hashes, len(self.table))
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if it is too full; then it has to be rebuilt larger."""
        mark, first, second = self.places(hashes, len(self.table))
        mask, turn = len(self.table) - 1, 0
        for m, a, b in zip(mark.tolist(), first.tolist(), second.tolist(), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
            else:
                at = b
                for _ in range(500):
                    turn += 1
                    k = turn % SLOTS
                    m, self.table[at, k] = int(self.table[at, k]), m
                    at = (at ^ (m * 0x5BD1E995)) & mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = m
                        break
                else:
                    return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Of keys that were inserted."""
        mark, first, second = self.places(hashes, len(self.table))
        for m, a, b in zip(mark.tolist(), first.tolist(), second.tolist(), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == m)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


@dataclass
class State:
    runs: list[DataFrame]  # key, doc_id, n: 1 added, -1 gone
    count_runs: list[DataFrame]  # key, n_docs, max_doc; the last run that has a key holds
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @property
    def postings(self) -> DataFrame:
        if len(self.runs) == 1:
            return self.runs[0].select("key", "doc_id")
        return reduce(DataFrame.unionByName, self.runs).groupBy("key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0").select("key", "doc_id")

    @property
    def counts(self) -> DataFrame:
        if len(self.count_runs) == 1:
            return self.count_runs[0]
        runs = reduce(DataFrame.unionByName, (r.withColumn("run", F.lit(i)) for i, r in enumerate(self.count_runs)))
        last = runs.groupBy("key").agg(F.max_by(F.struct("n_docs", "max_doc"), "run").alias("x"))
        return last.select("key", "x.n_docs", "x.max_doc").where("n_docs > 0")

    def hot(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _key(line: bytes, min_chars: int) -> bytes | None:
    line = line.strip(_SPACE)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 1].copy() if keys else np.zeros(0, np.uint64)


def _shard_of(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _emit(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key_a, key_b, key) for each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys = [], []
            for i, text in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
                own = {k for k in (_key(x, min_chars) for x in _lines(text)) if k}
                owners += [i] * len(own)
                keys += own
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(keys, pa.binary())], ["doc_id", "key_a", "key_b", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    return rows.mapInArrow(run, "doc_id long, key_a long, key_b long, key binary")


def postings(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    return _emit(docs, min_chars).select("key", "doc_id").distinct()


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _build_filters(hot: DataFrame, shards: int) -> DataFrame:
    def build(keys):
        import pandas as pd

        hashes, size = _hashes(keys["key"].tolist()), len(keys)
        while not (made := CuckooFilter.of_size(size)).insert(hashes):
            size *= 2
        return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "body": [made.table.tobytes()]})

    return hot.select("key", _shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, body binary")


def _shards_for(keys: int) -> int:
    return 1 + keys // SHARD_KEYS


def build(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> State:
    """State of ``docs`` (doc_id, text)."""
    rows = save(postings(docs, min_chars).withColumn("n", F.lit(1)), "line-postings")
    state = State([rows], [save(_count(rows), "line-counts")], rows.limit(0), 1, min_docs, min_chars)
    hot = state.hot().select("key")
    shards = _shards_for(hot.count())
    return replace(state, filters=save(_build_filters(hot, shards), "line-filters"), shards=shards)


def _merged(state: State) -> State:
    """With one run, if there are too many."""
    if len(state.runs) <= RUNS:
        return state
    rows = save(state.postings.withColumn("n", F.lit(1)), "line-postings")
    return replace(state, runs=[rows], count_runs=[save(state.counts, "line-counts")])


def _changed(before: State, after: State, touched: DataFrame) -> State:
    """``after`` with its filters: per shard, of the ``touched`` keys those that reached
    min_docs are inserted and those that fell below it are deleted."""
    shards = _shards_for(after.hot().count())
    if shards > 2 * before.shards:
        return _merged(replace(after, filters=save(_build_filters(after.hot().select("key"), shards), "line-filters"), shards=shards))
    old = before.hot().join(touched, "key", "left_semi").select("key")
    new = after.hot().join(touched, "key", "left_semi").select("key")
    delta = new.join(old, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(old.join(new, "key", "left_anti").withColumn("add", F.lit(False)))
    delta = delta.withColumn("shard", _shard_of(before.shards))

    def update(filters, keys):
        import pandas as pd

        if not len(filters) and not len(keys):
            return pd.DataFrame({"shard": [], "body": []})
        shard = int((filters if len(filters) else keys)["shard"].iloc[0])
        own = CuckooFilter(table=np.frombuffer(filters["body"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(filters) else CuckooFilter.of_size(len(keys))
        own.delete(_hashes(keys[~keys["add"].astype(bool)]["key"].tolist()))
        full = not own.insert(_hashes(keys[keys["add"].astype(bool)]["key"].tolist()))
        return pd.DataFrame({"shard": [shard], "body": [b"" if full else own.table.tobytes()]})

    made = save(before.filters.groupBy("shard").cogroup(delta.groupBy("shard")).applyInPandas(update, "shard int, body binary"), "line-filters")
    full = made.where(F.length("body") == 0).select("shard")
    again = _build_filters(after.hot().withColumn("shard", _shard_of(before.shards)).join(full, "shard", "left_semi").select("key"), before.shards)
    return _merged(replace(after, filters=save(made.where(F.length("body") > 0).unionByName(again), "line-filters")))


def insert(state: State, docs: DataFrame) -> State:
    """With the lines of ``docs``; what the state has already isn't counted again.
    Writes the new postings and the counts of their keys."""
    new = postings(docs, state.min_chars).alias("n")
    fresh = new.join(state.postings.alias("o"), F.col("n.key").eqNullSafe(F.col("o.key")) & F.col("n.doc_id").eqNullSafe(F.col("o.doc_id")), "left_anti")
    fresh = save(fresh.withColumn("n", F.lit(1)), "line-postings")
    added = _count(fresh)
    old = state.counts.join(added.select("key"), "key", "left_semi")
    run = old.unionByName(added).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
    run = save(run, "line-counts")
    return _changed(state, replace(state, runs=[*state.runs, fresh], count_runs=[*state.count_runs, run]), run.select("key"))


def delete(state: State, ids: DataFrame) -> State:
    """Without the documents whose doc_id is in ``ids``.  Writes what is gone and the
    counts of its keys, those of keys without a document as 0."""
    gone = ids.select(F.col("doc_id").cast("long").alias("__id")).distinct()
    lost = save(state.postings.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").withColumn("n", F.lit(-1)), "line-postings")
    after = replace(state, runs=[*state.runs, lost])
    touched = lost.select("key").distinct()
    run = touched.join(_count(after.postings.join(touched, "key", "left_semi")), "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "max_doc")
    run = save(run, "line-counts")
    return _changed(state, replace(after, count_runs=[*state.count_runs, run]), run.select("key"))


def _held(lines: DataFrame, state: State) -> DataFrame:
    """The rows of ``lines`` whose key the filters may hold: each shard's filter comes
    first, in each of the shard's parts, and the keys are tested as they pass."""
    per_shard = state.counts.withColumn("shard", _shard_of(state.shards)).groupBy("shard").agg(F.sum("n_docs").alias("c"))
    per_shard = save(per_shard, "line-loads")
    hot = F.broadcast(hot_keys(per_shard, "shard", per_shard.agg(F.sum("c")).first()[0] or 0))
    parts = F.coalesce("parts", F.lit(1))
    names = ["doc_id", "key_a", "key_b", "key"]
    filters = state.filters.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "body")
    dealt = lines.withColumn("shard", _shard_of(state.shards)).join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id", "key_a", "key"), parts).cast("int").alias("part"), *names)
    both = filters.unionByName(dealt, allowMissingColumns=True).select("shard", "part", "body", *names)
    both = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("body").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for batch in batches:
            place = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            bodies = batch.column(2)
            kept, at = [], 0
            while at < len(place):
                if bodies[at].is_valid:
                    now, table = place[at], CuckooFilter(table=np.frombuffer(bodies[at].as_py(), np.uint16).reshape(-1, SLOTS))
                    at += 1
                    continue
                end = at
                while end < len(place) and place[end] == place[at] and not bodies[end].is_valid:
                    end += 1
                if place[at] == now:  # else a shard without a filter: it holds no key
                    hit = table.contains(_hashes(batch.column(6).slice(at, end - at).to_pylist()))
                    kept.append(at + np.flatnonzero(hit))
                at = end
            yield batch.take(pa.array(np.concatenate(kept) if kept else [], pa.int64())).select(names)

    return both.mapInArrow(run, "doc_id long, key_a long, key_b long, key binary")


def apply(state: State, docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of ``docs``: lines whose
    key ``min_docs`` documents hold stay only in the largest doc_id that holds it."""
    lines = _held(_emit(docs, state.min_chars), state)
    hot = save(state.hot().select("key", "max_doc", F.col("n_docs").alias("c")), "line-hot")
    many = hot_keys(hot, "key", hot.agg(F.sum("c")).first()[0] or 0)
    drops = salted_join(lines, hot.drop("c"), "key", many, F.xxhash64("doc_id", "key_a")).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    drops = drops.groupBy(F.col("doc_id").alias("id"), F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(F.collect_set("key").alias("drops"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b"))
    rows = rows.join(drops.hint("shuffle_hash"), same, "left")
    min_chars = state.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, kept = [], [], []
            for text, drop in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = _lines(text)
                drop = set(drop or ())
                stay = [x for x in lines if _key(x, min_chars) not in drop] if drop else lines
                n.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return rows.select("doc_id", "text", "drops").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")
