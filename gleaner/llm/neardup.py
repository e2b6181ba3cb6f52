"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles.  Each of PERMUTATIONS linear
permutations of the shingles' 64-bit hashes gives two values, the minimum and the
maximum, so BANDS bands of four values cost half the hash evaluations of plain
MinHash.  Documents that agree in a band meet in its bucket; two documents of
similarity 0.8 miss each other in all 32 bands with probability 5e-8.

Equal sets are one node from the start, named by its first row's number and found
by the set's 128-bit hash, so neither repeated nor null doc_ids mix up texts.  Nodes of
a bucket are linked by stars: each to two centres of the bucket, never all pairs of a
group; one centre is the smallest node, the other one drawn by the bucket's own
hash, so a node meets different centres in different bands.  Links count only when
the full sets confirm them.  Connected components of the confirmed links settle most
buckets.  In those that still hold nodes of different components all pairs across
components follow that their parity sketches leave, in blocks of at most BLOCK by
BLOCK nodes: no set of links between components goes untested because of skew, and
no task holds a whole bucket.

A parity sketch has PARITY bits, each the parity of the number of shingles whose
hash falls on it.  Two sketches differ in at most as many bits as their sets differ
in shingles, and similarity s allows (1 - s) / (1 + s) of both sizes, so the test
loses no link at any size.  Beyond some 3,000 shingles it leaves most pairs, which go
to the full sets.

Hot keys (a bucket, a centre, a set or a component with many rows) are dealt out in
parts, see ``common.salted_join``; full sets go once to each part of their centre and
are streamed past it.

Null and empty texts have no shingle and are linked with nothing.  A component's id
is its smallest doc_id; rows without a doc_id link documents like others, and a
component of such rows alone has a null id.  ``kept`` is doc_id = component_id, so
null without a doc_id.  Rows that repeat a doc_id and a text count as one document;
two texts of one doc_id are two.  Other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import hot_keys, row_key, salted_join, save, unique
from gleaner.llm.components import components

PERMUTATIONS = 64
ROWS = 4  # values of a band: minima and maxima of two permutations
BANDS = 2 * PERMUTATIONS // ROWS
CACHE_WORDS = 200_000
PARITY = 1536
BLOCK = 512
#: Bits of a map of rows (1 MB), and of a row of it.
MAP_BITS, MAP_ROW = 2**23, 2**15

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, PERMUTATIONS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LONGS = PARITY // 64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 100:
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, size: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words, A-Z lower
    cased; fewer words are one shingle, none is an empty set."""
    words = text.lower().split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of the permuted hashes; long sets in slices."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * _MULTIPLY + _ADD
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    return low, high


def _bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The buckets of the document, one a band."""
    out = np.arange(BANDS, dtype=np.uint64)
    for part in (low[::2], high[::2], low[1::2], high[1::2]):
        out = _mixed(out + part)
    return out


def _parities(shingles: np.ndarray) -> np.ndarray:
    """The set's parity sketch as longs."""
    odd = np.bincount(((shingles >> np.uint64(20)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (row, doc_id, key_a, key_b, text) with n (set size), key (128-bit hash
    of the set), parities and bands instead of the text; all but n null for an empty
    set."""
    names = ["row", "doc_id", "key_a", "key_b", "n", "key", "parities", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                n, made = [], []
                for text in part.column(4).cast(pa.binary()).to_pylist():
                    own = shingle_set(text, size, hashes)
                    n.append(len(own))
                    if len(own):
                        made.append((xxhash.xxh3_128_digest(own.tobytes()), _parities(own), _bands(*_signature(own)).view(np.int64)))
                    else:
                        made.append((None,) * 3)
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(n, pa.int64()), *(pa.array([x[i] for x in made], k) for i, k in enumerate(kinds))], names)

    return docs.select(*names[:4], "text").mapInArrow(run, "row long, doc_id long, key_a long, key_b long, n long, key binary, parities array<long>, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [shingle_set(x, size, hashes).tobytes() for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _marked(rows: DataFrame, found: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``found``: false only where its columns of the names of ``keys`` aren't
    in ``keys``.  A map of MAP_BITS bits, whatever their number, tells where the rows are
    read, so that few have to be dealt out for an exact join."""
    m, row, bits = map(unique, ("map", "row", "bits"))
    slot, place = F.pmod(F.xxhash64(*keys.columns), F.lit(MAP_BITS)), F.col(m) % MAP_ROW
    known = keys.select(slot.alias(m)).groupBy(F.floor(F.col(m) / MAP_ROW).alias(row)).agg(F.bitmap_construct_agg(place).alias(bits))
    placed = rows.withColumn(m, slot).join(F.broadcast(known), F.floor(F.col(m) / MAP_ROW) == F.col(row), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return placed.withColumn(found, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop(m, row, bits)


def _perhaps(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without most of those that aren't in ``keys``, by its columns."""
    found = unique("found")
    return _marked(docs, found, keys).where(found).drop(found)


def _own_rows(full: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """The rows of ``full`` that name a node of ``nodes``: those that surely aren't copies
    stay where they are, others are joined."""
    found = unique("found")
    hot = hot_keys(nodes.where("c > 1"), "key", total)
    copies = salted_join(full.select("row", "key"), nodes.where("c > 1").select("key", "node"), "key", hot, F.col("row"))
    marked = _marked(full, found, save(copies.where("row <> node").select("row"), "near-copies"))
    rest = marked.where(found).join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi")
    return marked.where(~F.col(found)).unionByName(rest).drop(found)


@dataclass
class Texts:
    """Where the sets of nodes come from."""

    docs: DataFrame  # doc_id, key_a, key_b, text
    own: DataFrame  # node, doc_id, key_a, key_b: each node's first row
    repeated: bool  # whether a doc_id and a text come twice
    size: int

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the ``nodes``, from one more pass over the documents that
        have them.  Both tables of nodes are written first, so Spark knows their sizes
        before it deals out texts."""
        wanted = save(self.own.join(save(nodes, "near-wanted"), "node", "left_semi"), "near-rows")
        wanted = wanted.select("node", *(F.col(c).alias("w" + c) for c in ("doc_id", "key_a", "key_b")))
        same = F.col("doc_id").eqNullSafe(F.col("wdoc_id")) & (F.col("key_a") == F.col("wkey_a")) & (F.col("key_b") == F.col("wkey_b"))
        sets = _sets(_perhaps(self.docs, wanted.select(F.col("wdoc_id").alias("doc_id"), F.col("wkey_a").alias("key_a"))).join(wanted, same), self.size)
        return save(sets.dropDuplicates(["node"]) if self.repeated else sets, "near-sets")


def confirm(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The sets of all b of a centre a are streamed past the set of a, in as many
    parts as the centre's number of pairs asks for; no set is copied into each pair."""
    total = pairs.count()
    sizes = save(pairs.groupBy("a").agg(F.count("*").alias("c")), "near-centres")
    hot = hot_keys(sizes, "a", total).select(F.col("a").alias("centre"), "parts")
    sets = texts.sets(pairs.select(F.col("b").alias("node")).union(sizes.select("a")).distinct())

    parts = F.coalesce("parts", F.lit(1))
    spread = F.broadcast(hot)
    centres = sizes.select(F.col("a").alias("centre")).join(spread, "centre", "left").select("centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    centres = centres.join(sets, F.col("centre") == F.col("node")).select("centre", "part", F.lit(None).cast("long").alias("member"), "shingles")
    members = pairs.select(F.col("a").alias("centre"), F.col("b").alias("member")).join(spread, "centre", "left").select("centre", F.pmod(F.xxhash64("member"), parts).cast("int").alias("part"), "member")
    members = members.join(sets, F.col("member") == F.col("node")).select("centre", "part", "member", "shingles")
    both = centres.unionByName(members).repartition("centre", "part").sortWithinPartitions("centre", "part", F.asc_nulls_first("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for i, (centre, part, member) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                y = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if member is None:
                    now, x = (centre, part), y.copy()
                    continue
                if now != (centre, part):
                    raise ValueError("a pair without its centre's set")
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(i)
            kept = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2)], ["a", "b"])

    return both.select("centre", "part", "member", "shingles").mapInArrow(run, "a long, b long")


def _bounded(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities leave; b has few partners, a may have
    very many."""
    side = lambda c: facts.select(*(F.col(k).alias(c + k) for k in facts.columns))
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("c")), "a", pairs.count())
    seen = pairs.join(side("v"), F.col("b") == F.col("vnode")).drop("vnode")
    return salted_join(seen, side("u").withColumnRenamed("unode", "a"), "a", hot, F.col("b")).where(_may_link(percent)).select("a", "b")


def classes(docs: DataFrame, size: int = 5, percent: int = 80, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id,
    text).  With ``keyed`` also key_a and key_b (``row_key``) and ``stays``: whether the
    row's document is the one of its component that stays, the smallest by doc_id
    (nulls last) and key."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text")
    rows = save(sketch(source, size), "near-sketch")  # written, so the row numbers stay
    total = rows.count()
    least = [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key_a", "key_b")).alias("least")] if keyed else []
    full = rows.where("key is not null")
    nodes = save(full.groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("id"), F.count("*").alias("c"), *least), "near-nodes")

    own = save(_own_rows(full, nodes, total).select(F.col("row").alias("node"), "doc_id", "key_a", "key_b", "n", "parities", "bands"), "near-own")
    repeated = rows.select("doc_id", "key_a", "key_b").distinct().count() < total
    texts = Texts(source.drop("row"), own.select("node", "doc_id", "key_a", "key_b"), repeated, size)
    members = own.select("node", F.explode("bands").alias("bucket"))
    met = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("first"), F.min(F.col("node").bitwiseXOR(F.col("bucket"))).alias("other")).where("c > 1")
    met = save(met.select("bucket", "c", "first", F.col("other").bitwiseXOR(F.col("bucket")).alias("second")), "near-met")
    in_buckets = met.agg(F.sum("c")).first()[0] or 0
    shared = save(salted_join(members, met, "bucket", hot_keys(met, "bucket", in_buckets), F.col("node")), "near-buckets")

    star = shared.select("node", F.explode(F.array("first", "second")).alias("centre")).where("node <> centre")
    star = save(star.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    facts = own.select("node", "n", *(F.get("parities", F.lit(i)).alias(f"p{i}") for i in range(_LONGS)))
    links = save(confirm(save(_bounded(star, facts, percent), "near-tried"), texts, percent), "near-links")
    labels = components(links)

    # Buckets whose nodes aren't all in one component yet: the pairs across.
    tagged = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_buckets = tagged.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("many")).where("low < high and many > 2")
    open_buckets = save(open_buckets.select("bucket", F.col("many").alias("c")), "near-open")
    hot = hot_keys(open_buckets, "bucket", open_buckets.agg(F.sum("c")).first()[0] or 0)
    rest = salted_join(tagged.drop("c"), open_buckets, "bucket", hot, F.col("node")).join(facts, "node")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rest = save(rest.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int")).withColumn("others", F.sequence(F.lit(0), blocks - 1)), "near-rest")
    u, v = (rest.select(*(F.col(k).alias(c + k) for k in rest.columns)) for c in "uv")
    u, v = u.withColumn("vside", F.explode("uothers")).drop("uothers"), v.withColumn("uside", F.explode("vothers")).drop("vothers")
    untested = ~F.col("unode").isin(F.col("ufirst"), F.col("usecond")) & ~F.col("vnode").isin(F.col("ufirst"), F.col("usecond"))
    met_here = (F.col("ubucket") == F.col("vbucket")) & (F.col("ublock") == F.col("uside")) & (F.col("vside") == F.col("vblock"))
    across = u.join(v, met_here & (F.col("ucomponent") < F.col("vcomponent")) & untested & _may_link(percent))
    across = save(across.select(F.col("unode").alias("a"), F.col("vnode").alias("b")).distinct(), "near-across")
    if not across.isEmpty():
        more = save(confirm(across, texts, percent), "near-more")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    # From nodes to components to rows.
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = save(named.withColumnRenamed("c", "copies"), "near-named")
    firsts = [F.min("least").alias("first")] if keyed else []
    ids = save(named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("c"), *firsts), "near-ids")
    named = salted_join(named.drop("id", "least"), ids.drop("c"), "component", hot_keys(ids, "component", total), F.col("node"))
    hot = hot_keys(named.select("key", F.col("copies").alias("c")), "key", total)
    plain = rows.select("row", "doc_id", "key_a", "key_b", "n", "key")
    out = salted_join(plain.where("key is not null"), named.drop("node", "component", "copies"), "key", hot, F.col("row"))
    none = plain.where("key is null").withColumn("component_id", F.col("doc_id"))
    out = out.unionByName(none, allowMissingColumns=True)
    stays = F.col("key").isNull() | (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key_a") == F.col("key_a")) & (F.col("first.key_b") == F.col("key_b"))) if keyed else None
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), *(["key_a", "key_b", stays.alias("stays")] if keyed else []))


def _may_link(percent: int) -> Column:
    """Whether sizes and parities of two nodes, in columns named with u and v before,
    leave a similarity of ``percent``."""
    least, most = F.least("un", "vn"), F.greatest("un", "vn")
    bits = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"up{i}").bitwiseXOR(F.col(f"vp{i}"))) for i in range(_LONGS)))
    return (least * 100 >= most * percent) & (bits * (100 + percent) <= (F.col("un") + F.col("vn")) * (100 - percent))
