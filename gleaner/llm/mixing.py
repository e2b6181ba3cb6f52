"""Mixing sources to target weights by blocks.

Packing.  The words of each source are packed into blocks of a fixed number of
words.  Documents are dealt by hash into buckets; each bucket fills whole blocks of its
own, and what is left of all buckets of a source fills further blocks, so only a
source's last block is short, and nearly all text moves once.

Drawing.  A source gets as many output slots as its target needs: whole rounds of
its blocks and part of one more, whose last slot takes only the words still wanted, so
a source's words meet its target to a word.  All slots in the order of a seeded hash
are dealt to the output shards in turn: each shard's source counts are a multinomial
draw, given the sources' totals and shards of one size (free draws would miss small
targets by their sampling error).

Joining.  A source's slots walk through its blocks by a pseudorandom permutation of
the block numbers, that of their seeded hashes in order, and are joined to the
blocks by index.  The joined slots are the mix: they are written with their words, each
file in order of shard and position (a shard is the merge of its runs in the files), and
what each document gave is counted in them.

Native: DataFrame functions only.  Positions and ranks come from sums of small cells,
so a hot source is never ordered in one task.  A source may have any number of blocks
below 2**46; tables of one row a source, and of one a cell, are ordered in one task.

Null or empty texts have size 0, and nothing is taken of them; repeated rows count
each; a null source is a source of its own; ties in a hash are broken by the row's other
values, so reruns agree.  Other columns are ignored, whatever their names; an empty
table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import n_words, row_key, save, words

CHUNK = 65_536
#: Rows ranked at a time.
ROWS_IN_CELL = 1_000


@dataclass
class Mix:
    docs: DataFrame  # doc_id, key_a, key_b, size, source, source_size, target, taken
    slots: DataFrame  # shard, position, source, block, words
    sources: DataFrame  # source, source_size, target, blocks
    blocks: DataFrame  # source, block, pieces (low, start, doc_id, n, text)
    mixed: DataFrame  # shard, position, source, block, pieces (start, doc_id, n, text)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with a target each.  Sources by code point,
    null last, weigh ``weights`` in turn and share all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight.

    That is water-filling: with the sources by cap / weight, the capped ones come
    first, so cumulative sums over one row per source find the level."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    # The level of the first source that isn't capped, given that those before are.
    rows = rows.withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, block: int = 1024, shards: int = 16, seed: int = 7, rows_in_bucket: int = 2_000) -> Mix:
    """Mixes ``docs`` (doc_id, source, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *row_key(), "text")
    sized = save(rows.drop("text"), "sizes")
    buckets = 1 + sized.count() // rows_in_bucket
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per_source, weights, most).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
    plan = plan.withColumn("last", F.col("source_size") - (F.col("blocks") - 1) * block).withColumn("want", F.round("target").cast("long"))
    plan = plan.withColumn("rounds", F.when(F.col("blocks") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("want") - F.col("rounds") * F.col("source_size"))
    plan = save(plan.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))), "mix-plan")

    ids = plan.select(F.col("source").alias("s"), "sid")
    h = F.xxhash64("doc_id", "key_a", "key_b", F.lit(seed))
    hashed = lambda x: x.where("size > 0").withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets))).join(ids, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = hashed(sized).groupBy("sid", "bucket").agg(F.sum("size").alias("cell"))
    cells = cells.withColumn("full", F.floor(F.col("cell") / block)).withColumn("left", F.col("cell") % block)
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    cells = save(cells.select("sid", "bucket", "full", upto("cell").alias("first"), upto("full").alias("first_block"), upto("left").alias("first_left"), F.sum("full").over(Window.partitionBy("sid")).alias("all_full")), "mix-cells")

    slots = save(_slots(plan, block, shards, seed), "slots")
    blocks, mixed = _mixed(slots, _pieces(_places(hashed(rows), cells), block), cells, block)

    got = mixed.select("sid", F.explode("pieces").alias("p")).groupBy("sid", "p.start").agg(F.sum("p.n").alias("taken"))
    facts = ["doc_id", "key_a", "key_b", "source", "size"]
    whole = _places(hashed(sized), cells).join(got, ["sid", "start"], "left").select(*facts, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    everything = whole.unionByName(sized.where("size = 0").select(*facts, F.lit(0).cast("long").alias("taken")))
    named = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = everything.join(named, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "key_a", "key_b", "size", "source", "source_size", "target", "taken")
    return Mix(out, slots.drop("sid"), plan.drop("sid"), blocks.drop("sid"), mixed.drop("sid"))


def _places(hashed: DataFrame, cells: DataFrame) -> DataFrame:
    """With inner, the word offset of each row in its bucket in hashed order, and start,
    that in its source."""
    inside = Window.partitionBy("sid", "bucket").orderBy("h", F.asc_nulls_first("doc_id"), "size", "key_a", "key_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(cells, ["sid", "bucket"]).withColumn("start", F.col("first") + F.col("inner")).drop("h", "first")


def _cut(rows: DataFrame, at: Column, block: int, number) -> DataFrame:
    """``rows`` (words in ``all``, from offset ``at`` on) cut where blocks end: a row
    for each piece with block (``number`` of the place), low (offset in the block), text."""
    size = F.size("all")
    low = lambda b: F.greatest(at - b * block, F.lit(0))
    skipped = lambda b: F.greatest(b * block - at, F.lit(0))
    many = lambda b: F.least(size - skipped(b), block - low(b))
    piece = lambda b: F.struct(number(b).alias("block"), low(b).alias("low"), many(b).cast("long").alias("n"), F.array_join(F.slice("all", (skipped(b) + 1).cast("int"), many(b).cast("int")), " ").alias("text"))
    places = F.sequence(F.floor(at / block), F.floor((at + size - 1) / block))
    cut = rows.where(size > 0).select("sid", "bucket", "source", "doc_id", "start", F.explode(F.transform(places, piece)).alias("x"))
    return cut.select("sid", "bucket", "source", "doc_id", "start", "x.block", "x.low", "x.n", "x.text")


def _pieces(placed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of the buckets' own blocks, and those of the blocks that are made of
    what is left of them."""
    inside = F.greatest(F.lit(0), F.least(F.col("size"), F.col("full") * block - F.col("inner"))).cast("int")
    # Only a bucket's last texts have words in the rest: no others are split for it.
    split = lambda some: placed.where(some).withColumn("all", words(F.col("text"))).drop("text")
    own = split(inside > 0).withColumn("all", F.slice("all", F.lit(1), inside))
    rest = split(F.col("size") > inside).withColumn("all", F.slice("all", inside + 1, F.size("all")))
    # Offset in the source's stream of rests.
    at = F.col("first_left") + F.greatest(F.col("inner") - F.col("full") * block, F.lit(0))
    return _cut(own, F.col("inner"), block, lambda b: F.col("first_block") + b), _cut(rest, at, block, lambda b: F.col("all_full") + b)


def _mixed(slots: DataFrame, pieces: tuple[DataFrame, DataFrame], cells: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and the slots with the words of their blocks, cut to the words
    they take: sid, shard, position, source, block, pieces, written in order of shard and
    position.  The slots of a bucket's own blocks come to where its texts already are."""
    slot = F.struct("block", "shard", "position", "words")
    bounds = cells.where("full > 0").select("sid", "bucket", F.col("first_block").alias("block"))
    # The bucket of a slot: the last whose first block isn't behind it.  Range by
    # range of block numbers, so a hot source's slots are looked up by many tasks.
    ranged = bounds.join(cells.select("sid", "bucket", "full"), ["sid", "bucket"]).select("sid", "bucket", "block", "full", F.explode(F.sequence(F.floor(F.col("block") / CHUNK), F.floor((F.col("block") + F.col("full") - 1) / CHUNK))).alias("range"))
    by_range = slots.withColumn("range", F.floor(F.col("block") / CHUNK)).groupBy("sid", "range", F.floor(F.col("block") / 64).alias("part")).agg(F.collect_list(slot).alias("slots"))
    found = by_range.join(ranged, ["sid", "range"]).where((F.col("part") * 64 < F.col("block") + F.col("full")) & (F.col("part") * 64 + 64 > F.col("block")))
    mine = F.filter("slots", lambda x: (x["block"] >= F.col("block")) & (x["block"] < F.col("block") + F.col("full")))
    mine = found.select("sid", "bucket", F.explode(mine).alias("x")).groupBy("sid", "bucket", "x.block").agg(F.collect_list(F.struct("x.shard", "x.position", "x.words")).alias("slots"))
    mine = mine.groupBy("sid", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("block", "slots"))).alias("by_block"))

    packed = lambda rows, by: rows.groupBy(*by).agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("low", "start", "doc_id", "n", "text"))).alias("pieces"))
    own, rest = packed(pieces[0], ["sid", "bucket", "block"]), packed(pieces[1], ["sid", "block"])
    filled = own.join(mine.hint("shuffle_hash"), ["sid", "bucket"]).withColumn("slots", F.element_at("by_block", F.col("block")))
    left = rest.join(slots.groupBy("sid", "block").agg(F.collect_list(F.struct("shard", "position", "words")).alias("slots")), ["sid", "block"])
    columns = ["sid", "source", "block", "pieces", "slots"]
    joined = filled.select(*columns).unionByName(left.select(*columns)).withColumn("slot", F.explode("slots"))

    def taken(p):
        # Only the last slot of a source cuts a piece.
        room = F.col("slot.words") - p["low"]
        text = F.when(p["n"] <= room, p["text"]).otherwise(F.array_join(F.slice(F.split(p["text"], " "), F.lit(1), room.cast("int")), " "))
        return F.struct(p["start"].alias("start"), p["doc_id"].alias("doc_id"), F.least(p["n"], room).alias("n"), text.alias("text"))

    kept = F.transform(F.filter("pieces", lambda p: p["low"] < F.col("slot.words")), taken)
    rows = joined.select("sid", "slot.shard", "slot.position", "source", "block", kept.alias("pieces"))
    blocks = own.select("sid", "source", "block", "pieces").unionByName(rest.select("sid", "source", "block", "pieces"))
    return blocks, save(rows.sortWithinPartitions("shard", "position"), "mixed")


def _ranked(rows: DataFrame, by: list[str], h: Column, ties: list[str], total: int, name: str) -> DataFrame:
    """``rows`` with ``name``, their number (from 0) among those of one ``by`` in order
    of the hash ``h``: ranks in cells of the hash plus the rows of earlier cells."""
    rows = rows.withColumn("h", h).withColumn("cell", F.shiftrightunsigned("h", 1) % F.lit(1 + total // ROWS_IN_CELL))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*by, "cell").agg(F.count("*").alias("c")).select(*by, "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*by, "cell").orderBy("h", *ties)) - 1
    return rows.withColumn("inside", inside).join(cells, [*by, "cell"]).withColumn(name, F.col("first") + F.col("inside")).drop("h", "cell", "first", "inside")


def permutation(plan: DataFrame, seed: int) -> DataFrame:
    """sid, block, step: each source's blocks in pseudorandom order."""
    # In chunks, so that a hot source's blocks are made by many tasks.
    chunks = plan.where("blocks > 0").select("sid", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(CHUNK))).alias("chunk")).repartition("sid", "chunk")
    blocks = chunks.select("sid", F.explode(F.sequence(F.col("chunk"), F.least(F.col("blocks") - 1, F.col("chunk") + (CHUNK - 1)), F.lit(1))).alias("block"))
    total = plan.agg(F.sum("blocks")).first()[0] or 0
    return _ranked(blocks, ["sid"], F.xxhash64("sid", "block", F.lit(seed)), ["block"], int(total), "step")


def _slots(plan: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """One row for each output slot: sid, shard, position, source, block, words."""
    n = F.col("blocks")
    steps = save(permutation(plan, seed), "permutation").join(plan.select("sid", "source", "blocks", "last", "rounds", "rest"), "sid")
    steps = steps.withColumn("length", F.when(F.col("block") == n - 1, F.col("last")).otherwise(F.lit(block)))
    # Words of the steps before: all of full length but for the short block.
    short = steps.where(F.col("block") == n - 1).select("sid", F.col("step").alias("q"))
    steps = steps.join(short, "sid", "left")
    done = F.col("step") * block - F.when(F.col("step") > F.col("q"), block - F.col("last")).otherwise(0)
    part = F.least(F.col("length"), F.greatest(F.col("rest") - done, F.lit(0)))
    turns = steps.withColumn("part", part).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("rounds"), F.lit(1)))).where((F.col("turn") < F.col("rounds")) | (F.col("part") > 0))
    turns = turns.withColumn("words", F.when(F.col("turn") < F.col("rounds"), F.col("length")).otherwise(F.col("part")))
    turns = save(turns.select("sid", "source", "block", "words", "turn", "step"), "turns")
    dealt = _ranked(turns, [], F.xxhash64("sid", "turn", "step", F.lit(seed)), ["sid", "turn", "step"], turns.count(), "number")
    return dealt.select("sid", F.pmod("number", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("number") / shards).alias("position"), "source", "block", "words")
