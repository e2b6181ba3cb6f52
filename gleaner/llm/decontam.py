"""Benchmark decontamination by SimHash windows.

A document is contaminated by an item if one of its windows of the item's number
of words has a weighted similarity of 0.8 or more with it: shingles of five words
(lower case), weighted by how often they occur, sum of minima over sum of maxima.

1. Filter.  A window that similar shares more than four fifths of the item's
   shingles.  For each item a few of its longest words are chosen such that more
   than a fifth of its shingles hold one, so such a window has a shingle of an item
   of its length with one of these words.  Only windows that do are fingerprinted,
   and a run of such windows meets only the items that chose a word found in it.  The
   filter loses no window.
2. Fingerprints.  Each such window gets a 64-bit SimHash of its shingles, from
   running sums along the document: 32 longs of two 32-bit counters each, so a window
   costs the same whatever its length.
3. Candidates.  Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS agree
   in at least one, so joining the windows and the items of a run by block value finds
   every such pair.  Similarity 0.8 means a distance of 9.6 +- 2.9.  Blocks of two or
   three bits select little by themselves; what a run meets keeps the pairs few however
   many items the benchmark has.
4. Verification.  The exact weighted similarity of every candidate: a shingle's
   occurrence counts in the windows that start after the occurrence as many places
   before as the item has it, so running sums give all windows' shared weight.

Native: DataFrame functions only.  An item has any number of words below 2**31; items
of fewer than five words are one shingle, empty ones match nothing; a document shorter
than the item is one window.  Null and empty texts have no window.  Rows that repeat
a doc_id and a text are one document, several texts of one doc_id give one row for the
best of them; rows without a doc_id are told apart by their text, and items without an
item_id too.  Of equally similar windows the first is named.  Other columns are ignored, whatever their names; empty tables give an
empty result.  Spark broadcasts items and words while they are under its own measured
threshold and joins by key beyond it; windows, runs and their shingles are never
broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import dealt, keep_rows, row_key, save, text_or_empty, words

RADIUS = 23
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF
#: A document (doc_id may be null), and its windows of one length: ``doc`` and
#: ``key_b`` are 128 bits of it, never null.
_DOC = ["doc_id", "key_a", "key_b"]
_RUN = ["doc", "key_b", "m"]


def _blocks() -> list[tuple[int, int]]:
    """(shift, bits) of the RADIUS + 1 blocks."""
    n, at, out = RADIUS + 1, 0, []
    for i in range(n):
        bits = 64 // n + (i < 64 % n)
        out.append((at, bits))
        at += bits
    return out


def _gram(array: Column, i: Column, k: Column) -> Column:
    return F.array_join(F.slice(array, i, k), " ")


def _block_values(fp: str) -> Column:
    return F.posexplode(F.array(*(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in _blocks()))).alias("block", "value")


def _lanes(h: str) -> list[Column]:
    return [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)).alias(f"l{j}") for j in range(32)]


def _fingerprint(shingles: Column) -> Column:
    """Of the sums l0 .. l31 of the lanes of that many shingles."""
    bits = []
    for j in range(32):
        lane = F.col(f"l{j}")
        bits.append(F.when(lane.bitwiseAND(F.lit(_LOW)) * 2 > shingles, F.lit(1 << j)).otherwise(F.lit(0)))
        top = (1 << (32 + j)) - (1 << 64 if j == 31 else 0)
        bits.append(F.when(F.shiftrightunsigned(lane, 32) * 2 > shingles, F.lit(top)).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (number), item_id, m (words), k (words of a shingle), words, grams."""
    own = benchmark.select("item_id", words(F.lower(text_or_empty())).alias("words")).where("size(words) > 0").distinct()
    own = own.withColumn("m", F.size("words")).withColumn("k", F.least(F.lit(5), "m"))
    grams = F.transform(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1), lambda i: _gram(F.col("words"), i, F.col("k")))
    return save(own.select(F.monotonically_increasing_id().alias("item"), "item_id", "m", "k", "words", grams.alias("grams")), "items")


def anchors_of(items: DataFrame) -> DataFrame:
    """item, anchor, m, k: words of which every window of m words that is similar enough
    to the item holds one, within a shingle that it shares with the item."""
    order = F.array_sort(F.array_distinct("words"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    placed = items.select("item", "m", "k", "words", order.alias("order"))
    rank = placed.select("item", F.posexplode("order").alias("rank", "word"))
    where = placed.select("item", "m", "k", F.posexplode("words").alias("p", "word")).join(rank, ["item", "word"])
    # The rank of each shingle: its lowest-ranked word's.
    first, last = F.greatest(F.col("p") - F.col("k") + 1, F.lit(0)), F.least(F.col("p"), F.col("m") - F.col("k"))
    least = where.select("item", "m", "k", F.explode(F.sequence(first, last)).alias("at"), "rank").groupBy("item", "m", "k", "at").agg(F.min("rank").alias("rank"))
    turn = F.row_number().over(Window.partitionBy("item").orderBy("rank", "at"))
    needed = F.floor((F.col("m") - F.col("k") + 1) * 0.2) + 1
    needed = least.withColumn("turn", turn).where(F.col("turn") == needed).select("item", "m", "k", F.col("rank").alias("most"))
    return needed.join(rank, "item").where("rank <= most").select("item", F.col("word").alias("anchor"), "m", "k")


def _hits(docs: DataFrame, anchors: DataFrame, shingles: DataFrame) -> DataFrame:
    """doc_id, key_a, key_b, m, k, n (words of the document), p, anchor (hash): places
    of anchors whose shingles hold one that an item of m words has too."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), words(F.lower(text_or_empty())).alias("words"))
    chosen = anchors.select("anchor", "m", "k").distinct()
    found = split.select(*_DOC, "words", F.posexplode("words").alias("p", "word")).join(chosen, F.col("word") == F.col("anchor"))
    n, k, p = F.size("words"), F.col("k"), F.col("p")
    # The shingles that hold p.  No lambda here: the document's words are looked at
    # where they are and not copied for each of its hits.
    near = F.array(*(F.when((F.lit(j) < k) & (p >= j) & (p - j + k <= n), _gram(F.col("words"), p - j + 1, k)) for j in range(5)))
    found = found.select(*_DOC, "m", "k", n.alias("n"), "p", F.xxhash64("anchor").alias("anchor"), F.explode(near).alias("gram")).where("gram is not null")
    return found.join(shingles.select("m", "gram").distinct(), ["m", "gram"], "left_semi").drop("gram").distinct()


def _grams(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """_RUN, run, p, gram: the shingles of each run of windows, in one more pass over
    the documents that have one."""
    wanted = runs.groupBy("doc", *_DOC).agg(F.collect_list(F.struct("m", "k", "run", "low", "high")).alias("runs"))
    mine = keep_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "left_semi").dropDuplicates(["doc_id", "text"])
    mine = mine.select(F.col("doc_id").alias("id"), *(c.alias(x) for c, x in zip(row_key(), "xy", strict=True)), "text")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("key_a")) & (F.col("y") == F.col("key_b"))
    each = mine.join(dealt(wanted), same).select("doc", "key_b", words(F.lower(text_or_empty())).alias("words"), F.explode("runs").alias("r"))
    at = F.transform(F.sequence("r.low", "r.high"), lambda p: F.struct(p.alias("p"), _gram(F.col("words"), p + 1, F.col("r.k")).alias("gram")))
    return each.select("doc", "key_b", "r.m", "r.run", F.explode(at).alias("x")).select(*_RUN, "run", "x.p", "x.gram")


def _met(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """_RUN, run, item: the items that chose a word at one of the run's places."""
    kinds = anchors.select("item", "m", F.xxhash64("anchor").alias("anchor")).distinct()
    return places.select(*_RUN, "run", "anchor").distinct().join(kinds, ["m", "anchor"]).select(*_RUN, "run", "item").distinct()


def candidates(grams: DataFrame, runs: DataFrame, met: DataFrame, items: DataFrame) -> DataFrame:
    """_RUN, run, s, item: pairs of a window and an item that its run meets whose
    fingerprints are within RADIUS."""
    along = Window.partitionBy(*_RUN, "run").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    hashed = grams.select(*_RUN, "run", "p", F.xxhash64("gram").alias("h")).join(dealt(runs.select(*_RUN, "run", "span")), [*_RUN, "run"])
    sums = hashed.select(*_RUN, "run", "p", "span", *_lanes("h")).select(*_RUN, "run", "p", "span", *(F.struct(F.sum(f"l{j}").over(along).alias("upto"), F.col(f"l{j}").alias("own")).alias(f"l{j}") for j in range(32)))
    # A window from s has the sums up to its last shingle less those before s.
    ends = sums.withColumn("end", F.explode(F.array(F.lit(True), F.lit(False))))
    lane = lambda j: F.when(F.col("end"), F.col(f"l{j}.upto")).otherwise(F.col(f"l{j}.own") - F.col(f"l{j}.upto")).alias(f"l{j}")
    ends = ends.select(*_RUN, "run", "span", F.when(F.col("end"), F.col("p") - F.col("span") + 1).otherwise(F.col("p")).alias("s"), *(lane(j) for j in range(32)))
    windows = ends.groupBy(*_RUN, "run", "s").agg(F.max("span").alias("span"), F.count("*").alias("c"), *(F.sum(f"l{j}").alias(f"l{j}") for j in range(32))).where("c = 2")
    windows = save(windows.select(*_RUN, "run", "s", _fingerprint(F.col("span")).alias("fp")), "leak-windows")

    rows = items.select("item", "m", F.size("grams").alias("weight"), F.explode("grams").alias("gram")).select("item", "m", "weight", F.xxhash64("gram").alias("h"))
    prints = rows.select("item", "m", "weight", *_lanes("h")).groupBy("item", "m", "weight").agg(*(F.sum(f"l{j}").alias(f"l{j}") for j in range(32)))
    prints = prints.select("item", "m", _fingerprint(F.col("weight")).alias("item_fp"))
    own = met.join(prints.drop("m"), "item")
    left, right = windows.select("*", _block_values("fp")), own.select("*", _block_values("item_fp"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = left.join(dealt(right), [*_RUN, "run", "block", "value"]).where(F.bit_count(differ) <= RADIUS)
    # Each pair once: in the first block that agrees.
    for b, (at, bits) in enumerate(_blocks()[:-1]):
        near = near.where((F.col("block") <= b) | (differ.bitwiseAND(F.lit(((1 << bits) - 1) << at)) != 0))
    return near.select(*_RUN, "run", "s", "item")


def _steps(near: DataFrame, grams: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """Steps d at s of the weight that windows of a run share with an item: a window's
    is the sum of those up to it.  The candidates are the rows without a step."""
    key = [*_RUN, "run", "item"]
    counts = items.select("item", F.explode("grams").alias("gram")).groupBy("item", "gram").agg(F.count("*").cast("int").alias("v"))
    pairs = near.select(*key).distinct()
    held = pairs.join(dealt(runs.select(*_RUN, "run", "span")), [*_RUN, "run"]).join(dealt(grams), [*_RUN, "run"]).join(counts, ["item", "gram"])
    places = held.groupBy(*key, "gram", "v", "span").agg(F.sort_array(F.collect_list("p")).alias("at"))
    turn = places.select(*key, "v", "span", "at", F.posexplode("at").alias("i", "p"))
    before = F.when(F.col("i") >= F.col("v"), F.element_at("at", F.greatest(F.col("i") - F.col("v") + 1, F.lit(1)))).otherwise(-1)
    # It counts in the windows from behind ``before`` up to p that reach it.
    from_ = F.greatest(before + 1, F.col("p") - F.col("span") + 1)
    steps = turn.select(*key, F.explode(F.array(F.struct(from_.alias("s"), F.lit(1).alias("d")), F.struct((F.col("p") + 1).alias("s"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.select(*key, "x.s", "x.d").groupBy(*key, "s").agg(F.sum("d").alias("d"))
    return steps.unionByName(near.select(*key, "s", F.lit(None).cast("long").alias("d")))


def find(docs: DataFrame, benchmark: DataFrame, percent: int = 80, keyed: bool = False) -> DataFrame:
    """One row for each contaminated (doc_id, item_id), with ``keyed`` also key_a
    and key_b (``row_key``): start_word (of the first of the best windows), window_words,
    shared and total weight, similarity, n_windows (that are similar enough)."""
    items = items_of(benchmark)
    shingles = items.select("m", F.explode("grams").alias("gram"))
    anchors = save(anchors_of(items), "anchors")
    hits = save(_hits(docs, anchors, shingles), "hits")

    # Runs of windows: those around hits whose windows meet.
    by = Window.partitionBy(*_DOC, "m").orderBy("p")
    p, m, n, k = (F.col(c) for c in ("p", "m", "n", "k"))
    doc = F.xxhash64("doc_id", F.col("doc_id").isNull(), "key_a").alias("doc")
    places = hits.withColumn("new", F.coalesce(p - F.lag("p").over(by) > m, F.lit(True)).cast("int")).select("*", doc, F.sum("new").over(by).alias("run"))
    runs = places.groupBy("doc", *_DOC, "m", "k", "n", "run").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    span = F.least(m, n) - k + 1
    low = F.when(n <= m, F.lit(0)).otherwise(F.greatest(F.col("first") - m + 1, F.lit(0)))
    top = F.when(n <= m, F.lit(0)).otherwise(F.least(F.col("last"), n - m))
    runs = runs.withColumn("span", span).withColumn("low", low).withColumn("top", top).where("span > 0 and low <= top")
    runs = runs.withColumn("high", F.col("top") + F.col("span") - 1)
    runs, met = save(runs, "leak-runs"), save(_met(places, anchors), "leak-met")
    grams = save(_grams(docs, runs), "leak-grams")
    near = save(candidates(grams, runs, met, items), "leak-candidates")

    key = [*_RUN, "run", "item"]
    along = Window.partitionBy(*key).orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    span = runs.select(*_RUN, "run", "span", F.least("m", "n").alias("window_words"), *_DOC)
    sums = _steps(near, grams, runs, items).withColumn("step", F.sum("d").over(along)).where("d is null").select(*key, "s", F.coalesce("step", F.lit(0)).alias("inside"))
    return _best(sums, span, items, percent, keyed)


def _best(sums: DataFrame, span: DataFrame, items: DataFrame, percent: int, keyed: bool) -> DataFrame:
    weights = items.select("item", "item_id", F.size("grams").alias("weight"))
    sums = sums.withColumnRenamed("inside", "shared").join(dealt(span), [*_RUN, "run"]).join(weights, "item")
    sums = sums.withColumn("total", F.col("span") + F.col("weight") - F.col("shared")).where(F.col("shared") * 100 >= F.col("total") * percent)
    doc = _DOC if keyed else ["doc_id"]
    named = sums.withColumn("own", F.when(F.col("doc_id").isNull(), F.struct("key_a", F.col("key_b").alias("b")))).withColumn("own_item", F.when(F.col("item_id").isNull(), F.col("item")))
    best = named.groupBy(*doc, "own", "item_id", "own_item").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("s")).alias("s"), "window_words", "shared", "total")).alias("x"), F.count_distinct("doc", "item", "s").alias("n_windows"))
    long = lambda c, name: c.cast("long").alias(name)
    return best.select(*doc, "item_id", long(-F.col("x.s"), "start_word"), long(F.col("x.window_words"), "window_words"), long(F.col("x.shared"), "shared"), long(F.col("x.total"), "total"), F.col("x.similarity").alias("similarity"), long(F.col("n_windows"), "n_windows"))
