"""Hierarchical weighted hash tree.

A row descends region, rack and shard levels.  At each level every child draws
``ln(u) / weight`` with ``u`` in (0, 1) from a hash of the key and the child's
name, and the largest draw wins, so a child is chosen in proportion to its weight
and a changed weight moves rows only between that child and its siblings.

A shard that is added later comes as a region of its own (a subtree of one rack
and one shard).  Its draw enters at the top level against unchanged weights, so
rows move into it and nowhere else, whichever shard they were in.

Native: expressions, one narrow shuffle and no Python.  Slots come from counts of
small (shard, bucket) cells, so no task ranks a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import save, text_or_empty


@dataclass(frozen=True)
class Tree:
    """weights[region][rack] = {shard: weight}; a zero weight takes no rows."""

    regions: tuple[tuple[dict[int, float], ...], ...]

    @classmethod
    def balanced(cls, shards: int, racks_in_region: int = 2, shards_in_rack: int = 4) -> "Tree":
        ids = iter(range(shards))
        regions = []
        left = shards
        while left > 0:
            racks = []
            for _ in range(racks_in_region):
                take = min(shards_in_rack, left)
                if take > 0:
                    racks.append({next(ids): 1.0 for _ in range(take)})
                left -= take
            regions.append(tuple(racks))
        return cls(tuple(regions))

    def grown(self) -> "Tree":
        """With one more shard, as a region of its own."""
        new = 1 + max((s for region in self.regions for rack in region for s in rack), default=-1)
        return Tree((*self.regions, ({new: 1.0},)))


def _draw(key: Column, name: str, weight: float) -> Column:
    """ln(u) / weight; u has 48 bits of an MD5 and is never 0 or 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + name)).cast("binary")), 1, 12), 16, 10).cast("double")
    return F.log((bits + 0.5) / F.lit(2.0**48)) / F.lit(weight)


def _choose(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the largest draw; ties go to the first."""
    live = [(n, w, v) for n, w, v in options if w > 0]
    if not live:
        raise ValueError("every weight is zero")
    if len(live) == 1:
        return live[0][2]
    draws = [F.struct(_draw(key, n, w).alias("d"), F.lit(-i).alias("i")) for i, (n, w, _) in enumerate(live)]
    best = -F.greatest(*draws)["i"]
    return reduce(lambda rest, iv: F.when(best == iv[0], iv[1][2]).otherwise(rest), list(enumerate(live))[:-1], live[-1][2])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard (int) of a string key."""
    total = lambda rack: float(sum(rack.values()))
    regions = []
    for r, region in enumerate(tree.regions):
        racks = []
        for k, rack in enumerate(region):
            leaf = _choose(key, [(f"s{s}", w, F.lit(s)) for s, w in rack.items()]) if total(rack) > 0 else F.lit(None)
            racks.append((f"r{r}k{k}", total(rack), leaf))
        weight = sum(w for _, w, _ in racks)
        regions.append((f"r{r}", weight, _choose(key, racks) if weight > 0 else F.lit(None)))
    return _choose(key, regions).cast("int")


def assign(docs: DataFrame, shards: int = 16, tree: Tree | None = None, rows_in_bucket: int = 2_000) -> DataFrame:
    """Each row of ``docs`` with all its columns' identity reduced to: doc_id,
    size, text_crc32, law, shard, slot, grown_shard.

    Null text counts as empty.  A null doc_id is a key of its own.  Repeated rows
    each get a slot of their own.  Other columns are ignored, whatever their names.  An
    empty table gives an empty result.  Rows of one doc_id go to one shard by law; their
    slots are dealt by bucket of doc_id and text, so only rows that repeat both share one."""
    tree = tree or Tree.balanced(shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = text_or_empty().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = save(rows.select("*", shard_of(key, tree).alias("shard"), shard_of(key, tree.grown()).alias("grown_shard")), "shards")
    # Slots: rank within a bucket plus the rows of the shard's earlier buckets.
    buckets = 1 + rows.count() // rows_in_bucket
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("long"))
    cells = rows.groupBy("shard", "bucket").agg(F.count("*").alias("cell"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "bucket", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("first"))
    rank = Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(rank))
    return ranked.join(cells, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"
    )
