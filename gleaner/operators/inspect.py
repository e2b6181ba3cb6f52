"""Chunk audit, corpus statistics and faceted browsing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import text as T
from gleaner.functions.display import boundary_notes, evidence_count, page_label
from gleaner.operators.running import before
from gleaner.sources.tables import save

#: Where terms are looked for, besides specifications and their evidence.
BROWSED = ("chunk_id", "source", "section", "title", "product", "product_codes", "text_product_codes", "source_product_codes", "chip_models", "vendors", "tags", "text")


def overlaps(chunks: DataFrame) -> DataFrame:
    """With overlap_with_previous_chars and gap_from_previous_chars against the
    previous chunk of the source, by ``position``."""
    delta = F.col("char_start") - F.lag("char_end").over(Window.partitionBy("source").orderBy("position"))
    return chunks.withColumn("overlap_with_previous_chars", F.when(delta < 0, -delta)).withColumn("gap_from_previous_chars", F.when(delta > 0, delta))


def inspection(chunks: DataFrame) -> DataFrame:
    """The audit's 24 columns, by ``position`` (their index)."""
    rows = overlaps(chunks)
    first, last = F.coalesce("start_page", "page"), F.coalesce("end_page", "page")
    return rows.select(
        F.col("position").alias("index"), "chunk_id", "source", "page", page_label(first, last).alias("page_label"), "char_start", "char_end", F.length("text").alias("char_length"), T.count_length_tokens(F.col("text")).alias("estimated_tokens"),
        "parent_id", "prev_chunk_id", "next_chunk_id", F.coalesce(F.nullif("section", F.lit("")), "title").alias("section"), "heading_level", "product", "product_codes", "chip_models", "vendors", "tags", "specs",
        "overlap_with_previous_chars", "gap_from_previous_chars", boundary_notes(F.col("text"), F.col("char_start"), F.col("char_end"), F.col("table_context"), F.col("list_structure")).alias("notes"), "text",
    )


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    """(v, c): a written table of a column of whole numbers, nulls left out."""
    return save(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("c")), "value-counts")


def median(counts: DataFrame) -> DataFrame:
    """One row, median: of value_counts(), null if there are none.  The middle places are
    looked up in running counts, so nothing holds more than a row for each different value
    in a block of values."""
    placed = before(counts.withColumn("all", F.lit(0)), "all", "v", stored=True, below=(F.sum, F.col("c"))).withColumn("below", F.coalesce("below", F.lit(0)))
    total = counts.agg(F.sum("c")).scalar()
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("c"))
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    return placed.where(holds(low) | holds(high)).agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunk, source, parent and tag counts, token minimum, maximum, mean
    and median.  All of the tokens comes from one count of equal values."""
    tags = chunks.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag"))
    counts = value_counts(chunks, "token_count")
    mean = F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 1)
    tokens = counts.agg(F.coalesce(F.min("v"), F.lit(0)).cast("int").alias("token_min"), F.coalesce(F.max("v"), F.lit(0)).cast("int").alias("token_max"), F.coalesce(mean, F.lit(0.0)).alias("token_mean"))
    middle = F.coalesce(F.round(median(counts).scalar(), 1), F.lit(0.0))
    whole = chunks.agg(F.count("*").alias("chunk_count"), F.countDistinct("source").alias("source_count"), F.countDistinct(F.nullif("parent_id", F.lit(""))).alias("parent_count"))
    return whole.select("*", *(tokens.select(c).scalar().alias(c) for c in tokens.columns), middle.alias("token_median"), tags.scalar().alias("tag_count"))


def most_common(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, first_position), in no order; a report sorts by falling count, then
    first appearance."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


#: Facets of specifications: what is said of a chunk besides its single fields.
SPEC_FACETS = ("with_specs", "evidence", "table")


def _heading(columns: list[str]) -> Column:
    return F.coalesce(F.nullif("section", F.lit("")), F.col("title"), F.lit("")) if "section" in columns else F.coalesce("title", F.lit(""))


def facet_values(chunks: DataFrame) -> dict[str, Column]:
    """For each facet the array of a chunk's values.  A specification counts if it is
    known, not false and no empty list."""
    columns = chunks.columns
    tests = []
    if "specs" in columns:
        kinds = dict(chunks.select("specs.*").dtypes)
        known = {f: F.size(f"specs.{f}") > 0 if k.startswith("array") else F.col(f"specs.{f}").isNotNull() for f, k in kinds.items()}
        tests.append((reduce(lambda a, b: a | b, known.values()), "with_specs"))
        tests += [(known[f] & F.col(f"specs.{f}") if k == "boolean" else known[f], f) for f, k in kinds.items()]
    if "spec_evidence" in columns:
        tests.append((evidence_count(F.col("spec_evidence")) > 0, "evidence"))
    if "table_context" in columns:
        tests.append((F.coalesce(F.col("table_context"), F.lit("")) != "", "table"))
    specs = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests))) if tests else F.array().cast("array<string>")
    tags = F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x != "")) if "tags" in columns else F.array().cast("array<string>")
    return {"source": F.array(F.coalesce("source", F.lit(""))), "section": F.array(_heading(columns)), "tag": tags, "spec": specs}


def holds_terms(chunks: DataFrame, terms: str) -> Column:
    """Whether every term, in any case, is somewhere in the chunk's text and metadata."""
    kinds = dict(chunks.dtypes)
    parts = [F.array_join(c, " ") if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BROWSED if c in kinds]
    parts += [F.coalesce(F.to_json(c), F.lit("")) for c in ("specs", "spec_evidence") if c in kinds]
    hay = F.lower(F.concat_ws("\n", *parts))
    return reduce(lambda a, b: a & b, (F.contains(hay, F.lit(t)) for t in terms.lower().split()), F.lit(True))


def facet_counts(chunks: DataFrame, selected: dict[str, str] | None = None, terms: str = "") -> DataFrame:
    """(facet, value, n, first_position): how many chunks each choice of a facet
    leaves, under the terms and what is ``selected`` in the other facets, so a facet's own
    choice doesn't hide its alternatives.  One pass: a chunk counts for all facets if
    it meets every selection, for one facet if it fails that one alone, else for none."""
    selected = {f: v for f, v in (selected or {}).items() if v}
    values = facet_values(chunks)
    if unknown := set(selected) - set(values):
        raise ValueError(f"no such facet: {', '.join(sorted(unknown))}")
    fails = {f: ~F.array_contains(values[f], v) for f, v in selected.items()}
    failed = reduce(lambda a, b: a + b, (x.cast("int") for x in fails.values()), F.lit(0))
    named = lambda f: lambda x: F.struct(F.lit(f).alias("facet"), x.alias("value"))
    each = [F.when((F.col("__failed") == 0) | ((F.col("__failed") == 1) & fails.get(f, F.lit(False))), F.transform(v, named(f))) for f, v in values.items()]
    found = chunks.withColumn("__failed", failed).where((F.col("__failed") < 2) & holds_terms(chunks, terms)).select("position", F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("x"))
    return found.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


def browse(chunks: DataFrame, source: str = "", section: str = "", tag: str = "", spec: str = "", terms: str = "", limit: int = 300) -> DataFrame:
    """Chunks that meet every facet given and hold every term somewhere."""
    values, rows = facet_values(chunks), chunks
    for facet, value in (("source", source), ("section", section), ("tag", tag), ("spec", spec)):
        if value:
            rows = rows.where(F.array_contains(values[facet], value))
    return rows.where(holds_terms(chunks, terms)).orderBy("position").limit(limit)


#: Terms that are marked in a text.
MARKED = 6


def highlighted(text: Column, terms: str) -> Column:
    """The text as HTML, the first MARKED terms between mark elements, in any case."""
    safe = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        safe = F.replace(safe, F.lit(plain), F.lit(escaped))
    words = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in terms.split()[:MARKED]]
    return F.regexp_replace(safe, f"(?iu)({'|'.join(words)})", "<mark>$1</mark>") if words else safe
