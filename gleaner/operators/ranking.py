"""Metadata bonus, candidate injection, reranking and final selection.

Candidates are rows (query_id, id, scores and ranks, and the chunk's metadata);
``intents`` holds what a question asks for: query_id, question, vendors, chips,
wants_list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import text as T
from gleaner.functions.display import identity_key, metadata_text
from gleaner.operators.planner import requested_vendors

MATCH = "metadata_vendor_match"


def known_vendors(chunks: DataFrame) -> DataFrame:
    """One row: vendors of the chunks (by ``position``), first spelling, longest
    first."""
    rows = chunks.select("position", F.posexplode("vendors").alias("n", "vendor")).where(T.strip(F.col("vendor")) != "")
    first = rows.groupBy(F.lower(T.strip(F.col("vendor"))).alias("k")).agg(F.min_by(T.strip(F.col("vendor")), F.struct("position", "n")).alias("v"), F.min(F.struct("position", "n")).alias("at"))
    ordered = first.agg(F.array_sort(F.collect_list(F.struct((-F.length("v")).alias("l"), "at", "v"))).alias("x"))
    return ordered.select(F.when(F.size("x") > 0, F.col("x.v")).otherwise(F.array(*map(F.lit, T.VENDORS))).alias("known"))


def intents(queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    rows = queries if known is None else queries.join(F.broadcast(known))
    vendors = requested_vendors(F.col("question"), None if known is None else F.col("known"))
    return rows.select("query_id", "question", vendors.alias("asked_vendors"), T.requested_chips(F.col("question")).alias("asked_chips"), T.wants_list(F.col("question")).alias("wants_list"))


def bonus() -> Column:
    """Over candidates joined with their query's intent."""
    strong = F.when(F.col("wants_list"), 2.0).otherwise(1.0)
    chips = F.when(F.size("asked_chips") == 0, 0.0).when(F.arrays_overlap("asked_chips", "chip_models"), 4.0).when(F.size("chip_models") > 0, -4.0).otherwise(0.0)
    vendors = F.aggregate("asked_vendors", F.lit(0.0), lambda s, v: s + F.when(F.array_contains("vendors", v), 3.0).otherwise(-3.0))
    named = (F.size("product_codes") > 0) | (F.size("chip_models") > 0) | (F.col("product") != "")
    extra = F.when(F.col("wants_list") & named, 1.0).otherwise(0.0) + F.when((F.size("product_codes") > 0) & (F.size("chip_models") > 0), 0.5).otherwise(0.0)
    return F.when((F.size("asked_vendors") == 0) & (F.size("asked_chips") == 0), 0.0).otherwise((chips + vendors) * strong + extra)


def _asked_for() -> Column:
    """Whether a chunk has what the question names, in each kind that it names."""
    chips = (F.size("asked_chips") == 0) | F.arrays_overlap("asked_chips", "chip_models")
    vendors = (F.size("asked_vendors") == 0) | F.arrays_overlap("asked_vendors", "vendors")
    return chips & vendors


def _is_listing() -> Column:
    return F.col("wants_list") & ((F.size("asked_vendors") > 0) | (F.size("asked_chips") > 0))


def inject(candidates: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """``candidates`` (query_id, id, hybrid_score, hybrid_rank, …) with the chunks
    that match the metadata a listing question names; matches come first, and the
    list isn't cut.  Other questions keep their candidates."""
    own = asked.withColumn("listing", _is_listing())
    wanted = own.where("listing").select("query_id", "asked_vendors", "asked_chips", "wants_list")
    few = chunks.select("id", "chip_models", "vendors", "product_codes", "product", "position")
    few = few.where((F.col("product") != "") | (F.size("product_codes") > 0) | (F.size("chip_models") > 0))
    # A listing question names a chip or a vendor: chunks meet it by that name.
    names = lambda chips, vendors: F.array_union(F.transform(chips, lambda x: F.concat(F.lit("c:"), x)), F.transform(vendors, lambda x: F.concat(F.lit("v:"), x)))
    asked_names = names(F.col("asked_chips"), F.when(F.size("asked_chips") > 0, F.array().cast("array<string>")).otherwise(F.col("asked_vendors")))
    asks, has = wanted.select("query_id", F.explode(asked_names).alias("name")), few.select("id", F.explode(names(F.col("chip_models"), F.col("vendors"))).alias("name"))
    met = has.join(asks, "name").select("query_id", "id").distinct()
    matches = met.join(few, "id").join(wanted, "query_id").where(_asked_for()).withColumn("bonus", bonus()).select("query_id", "id", "bonus", "position")
    base = candidates.groupBy("query_id").agg(F.max("hybrid_score").alias("base"))
    both = candidates.join(matches, ["query_id", "id"], "full_outer").join(base, "query_id", "left").join(own.select("query_id", "listing"), "query_id", "left")
    fresh = F.col("hybrid_score").isNull()
    both = both.withColumn(MATCH, F.col("bonus").isNotNull()).withColumn("hybrid_score", F.coalesce("hybrid_score", F.coalesce("base", F.lit(0.0)) + F.col("bonus")))
    both = both.withColumns({c: F.when(fresh, F.lit(0.0)).otherwise(F.col(c)) for c in ("dense_score", "lexical_score") if c in candidates.columns})
    order = Window.partitionBy("query_id").orderBy(F.desc(MATCH), F.desc("hybrid_score"), F.asc_nulls_last("hybrid_rank"), "position", "id")
    return both.withColumn("hybrid_rank", F.when(F.col("listing"), F.row_number().over(order)).otherwise(F.col("hybrid_rank"))).drop("bonus", "base", "listing", "position")


def heuristic_score(columns: list[str]) -> Column:
    """Over candidates with chunk metadata and intent: base score, bonus, shared
    tokens, tokens found in the metadata, and structure."""
    tokens = F.array_distinct(T.lexical_tokens(F.col("question")))
    shared = F.size(F.array_intersect(tokens, T.lexical_tokens(metadata_text(columns))))
    hay = F.lower(F.concat_ws(" ", "section", "title", "product", *(F.array_join(c, " ") for c in ("product_codes", "chip_models", "vendors")), "version", F.array_join("tags", " "), "table_context", "list_structure"))
    inside = F.size(F.filter(tokens, lambda t: F.contains(hay, t)))
    structure = F.when(F.col("table_context") != "", 0.2).otherwise(0.0) + F.when(F.col("list_structure") != "", 0.1).otherwise(0.0) + F.when(F.col("heading_level") != 0, 0.05).otherwise(0.0)
    return F.col("hybrid_score") + bonus() + shared * 0.15 + inside * 0.1 + structure


def rerank(candidates: DataFrame, chunks: DataFrame, asked: DataFrame, scorer=None, digits: int = 6) -> DataFrame:
    """With rerank_score and rerank_rank.  ``scorer``: (question, text) -> score, a
    pandas UDF of a cross-encoder; its score gets the bonus.  None: the heuristic."""
    meta = [c for c in chunks.columns if c not in ("position", "question", "answer")]
    rows = candidates.join(chunks.select(*meta), "id").join(asked, "query_id")
    score = heuristic_score(meta) if scorer is None else scorer(F.col("question"), metadata_text(meta)) + bonus()
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "hybrid_rank")
    return rows.withColumn("rerank_score", F.round(score, digits)).withColumn("rerank_rank", F.row_number().over(order))


def select_final(reranked: DataFrame, top_k: int = 5, listing_k: int = 20) -> DataFrame:
    """The first ``top_k``; for a listing question the first chunk of each product
    that it asks for, up to max(top_k, listing_k), or the first ``top_k`` if none."""
    key = identity_key(F.col("product_codes"), F.col("source"), F.col("chip_models"), F.col("id"))
    rows = reranked.withColumn("fits", _is_listing() & _asked_for()).withColumn("key", key)
    first = F.row_number().over(Window.partitionBy("query_id", "key", "fits").orderBy("rerank_rank"))
    rows = rows.withColumn("chosen", F.col("fits") & (first == 1))
    place = F.row_number().over(Window.partitionBy("query_id", "chosen").orderBy("rerank_rank"))
    rows = rows.withColumn("any", F.max("chosen").over(Window.partitionBy("query_id"))).withColumn("place", place)
    chosen = F.when(F.col("any"), F.col("chosen") & (F.col("place") <= max(top_k, listing_k))).otherwise(F.col("rerank_rank") <= top_k)
    kept = rows.where(chosen).withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rerank_rank")))
    return kept.drop("fits", "key", "chosen", "any", "place")


def searchable(chunks: DataFrame) -> DataFrame:
    """(id, text): the metadata-aware text that lexical search goes over."""
    return chunks.select("id", metadata_text(chunks.columns).alias("text"))
