"""Whole plans: documents to chunks, questions to contexts and filtered products."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators import chunking, expand, metadata, pages, planner, products, prompts, ranking, retrieval, sections
from gleaner.plans import reports
from gleaner.sources.tables import save


@dataclass(frozen=True)
class Options:
    """Widths and switches of a retrieval."""

    top_k: int = 5
    dense_k: int = 20
    hybrid_k: int = 20
    listing_k: int = 20
    window: int = 1
    context_tokens: int = 700
    product_limit: int = 20
    measure: str = "ip"
    hybrid: bool = True
    rerank: bool = True


def pages_from_documents(documents: DataFrame, in_file: int = 100) -> DataFrame:
    """``documents`` (doc_id, source, text) as pages of files: those of a source in
    stretches of ``in_file`` doc_ids, numbered by doc_id.  A file is bounded, however
    many documents a source has."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    file = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / in_file).cast("string"))
    documents = documents.withColumn("source", file)
    return documents.select("source", F.concat(F.lit("docs/"), "source", F.lit(".pdf")).alias("file_path"), number.alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def chunks_of(clean: DataFrame) -> DataFrame:
    """Chunks of cleaned pages: question-answer pairs of files named so that have
    any, parents and children of sections for the rest."""
    clean = save(clean, "clean-pages")
    spans, documents = save(pages.page_spans(clean), "page-spans"), save(pages.documents_of(clean), "documents")
    pairs = save(chunking.faq_spans(documents.where(F.contains(F.lower("source"), F.lit("faq"))), spans), "pairs")
    rest = documents.join(pairs.select("source").distinct(), "source", "left_anti")
    parents = save(chunking.parents_of(sections.sections_of(rest)), "parents")
    children = save(chunking.children_of(parents, spans).unionByName(pairs.select(*chunking.CHILD_NUMBERS)), "children")
    parents = parents.unionByName(pairs.select(*parents.columns))
    return metadata.chunk_records(parents, metadata.numbered(children, spans, documents.select("source", "file_path")))


def indexed(chunks: DataFrame) -> DataFrame:
    """A written table of the chunks with ``id`` and ``position``, which ranking
    needs: sources by name, chunks in reading order.  A range partitioning and the
    partitions' own numbers give increasing positions without one task that sorts.  The
    chunks are written first: to find the ranges, Spark would make them all once more."""
    ordered = save(chunks, "records").repartitionByRange("source", "chunk_index").sortWithinPartitions("source", "chunk_index")
    return save(ordered.withColumn("id", F.col("chunk_id")).withColumn("position", F.monotonically_increasing_id()), "chunks")


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, options: Options = Options(), scorer=None) -> dict[str, DataFrame]:
    """Stages dense, hybrid, rerank and final for ``queries`` (query_id, question,
    vector); ``chunks`` are indexed(), ``vectors`` (id, vector)."""
    o = options
    known = ranking.known_vendors(chunks)
    asked = save(ranking.intents(queries, known), "intents")
    dense = retrieval.dense(queries, vectors, o.dense_k, o.measure)
    if o.hybrid:
        dense = save(dense, "dense")
        found = retrieval.fuse(dense, retrieval.lexical(queries, ranking.searchable(chunks), o.dense_k), o.hybrid_k)
    else:
        found = dense.where(F.col("dense_rank") <= o.hybrid_k).select("*", F.lit(0.0).alias("lexical_score"), F.col("dense_score").alias("hybrid_score"), F.col("dense_rank").alias("hybrid_rank"))
    hybrid = save(ranking.inject(found, chunks, asked), "hybrid")
    if o.rerank:
        ranked = ranking.rerank(hybrid, chunks, asked, scorer)
    else:
        ranked = hybrid.join(chunks.drop("position", "question", "answer"), "id").join(asked, "query_id").withColumn("rerank_score", F.col("hybrid_score")).withColumn("rerank_rank", F.col("hybrid_rank"))
    ranked = save(ranked, "reranked")
    chosen = ranking.select_final(ranked, o.top_k, o.listing_k)
    seeds = expand.neighbours(chosen, chunks, o.window)
    final = expand.parent_contexts(seeds, chunks, o.context_tokens)
    return {"dense": dense, "hybrid": hybrid, "rerank": ranked, "final": final}


@dataclass(frozen=True)
class Filtered:
    """What the structured filter of some questions gives."""

    conditions: DataFrame  # query_id, ord, field, ...
    products: DataFrame  # the rolled-up products
    ranked: DataFrame  # query_id, place, key, label, first_rank


def structured_filter(queries: DataFrame, chunks: DataFrame, stages: dict[str, DataFrame], options: Options = Options()) -> Filtered:
    """Conditions of the questions and the products that meet them, in the order in
    which reranked, hybrid and dense results name them."""
    known = ranking.known_vendors(chunks)  # one row
    conditions = save(planner.conditions_of(queries.join(F.broadcast(known)), F.col("known")), "conditions")
    table = save(products.rollup(chunks), "products")
    keys = products.with_key(chunks).select("id", "key")
    listed = [stages[s].select("query_id", "id", F.lit(i).alias("stage"), F.col(f"{s}_rank").alias("r")) for i, s in enumerate(("rerank", "hybrid", "dense"))]
    rows = listed[0].unionByName(listed[1]).unionByName(listed[2]).join(keys, "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "r"))
    matches = planner.structured_filter(table, conditions)
    return Filtered(conditions, table, save(planner.rank_products(matches, table, rows.withColumn("rank", rank), limit=options.product_limit), "ranked"))


def structured(queries: DataFrame, chunks: DataFrame, stages: dict[str, DataFrame], options: Options = Options()) -> DataFrame:
    """(query_id, place, key, label, first_rank) of ``structured_filter``."""
    return structured_filter(queries, chunks, stages, options).ranked


def answer_prompts(queries: DataFrame, final: DataFrame, filtered: Filtered | None = None, options: Options = Options()) -> DataFrame:
    """(query_id, is_structured, prompt): questions with conditions over their filtered
    products, others, or all without ``filtered``, over the final contexts."""
    if filtered is None:
        rows = queries.join(prompts.contexts(final), "query_id")
        return rows.select("query_id", F.lit(False).alias("is_structured"), prompts.prompt(F.col("question"), F.col("context")).alias("prompt"))
    shown = products.structured_context(filtered.ranked, filtered.products, filtered.conditions, options.product_limit)
    return reports.routed_prompts(queries.select("query_id", "question"), final, filtered.conditions, shown)
