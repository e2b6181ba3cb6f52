"""What a retrieval or an evaluation leaves behind: answers' prompts by kind of
question, the retrieval trace, the evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.display import SPECS, format_spec, known_json, number
from gleaner.operators import evaluate, prompts
from gleaner.operators.products import condition_fields

# The keys of a traced result, in order.
TRACED = (
    "chunk_id", "context_id", "parent_id", "prev_chunk_id", "next_chunk_id", "matched_child_ids", "retrieval_role", "is_adjacent", "adjacent_to",
    "dense_rank", "dense_score", "lexical_rank", "lexical_score", "hybrid_rank", "hybrid_score", "rerank_rank", "rerank_score", "metadata_vendor_match",
    "source", "page", "start_page", "end_page", "char_start", "char_end", "section", "title", "heading_level", "product",
    "product_codes", "text_product_codes", "source_product_codes", "chip_models", "vendors", "version", "doc_type", "tags", "table_context", "list_structure",
    "specs", "matched_child_texts", "child_text", "text",
)
STAGES = ("dense", "hybrid", "rerank", "final")


# -- answers ------------------------------------------------------------------


def routed_prompts(queries: DataFrame, final: DataFrame, conditions: DataFrame, structured: DataFrame) -> DataFrame:
    """(query_id, is_structured, prompt): a question with conditions gets the prompt of
    its filtered products (``structured``: query_id, context), any other that of its
    retrieved contexts, which may be none."""
    asked = conditions.select("query_id").distinct().withColumn("is_structured", F.lit(True))
    rows = queries.join(asked, "query_id", "left").withColumn("is_structured", F.coalesce("is_structured", F.lit(False)))
    rows = rows.join(structured.withColumnRenamed("context", "products"), "query_id", "left").join(prompts.contexts(final), "query_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    chosen = F.when(F.col("is_structured"), prompts.prompt(F.col("question"), text("products"), True)).otherwise(prompts.prompt(F.col("question"), text("context")))
    return rows.select("query_id", "is_structured", chosen.alias("prompt"))


def _spec_line(fields: Column) -> Column:
    """label: field=value, ..., vendor=... of a product row."""
    table = F.map_from_arrays(F.array(*map(F.lit, SPECS)), F.array(*(format_spec(f, F.col(f"specs.{f}")) for f in SPECS)))
    parts = F.transform(fields, lambda f: F.concat(f, F.lit("="), F.element_at(table, f)))
    vendor = F.when(F.size("vendors") > 0, F.array(F.concat(F.lit("vendor="), F.array_join("vendors", ", ")))).otherwise(F.array().cast("array<string>"))
    return F.concat("label", F.lit(": "), F.array_join(F.concat(parts, vendor), ", "))


def printed_products(ranked: DataFrame, products: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_id, place, line): what is printed of a structured question: its conditions
    (place 0 and below, in order) and a line for each product, or that there is none."""
    amount = F.when(F.endswith("field", F.lit("_gb")), F.col("num_value").cast("string")).otherwise(number(F.col("num_value")))
    value = F.coalesce(amount, F.initcap(F.col("bool_value").cast("string")), "str_value")
    last = F.max("ord").over(Window.partitionBy("query_id"))
    asked = conditions.select("query_id", (F.col("ord") - last).cast("int").alias("place"), F.format_string("- %s %s %s", "field", "op", value).alias("line"))
    rows = ranked.select("query_id", "place", "key").join(products, "key").join(condition_fields(conditions), "query_id")
    shown = rows.select("query_id", F.col("place").cast("int").alias("place"), F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), _spec_line(F.col("fields"))).alias("line"))
    none = conditions.select("query_id").distinct().join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    return asked.unionByName(shown).unionByName(none.select("query_id", F.lit(1).alias("place"), F.lit("No product passed all structured conditions.").alias("line")))


# -- trace --------------------------------------------------------------------


def traced(results: DataFrame) -> DataFrame:
    """(query_id, stage, json): the results of each stage in order of ``rank``, with
    TRACED's keys; unknown values and empty lists are left out."""
    rows = results.select("query_id", "stage", "rank", known_json(dict(results.dtypes), TRACED).alias("j"))
    out = rows.groupBy("query_id", "stage").agg(F.array_sort(F.collect_list(F.struct("rank", "j"))).alias("x"))
    return out.select("query_id", "stage", F.concat(F.lit("["), F.array_join(F.col("x.j"), ","), F.lit("]")).alias("json"))


def _listed(rows: DataFrame, order: str, columns: list[str], name: str) -> DataFrame:
    """(query_id, name): the rows of each query as a JSON array."""
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*columns)).alias("j")))).alias("x"))
    return packed.select("query_id", F.concat(F.lit("["), F.array_join(F.col("x.j"), ","), F.lit("]")).alias(name))


def trace(queries: DataFrame, results: DataFrame, conditions: DataFrame, ranked: DataFrame, args: dict[str, str], made: str) -> DataFrame:
    """(query_id, json): one payload a question: schema_version, generated_at (``made``),
    question, args, the stages' results and the structured filter's plan and products."""
    stages = traced(results).groupBy("query_id").agg(*(F.max(F.when(F.col("stage") == s, F.col("json"))).alias(s) for s in STAGES))
    plan = conditions.withColumn("value", F.coalesce(F.col("num_value").cast("string"), F.col("bool_value").cast("string"), "str_value"))
    plans = _listed(plan, "ord", ["field", "op", "value", "text"], "plan")
    products = _listed(ranked, "place", ["key", "label"], "products")
    rows = queries.join(stages, "query_id", "left").join(plans, "query_id", "left").join(products, "query_id", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit("[]"))
    head = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(made).alias("generated_at"), "question"))
    options = F.to_json(F.create_map(*(F.lit(str(x)) for kv in args.items() for x in kv))) if args else F.lit("{}")
    named = F.concat_ws(",", *(F.concat(F.lit(f'"{s}":'), some(s)) for s in STAGES))
    body = [F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"args":'), options, F.lit(',"stages":{'), named, F.lit('},"structured_filter":{"plan":'), some("plan"), F.lit(',"filtered_products":'), some("products"), F.lit("}}")]
    return rows.withColumn("h", head).select("query_id", F.concat(*body).alias("json"))


def write_trace(payloads: DataFrame, folder: str, stamp: str) -> None:
    """The payloads as JSON lines under retrieval_<stamp>, and again as the latest."""
    for name in (f"retrieval_{stamp}", "retrieval_latest"):
        payloads.select("json").write.mode("overwrite").text(f"{folder}/{name}")


# -- evaluation ---------------------------------------------------------------


def query_reports(ranks: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, json): a question's metrics in each stage and whether reranking and
    the final stage improved on dense.  ``ranks``: query_id, stage, first_rank;
    ``queries``: query_id, query; ``found``: query_id, stage of stages with results, which
    alone have hits."""
    best = lambda s: F.max(F.when(F.col("stage") == s, F.col("first_rank")))
    any_ = lambda s: F.max(F.when(F.col("stage") == s, F.col("some")))
    rows = ranks.join(found.select("query_id", "stage").distinct().withColumn("some", F.lit(True)), ["query_id", "stage"], "left")
    wide = rows.groupBy("query_id").agg(*(best(s).alias(s) for s in STAGES), *(any_(s).alias(f"has_{s}") for s in STAGES))

    def stage(s: str) -> Column:
        """The rank is null where there is none; hits are left out of stages without results."""
        hits = [F.when(F.col(f"has_{s}"), F.coalesce(F.col(s) <= k, F.lit(False))).alias(f"hit@{k}") for k in evaluate.CUTOFFS[s]]
        rest = F.to_json(F.struct(F.coalesce(1 / F.col(s), F.lit(0.0)).alias("mrr"), *hits))
        return F.concat(F.lit(f'"{s}":{{"first_relevant_rank":'), F.coalesce(F.col(s).cast("string"), F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))

    better = lambda s: F.coalesce(F.col(s) < F.coalesce("dense", F.lit(2**31 - 1)), F.lit(False)).alias(f"{s}_improved_vs_dense")
    head, tail = F.to_json(F.struct("query")), F.to_json(F.struct(better("rerank"), better("final")))
    whole = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.when(F.col("h") == "{}", "").otherwise(","), F.lit('"stages":{'), F.concat_ws(",", *map(stage, STAGES)), F.lit("},"), F.substr(tail, F.lit(2)))
    return wide.join(queries, "query_id").withColumn("h", head).select("query_id", whole.alias("json"))


def summary_json(ranks: DataFrame) -> DataFrame:
    """One row, json: the stages' means and the improvement over dense."""
    names = {"queries": "queries", "mrr": "mrr", "mean_first_rank": "mean_first_relevant_rank"} | {f"hit_{k}": f"hit@{k}" for k in evaluate.CUTOFFS["dense"]}
    stages = evaluate.stage_summary(ranks).select("stage", F.struct(*(F.col(a).alias(b) for a, b in names.items())).alias("s"))
    by = stages.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "s"))))).alias("stages"))
    better = evaluate.improvement(ranks)
    return by.join(better.select(F.to_json(F.struct(*better.columns)).alias("better"))).select(F.concat(F.expr("substring(stages, 1, length(stages) - 1)"), F.lit(',"improvement_vs_dense":'), "better", F.lit("}")).alias("json"))


def write_report(ranks: DataFrame, queries: DataFrame, found: DataFrame, path: str) -> None:
    """{"summary": ..., "queries": [...]} as one JSON document in the text files of
    ``path``, one after the other by name: Spark sorts the lines by range, so no task
    holds them all."""
    rows = query_reports(ranks, queries, found)
    first = rows.agg(F.min("query_id")).scalar()
    own = rows.select(F.lit(1).alias("part"), "query_id", F.concat(F.when(F.col("query_id") == first, "").otherwise(","), "json").alias("line"))
    none = F.lit(None).cast(rows.schema["query_id"].dataType).alias("query_id")
    head = summary_json(ranks).select(F.lit(0).alias("part"), none, F.concat(F.lit('{"summary":'), "json", F.lit(',"queries":[')).alias("line"))
    tail = head.select(F.lit(2).alias("part"), none, F.lit("]}").alias("line"))
    head.unionByName(own).unionByName(tail).orderBy("part", "query_id").select("line").write.mode("overwrite").text(path)
