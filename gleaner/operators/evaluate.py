"""Retrieval quality: relevance, first ranks, hit rates, mean reciprocal rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTOFFS = {"dense": (1, 3, 5, 10, 20), "hybrid": (1, 3, 5, 10, 20), "rerank": (1, 3, 5, 10, 20), "final": (1, 3, 5, 10)}
TARGET = "chunk_id string, source string, page int, start_page int, end_page int, product string, product_codes array<string>, text_product_codes array<string>, source_product_codes array<string>, chip_models array<string>, vendors array<string>, version string, section string, tags array<string>, text_contains string"


def target_matches(columns: list[str], result: str = "r", target: str = "t") -> Column:
    """Whether a result meets all fields its target has; a target without any
    matches nothing.  ``columns``: those that results have."""
    r = lambda c: F.col(f"{result}.{c}") if c in columns else F.lit(None)
    t = lambda c: F.col(f"{target}.{c}")
    some = {"string": lambda c: F.coalesce(t(c), F.lit("")) != "", "int": lambda c: t(c).isNotNull(), "array": lambda c: F.size(F.coalesce(t(c), F.array().cast("array<string>"))) > 0}
    first, last = F.coalesce(r("start_page"), r("page")), F.coalesce(r("end_page"), r("page"))
    children = F.coalesce(r("matched_child_ids"), F.array().cast("array<string>")) if "matched_child_ids" in columns else F.array().cast("array<string>")
    tests = [
        ("string", "chunk_id", F.array_contains(F.concat(F.array(F.coalesce(r("chunk_id").cast("string"), F.lit("")), F.coalesce(r("context_id").cast("string"), F.lit(""))), children), t("chunk_id"))),
        *(("string", c, r(c) == t(c)) for c in ("source", "product", "version")),
        ("int", "page", (first <= t("page")) & (t("page") <= last)),
        ("int", "start_page", last >= t("start_page")),
        ("int", "end_page", first <= t("end_page")),
        *(("array", c, F.size(F.array_except(t(c), F.coalesce(r(c).cast("array<string>"), F.array().cast("array<string>")))) == 0) for c in ("product_codes", "text_product_codes", "source_product_codes", "chip_models", "vendors", "tags")),
        ("string", "section", F.contains(F.lower(F.coalesce(F.nullif(r("section").cast("string"), F.lit("")), r("title").cast("string"), F.lit(""))), F.lower(t("section")))),
        ("string", "text_contains", F.contains(F.lower(F.coalesce(r("text").cast("string"), F.lit(""))), F.lower(t("text_contains")))),
    ]
    present = [some[kind](c) for kind, c, _ in tests]
    holds = [~p | F.coalesce(test, F.lit(False)) for p, (_, _, test) in zip(present, tests, strict=True)]
    return reduce(lambda a, b: a | b, present) & reduce(lambda a, b: a & b, holds)


def first_ranks(results: DataFrame, targets: DataFrame, stages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, stage, first_rank): the best rank of a result that meets one of
    its query's targets, null if none does.  ``results``: query_id, stage, rank and
    result columns; ``stages``: stage; ``queries``: query_id."""
    pairs = results.alias("r").join(targets.alias("t"), F.col("r.query_id") == F.col("t.query_id")).where(target_matches(results.columns))
    best = pairs.groupBy(F.col("r.query_id").alias("query_id"), F.col("r.stage").alias("stage")).agg(F.min("r.rank").alias("first_rank"))
    return queries.select("query_id").join(stages.select("stage"), F.lit(True)).join(best, ["query_id", "stage"], "left")


def query_metrics(ranks: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    hits = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"hit_{k}") for k in cutoffs]
    return ranks.select("query_id", "stage", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), *hits)


def stage_summary(ranks: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """One row a stage: queries, mrr, mean_first_rank over hits, hit rates; four
    digits."""
    rows = query_metrics(ranks, cutoffs)
    rates = [F.round(F.avg(F.col(f"hit_{k}").cast("double")), 4).alias(f"hit_{k}") for k in cutoffs]
    return rows.groupBy("stage").agg(F.count("*").alias("queries"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("first_rank"), 4).alias("mean_first_rank"), *rates)


def improvement(ranks: DataFrame) -> DataFrame:
    """One row: how often reranking and the final stage beat dense, and the
    differences of the rounded rates."""
    wide = ranks.groupBy("query_id").pivot("stage", ["dense", "rerank", "final"]).agg(F.min("first_rank"))
    better = lambda s: F.coalesce(F.col(s).isNotNull() & (F.col("dense").isNull() | (F.col(s) < F.col("dense"))), F.lit(False))
    mrr = lambda s: F.round(F.avg(F.coalesce(1 / F.col(s), F.lit(0.0))), 4)
    hit = lambda s: F.round(F.avg(F.coalesce(F.col(s) <= 5, F.lit(False)).cast("double")), 4)
    counts = []
    for s in ("rerank", "final"):
        counts += [F.count_if(better(s)).alias(f"{s}_improved_queries"), F.round(F.avg(better(s).cast("double")), 4).alias(f"{s}_improved_rate"), F.round(mrr(s) - mrr("dense"), 4).alias(f"delta_mrr_{s}"), F.round(hit(s) - hit("dense"), 4).alias(f"delta_hit_5_{s}")]
    return wide.agg(*counts)


def checked_targets(targets: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` without a target are an error."""
    n = targets.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = queries.join(n, "query_id", "left")
    fine = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("query_id")).otherwise(F.raise_error(F.concat(F.lit("query without targets: "), F.col("query_id").cast("string"))).cast(queries.schema["query_id"].dataType))
    return rows.withColumn("query_id", fine).drop("n")
