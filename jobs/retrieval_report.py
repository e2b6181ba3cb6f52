"""Measures retrieval over a lexical index that the job ``lexical_index`` keeps.

    python -m jobs.retrieval_report --questions PATH --documents PATH --vectors PATH \\
        --index PATH --out PATH [--config FILE]

Every question is searched in three stages: dense (exact, the vector with the question's
id against all vectors), lexical (BM25 over the index) and hybrid (rank fusion of both).
A result is relevant if its document holds the question's text, in any case.  ``--out``
gets, partitioned by ``stage``:

    results  query_id, id, score, rank, relevant
    metrics  query_id, first_rank, mrr, hit_1 ... hit_20
    summary  queries, mrr, mean_first_rank, hit_1 ... hit_20

A run replaces the partitions of its stages (dynamic partition overwrite), so a repeated
run leaves the same.  Questions without an id take no part; a null text finds nothing
and has no relevant document; a question without a vector has no dense results.  Each
stage has its partition of ``metrics`` and ``summary`` also if it finds nothing.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import evaluate, lexindex, retrieval
from gleaner.session import session
from gleaner.sources.tables import scratch, stored
from jobs.settings import LOG, log_to_terminal, read_settings

STAGES = ("dense", "lexical", "hybrid")


@dataclass(frozen=True)
class Settings:
    question_id: str = "item_id"
    question_text: str = "text"
    id_column: str = "doc_id"
    text_column: str = "text"
    vector_id: str = "vec_id"
    vector_column: str = "embedding"
    width: int = 20
    cutoffs: list[int] = field(default_factory=lambda: [1, 3, 5, 10, 20])


def stages(spark: SparkSession, questions: DataFrame, vectors: DataFrame, index: str, width: int, keep) -> DataFrame:
    """(query_id, stage, id, score, rank) of all stages."""
    asked = vectors.withColumnRenamed("id", "query_id").join(questions.select("query_id"), "query_id", "left_semi")
    dense = keep(retrieval.dense(asked, vectors, width), "dense")
    best, seen = lexindex.search(spark, index, questions, width)
    lexical = keep(best, "lexical")
    blocks = seen.agg(F.sum("n_blocks").alias("n"), F.sum("n_scored").alias("scored")).first()
    LOG.info("lexical: scored %s of %s blocks that hold a word of their question", blocks["scored"], blocks["n"])
    hybrid = retrieval.fuse(dense, lexical, width)
    each = [rows.select("query_id", F.lit(s).alias("stage"), "id", F.col(f"{s}_score").alias("score"), F.col(f"{s}_rank").alias("rank")) for s, rows in zip(STAGES, (dense, lexical, hybrid), strict=True)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def judged(found: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """``found`` with ``relevant``.  Only the documents found have their text read
    further than their id, once each."""
    pairs = found.select("query_id", "id").distinct().join(documents, "id").join(questions, "query_id")
    good = pairs.where(F.contains(F.lower("text"), F.lower("question")) & (F.col("question") != "")).select("query_id", "id").distinct()
    return found.join(good.withColumn("relevant", F.lit(True)), ["query_id", "id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def run(spark: SparkSession, questions: str, documents: str, vectors: str, index: str, out: str, settings: Settings = Settings()) -> dict[str, int]:
    """Returns the numbers of questions and of rows written a table."""
    s = settings
    asked = spark.read.parquet(questions).select(F.col(s.question_id).alias("query_id"), F.coalesce(F.col(s.question_text), F.lit("")).alias("question"))
    asked = asked.where("query_id is not null").groupBy("query_id").agg(F.max("question").alias("question"))
    texts = spark.read.parquet(documents).select(F.col(s.id_column).alias("id"), F.col(s.text_column).alias("text"))
    embedded = spark.read.parquet(vectors).select(F.col(s.vector_id).alias("id"), F.col(s.vector_column).alias("vector")).where("id is not null and vector is not null")
    cutoffs = tuple(s.cutoffs)
    done = {}
    with scratch(spark) as keep:
        asked = keep(asked, "questions")
        done["questions"] = asked.count()
        LOG.info("read %d questions of %s; documents %s, vectors %s, index %s", done["questions"], questions, documents, vectors, index)
        results = keep(judged(stages(spark, asked, embedded, index, s.width, keep), asked, texts), "results")
        first = results.where("relevant").groupBy("query_id", "stage").agg(F.min("rank").alias("first_rank"))
        every = asked.select("query_id").withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
        ranks = every.join(first, ["query_id", "stage"], "left")
        for name, rows in (("results", results), ("metrics", evaluate.query_metrics(ranks, cutoffs)), ("summary", evaluate.stage_summary(ranks, cutoffs))):
            rows = keep(rows, name)
            done[name] = rows.count()
            rows.repartition("stage", F.col("query_id") % 16 if "query_id" in rows.columns else F.lit(0)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(f"{out}/{name}")
            LOG.info("wrote %d rows of %s/%s", done[name], out, name)
    return done


def whole(spark: SparkSession, out: str, settings: Settings = Settings()) -> DataFrame:
    """The three tables as one, of questions and documents with whole numbers as ids:
    ``kind`` is results, metrics or summary."""
    hit = [f"hit_{k}" for k in settings.cutoffs]
    flags, rates = ", ".join(f"{c} boolean" for c in hit), ", ".join(f"{c} double" for c in hit)
    results = stored(spark, f"{out}/results", "query_id long, id long, score double, rank int, relevant boolean, stage string")
    metrics = stored(spark, f"{out}/metrics", f"query_id long, first_rank int, mrr double, {flags}, stage string")
    summary = stored(spark, f"{out}/summary", f"queries long, mrr double, mean_first_rank double, {rates}, stage string")
    metrics = metrics.withColumns({c: F.col(c).cast("double") for c in ("first_rank", *hit)})
    made = [rows.withColumn("kind", F.lit(name)) for rows, name in ((results, "results"), (metrics, "metrics"), (summary, "summary"))]
    return made[0].unionByName(made[1], allowMissingColumns=True).unionByName(made[2], allowMissingColumns=True)


def main(argv: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(description="Measures retrieval over a lexical index.")
    for name in ("questions", "documents", "vectors", "index", "out"):
        options.add_argument(f"--{name}", required=True)
    options.add_argument("--config", help="JSON file of settings")
    given = options.parse_args(argv)
    log_to_terminal()
    spark = session("retrieval_report")
    try:
        run(spark, given.questions, given.documents, given.vectors, given.index, given.out, read_settings(spark, given.config, Settings))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
