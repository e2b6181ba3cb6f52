"""The jobs as registered queries: each runs twice into a folder of its own, so the rows
are those after a rerun.  The files stay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans.queries import LEXICAL
from gleaner.plans.retrieval_queries import BM25, DOT, FUSED, dense_sql
from gleaner.sources.tables import shared_dir
from jobs import lexical_index, retrieval_report


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def _index(spark: SparkSession, sf_dir: str, folder: str) -> None:
    for _ in range(2):
        lexical_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")


def job1_lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "lexical-index")
    _index(spark, sf_dir, folder)
    return lexical_index.whole(spark, f"{folder}/index")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "retrieval-report")
    _index(spark, sf_dir, folder)
    for _ in range(2):
        retrieval_report.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("benchmark", "documents", "embeddings")), f"{folder}/index", f"{folder}/out")
    return retrieval_report.whole(spark, f"{folder}/out")


JOB1_SQL = f"""
WITH d AS (SELECT doc_id AS id, {LEXICAL.format("text")} AS toks FROM (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1) x),
p AS (SELECT id, CAST(length(toks) AS INT) AS length, CAST(floor(id / 1000) AS BIGINT) AS block, CAST(floor(id / 1000000) AS BIGINT) AS part, token, count(*) AS tf
  FROM (SELECT id, toks, unnest(list_append(toks, '')) AS token FROM d) x GROUP BY ALL)
SELECT 'posting' AS kind, part, block, token, id, tf, length, CAST(NULL AS BIGINT) AS df, CAST(NULL AS BIGINT) AS max_tf, CAST(NULL AS INT) AS min_length, CAST(NULL AS BIGINT) AS total_length FROM p
UNION ALL
SELECT 'block', part, block, token, NULL, NULL, NULL, count(*), max(tf), min(length), CAST(sum(length) AS BIGINT) FROM p GROUP BY part, block, token
"""

_HITS = {k: f"hit_{k}" for k in (1, 3, 5, 10, 20)}
_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in _HITS.values())

JOB2_SQL = f"""
WITH {dense_sql(DOT, "a.vec_id IN (SELECT item_id FROM benchmark)")}, {BM25}, {FUSED},
found AS (SELECT 'dense' AS stage, query_id, id, dense_score AS score, dense_rank AS rank FROM dense UNION ALL SELECT 'lexical', query_id, id, lexical_score, lexical_rank FROM bm25
  UNION ALL SELECT 'hybrid', query_id, id, hybrid_score, hybrid_rank FROM fused),
good AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN found f ON f.query_id = b.item_id JOIN documents d ON d.doc_id = f.id WHERE contains(lower(d.text), lower(b.text)) AND b.text <> ''),
results AS (SELECT f.*, g.id IS NOT NULL AS relevant FROM found f LEFT JOIN good g ON g.query_id = f.query_id AND g.id = f.id),
ranks AS (SELECT s.stage, b.item_id AS query_id, (SELECT min(rank) FROM results r WHERE r.relevant AND r.stage = s.stage AND r.query_id = b.item_id) AS first_rank FROM benchmark b, (VALUES ('dense'), ('lexical'), ('hybrid')) s(stage)),
metrics AS (SELECT *, coalesce(1.0 / first_rank, 0) AS mrr, {", ".join(f"CAST(coalesce(first_rank <= {k}, false) AS DOUBLE) AS {c}" for k, c in _HITS.items())} FROM ranks)
SELECT 'results' AS kind, stage, query_id, id, score, rank, relevant, CAST(NULL AS DOUBLE) AS first_rank, CAST(NULL AS DOUBLE) AS mrr, {_NONE}, CAST(NULL AS BIGINT) AS queries, CAST(NULL AS DOUBLE) AS mean_first_rank FROM results
UNION ALL SELECT 'metrics', stage, query_id, NULL, NULL, NULL, NULL, CAST(first_rank AS DOUBLE), CAST(mrr AS DOUBLE), {", ".join(_HITS.values())}, NULL, NULL FROM metrics
UNION ALL SELECT 'summary', stage, NULL, NULL, NULL, NULL, NULL, NULL, round(avg(mrr), 4), {", ".join(f"round(avg({c}), 4)" for c in _HITS.values())}, count(*), round(avg(first_rank), 4) FROM metrics GROUP BY stage
"""

QUERIES = {"job1_lexical_index": job1_lexical_index, "job2_retrieval_report": job2_retrieval_report}
SQL = {"job1_lexical_index": JOB1_SQL, "job2_retrieval_report": JOB2_SQL}
