"""Inverted cells against exact search, table functions against plain calls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import tabular
from gleaner.operators import cells, chunking, planner, retrieval
from gleaner.plans import retrieval_queries as RQ

SCHEMA = "id long, vector array<float>"


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


def test_recall_of_cells_topk_l2(spark, sf_dir):
    exact, near = RQ.dense_topk_l2(spark, sf_dir), RQ.cells_topk_l2(spark, sf_dir)
    want, got = pairs(exact), pairs(near)
    assert len(want & got) >= 0.9 * len(want)
    assert {(r["query_id"], r["dense_rank"]) for r in near.collect()} == {(r["query_id"], r["dense_rank"]) for r in exact.collect()}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def clouds(spark):
    """Forty clouds, one of which holds a third of all rows; ties and odd rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 6
    home = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 40, 3000))
    x = (centres[home] + rng.normal(size=(3000, 8))).astype(np.float32)
    x[:30] = x[30]
    odd = [(9001, None), (9002, [1.0] * 7), (9003, [None] + [1.0] * 7), (9004, [float("nan")] * 8), (9005, [])]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, SCHEMA).repartition(6)


@pytest.mark.parametrize("measure", ["l2", "ip"])
def test_all_cells_are_exact(spark, clouds, measure):
    _, df = clouds
    asked = df.where("id % 100 = 0 or id > 9000").select(F.col("id").alias("query_id"), "vector")
    fine = df.where("id < 9000")
    made = cells.build(df, cells=20, probes=20)
    columns = ["query_id", "id", "dense_score", "dense_rank"]
    want = retrieval.dense(asked.where("query_id < 9000"), fine, 10, measure).select(columns)
    assert sorted(map(tuple, cells.search(asked, made, 10, measure).select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_probes_are_few_and_enough(spark, clouds, monkeypatch):
    """A crowded cell is kept in parts; clouds apart need few cells."""
    monkeypatch.setattr(cells, "CELL_ROWS", 60)
    x, df = clouds
    made = cells.build(df, k=10)
    assert made.probes < len(made.centroids) / 3 and made.index.count() == len(x)
    sizes = [r["count"] for r in made.index.groupBy("cell", "part").count().collect()]
    assert max(sizes) < 100 and made.parts.agg(F.max("parts")).first()[0] >= 2
    asked = df.where("id % 50 = 0 and id < 9000").select(F.col("id").alias("query_id"), "vector")
    want = pairs(retrieval.dense(asked, df.where("id < 9000"), 10, "l2"))
    assert len(want & pairs(cells.search(asked, made, 10))) >= 0.9 * len(want)


def test_collections_of_little(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<float>")
    assert cells.build(none) is None and cells.search(asked, None).collect() == []
    one = cells.build(spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, None)], SCHEMA))
    assert [(r["id"], r["dense_score"]) for r in cells.search(asked, one).collect()] == [(5, 1.0), (5, 1.0)]
    assert cells.search(asked.where("false"), one).collect() == []


def test_table_functions(spark):
    tabular.register(spark)
    text = "First words of it. Second part; third part, more words\nand a line " * 30
    df = spark.createDataFrame([(1, text, "支援 LVDS, 4 x UART ports of NXP"), (2, None, None), (3, "", ""), (4, "short", "nothing")], "id int, text string, question string")
    got = spark.sql("SELECT id, t.* FROM {d} d, LATERAL split_tokens(d.text, 60, 10) t", d=df).collect()
    spans = chunking.split_spans(text, chunking.Budget(60, 10))
    assert sorted(map(tuple, got)) == [(1, i, a, b, text[a:b]) for i, (a, b) in enumerate(spans, 1)] + [(4, 1, 0, 5, "short")]
    pieces = spark.sql("SELECT t.* FROM {d} d, LATERAL recursive_spans(d.text, 60) t WHERE d.id = 1", d=df).collect()
    assert sorted((r["c_start"], r["c_end"]) for r in pieces) == sorted(chunking.recursive_spans(text, 60))
    conditions = spark.sql("SELECT id, c.* FROM {d} d, LATERAL plan_conditions(d.question, array('NXP', null)) c", d=df).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in conditions] == [tuple(c[f] for f in planner.FIELDS) for c in planner.plan("支援 LVDS, 4 x UART ports of NXP", ["NXP"])]
    for wrong in ("split_tokens(d.text, 0, 0)", "split_tokens(d.text, 10, 10)", "split_tokens(d.id, 10, 1)", "recursive_spans(d.text, d.id)", "plan_conditions(d.id)"):
        with pytest.raises(Exception, match="must|can't be"):
            spark.sql(f"SELECT t.* FROM {{d}} d, LATERAL {wrong} t", d=df).collect()
