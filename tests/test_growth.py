"""Work that must not grow faster than the input, seen in plans and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as T


def test_table_rows_cleans_each_cell_once(spark):
    """Every value inside a lambda is named once: a cell's cleaning stands in the
    expression once, not once for each place that reads it."""
    rows = spark.createDataFrame([([["Part", "Quantity"], ["7", ""], ["", ""], ["8", "5", "x"]], 3)], "cells array<array<string>>, id int").select(T.table_rows(F.col("cells"), F.col("id")).alias("text"))
    assert rows.first()["text"] == "Table: Table 3\nRow 1:\nPart: 7\nRow 2:\nPart: 8\nQuantity: 5\nColumn 3: x"
    assert str(rows._jdf.queryExecution().analyzed()).count("translate(") == 1


def test_costly_rows_of_a_small_file_are_many_tasks(spark, sf_dir):
    """A part's sheet and question cost much more than its bytes: one file of a few
    kilobytes is worked on by all tasks of a shuffle, also under adaptive execution."""
    from gleaner.plans.queries import QUERIES

    for name in ("spec_extract", "plan_conditions", "plan_conditions_lateral"):
        made = QUERIES[name](spark, sf_dir)
        assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")), name


def test_dense_compares_blocks_as_matrices(spark):
    """No row is made for a pair; nulls, other widths, ties, rounding and near vectors as
    when every pair is a row."""
    from gleaner.operators import retrieval

    nan, big = float("nan"), 1e6
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.5, None]), (5, [1.0]), (6, [nan, 1.0]), (7, [0.0000005, 0.0]), (8, [0.0000015, 0.0]), (9, [big, big]), (10, [big, big + 1])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [big, big]), (3, None), (4, [2.0])], "query_id long, vector array<double>")
    got = {}
    for measure in ("ip", "l2"):
        made = retrieval.dense(asked, vectors, 20, measure)
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
        for r in made.collect():
            got.setdefault((measure, r.query_id), []).append((r.dense_rank, r.id, r.dense_score))
    ranked = lambda m, q: [(i, s) for _, i, s in sorted(got[m, q])]
    assert [i for i, _ in ranked("ip", 1)] == [6, 9, 10, 1, 2, 8, 7, 3, 4, 5]
    assert ranked("ip", 1)[5:7] == [(8, 2e-06), (7, 1e-06)]  # half up
    assert ranked("ip", 1)[7:] == [(3, None), (4, None), (5, None)]
    assert ranked("l2", 2)[1:3] == [(9, 1.0), (10, 0.5)]
    assert [s for _, s in ranked("ip", 3)] == [None] * 10
    assert ranked("l2", 4)[0] == (5, 0.5)
    for measure in ("ip", "l2"):  # also where a block has more than the best
        few = retrieval.dense(asked, vectors.where("id <> 6"), 2, measure).collect()
        every = retrieval.dense(asked, vectors.where("id <> 6"), 20, measure).where("dense_rank <= 2").collect()
        assert sorted(map(str, few)) == sorted(map(str, every))


def test_a_search_keeps_only_what_is_asked_for(spark, monkeypatch):
    """Without an index, no posting of a token that nobody asks for is shuffled or
    written, and few and many tokens give the same."""
    from gleaner.operators import retrieval

    docs = spark.createDataFrame([(i, f"alpha w{i} beta{' beta' * (i % 3)} tail{i}") for i in range(50)] + [(50, None), (51, "")], "id long, text string").fillna("")
    asked = spark.createDataFrame([(1, "beta w7 beta"), (2, "absent"), (3, "alpha")], "query_id int, question string")
    written = []
    keep = retrieval.save
    monkeypatch.setattr(retrieval, "save", lambda df, name: written.append(keep(df, name)) or written[-1])
    few = sorted(map(tuple, retrieval.lexical(asked, docs, 5).collect()))
    assert {r.token for t in written for r in t.select("token").distinct().collect()} == {"", "alpha", "beta", "w7"}
    monkeypatch.setattr(retrieval, "FEW_TOKENS", 0)
    assert few == sorted(map(tuple, retrieval.lexical(asked, docs, 5).collect()))
    assert few == sorted(map(tuple, retrieval.lexical(asked, docs, 5, index=retrieval.index_of(docs)).collect()))
    assert len(few) == 10
