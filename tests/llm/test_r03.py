"""Findings of round 3: training-data operators."""

from pyspark.sql import functions as F

from gleaner.llm import chat, common, decontam


def test_windows_and_runs_are_never_broadcast(spark):
    """Small tables here, so that Spark would broadcast what isn't dealt out by key."""
    bench = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(12)))], "item_id long, text string")
    items = decontam.items_of(bench)
    run = "doc long, key_b long, m int, run long"
    runs = common.save(spark.createDataFrame([(1, 2, 12, 0, 8)], f"{run}, span int"), "t-runs")
    grams = common.save(spark.createDataFrame([(1, 2, 12, 0, p, f"g{p}") for p in range(8)], f"{run}, p int, gram string"), "t-grams")
    met = common.save(runs.select("doc", "key_b", "m", "run").crossJoin(items.select("item")), "t-met")
    near = decontam.candidates(grams, runs, met, items)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (near, decontam._steps(common.save(runs.select("doc", "key_b", "m", "run", F.lit(0).alias("s")).crossJoin(items.select("item")), "t-near"), grams, runs, items))]
    for plan in plans:
        joined = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert not any("run#" in line for line in joined), plan
        assert "SortMergeJoin" in plan


def test_examples_are_rows_with_their_texts(spark, monkeypatch):
    """Each example's text is made, and what is read back comes from it alone."""
    monkeypatch.setattr(chat, "GROUP", 2)
    monkeypatch.setattr(chat, "TEXT_IN_BATCH", 50)
    rows = [(1, i, "assistant" if i % 2 else "user", f"</s> <{i}>[INST]") for i in range(11)] + [(2, 0, "assistant", None)]
    parts = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = chat.spelled(parts)
    key = lambda x: (x["conv_id"], x["example"])
    assert sorted(made.collect(), key=key) == sorted(chat.materialize(parts).select(*made.columns).collect(), key=key)
    other = chat.read_back(made.withColumn("text", F.expr("replace(text, 'user', 'system')")).withColumn("loss_start", F.col("loss_start") + 2 * F.col("example") + 2).where("conv_id = 1"))
    got = {r["example"]: r for r in other.collect()}
    assert [(got[e]["n_turns"], got[e]["reply"]) for e in range(5)] == [(2 * e + 2, f"</s> <{2 * e + 1}>[INST]") for e in range(5)]
    first = {r["example"]: r["turns_sha256"] for r in chat.read_back(made.where("conv_id = 1")).collect()}
    assert all(first[e] != got[e]["turns_sha256"] for e in first)


def test_only_texts_that_are_wanted_again_are_dealt_out(spark):
    """The map drops most other texts where they are read, and none that is wanted."""
    from pyspark.sql import functions as F

    from gleaner.llm import neardup
    from gleaner.llm.common import row_key

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.select("doc_id", *row_key(), "text")
    wanted = docs.where("doc_id % 16 = 3")
    got = {r.doc_id for r in neardup._perhaps(docs, wanted.select("doc_id", "key_a")).select("doc_id").collect()}
    want = set(range(3, 20_000, 16))
    assert want <= got and len(got) < len(want) + 40
    copy = docs.withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert neardup._perhaps(copy, wanted.select("doc_id", "key_a")).count() < 80
    none = neardup._perhaps(docs, wanted.where("false").select("doc_id", "key_a"))
    assert none.isEmpty() and none.columns == docs.columns


def test_sets_deal_out_no_other_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gleaner.llm import neardup

    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.hash(F.col("id"), F.lit(i)).cast("string") for i in range(30))).alias("text"))
    docs = rows.unionByName(rows.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 10_000))
    docs = docs.unionByName(rows.where("doc_id < 40").select((F.col("doc_id") + 20_000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text")))
    asked = []
    keep = neardup._perhaps
    monkeypatch.setattr(neardup, "_perhaps", lambda d, k: asked.append(keep(d, k)) or asked[-1])
    got = {r.doc_id: r.component_id for r in neardup.classes(docs, size=4, percent=80).collect()}
    assert got == {i: i for i in range(3_000)} | {i + 10_000: i for i in range(5)} | {i + 20_000: i for i in range(40)}
    assert asked and all(df.count() < 120 for df in asked)
