"""What a plan does once, and does no more often on larger input."""

from pyspark.sql import functions as F

from gleaner.functions import specs as S
from gleaner.plans import retrieve as R


def test_indexed_makes_each_chunk_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.col("id").alias("chunk_index"), F.col("id").cast("string").alias("chunk_id"))
    out = R.indexed(rows.mapInArrow(run, rows.schema)).orderBy("position").collect()
    assert made.value == 500
    assert [(r.source, r.chunk_index) for r in out] == sorted((f"s{i % 7}", i) for i in range(500))


def test_texts_without_a_fields_words_are_not_cut_into_windows(spark):
    """Letters that patterns take for ASCII ones count as those."""
    texts = ["lvdſ panel", "ANDROİD 12", "Ka RK3568", "16\x1c\nGB RAM", "the board has 3\n \nUART", "plain words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", S.extract("text")["specs"].alias("s")).orderBy("id").collect()
    got = [(r.s.has_lvds, list(r.s.os_list), list(r.s.cpu_soc), r.s.ram_gb, r.s.uart_count) for r in rows]
    assert got == [(True, [], [], None, None), (None, ["ANDROİD 12"], [], None, None), (None, [], ["RK3568"], None, None), (None, [], [], 16.0, None), (None, [], [], None, None), (None, [], [], None, None)]
    gates = spark.createDataFrame([(t,) for t in texts], "one string").select(S._gates(F.col("one")).alias("g")).collect()
    assert not any(gates[-1].g) and gates[0].g.flags and gates[1].g.named


def test_only_the_last_texts_of_a_bucket_are_split_for_its_rest(spark):
    from gleaner.llm import mixing

    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((30, 50, 40, 7))]
    rows, inner = [], 0
    for i, text in enumerate(texts):
        n = len(text.split())
        rows.append((1, 0, "s", i, inner, inner, n, 2, 0, 5, 9, text))
        inner += n
    placed = spark.createDataFrame(rows, "sid int, bucket int, source string, doc_id int, start long, inner long, size long, full long, first_block long, first_left long, all_full long, text string")
    own, rest = mixing._pieces(placed, 50)
    at = lambda df: [tuple(r) for r in df.select("doc_id", "block", "low", "n", "text").orderBy("block", "low").collect()]
    words = [x.split() for x in texts]
    assert at(own) == [(0, 0, 0, 30, texts[0]), (1, 0, 30, 20, " ".join(words[1][:20])), (1, 1, 0, 30, " ".join(words[1][20:])), (2, 1, 30, 20, " ".join(words[2][:20]))]
    assert at(rest) == [(2, 9, 5, 20, " ".join(words[2][20:])), (3, 9, 25, 7, texts[3])]
    plan = rest._jdf.queryExecution().analyzed().toString()
    below = plan[plan.rindex("split(") :].split("\n", 1)[1]
    assert any("Filter" in line and "size" in line and "inner" in line for line in below.split("\n")), plan


def test_cells_and_their_queries_meet_as_matrices(spark):
    from gleaner.operators import cells

    rows = spark.range(300).select("id", F.array(*(F.sin(F.col("id") * k) for k in range(1, 5))).alias("vector"))
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = cells.build(rows, k=3, cells=4, probes=4)
    found = cells.search(asked, index, k=3)
    assert "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.where("dense_rank = 1").orderBy("query_id").collect()
    assert [(r.query_id, r.id, r.dense_score) for r in got] == [(q, q, 1.0) for q in (0, 100, 200)]
