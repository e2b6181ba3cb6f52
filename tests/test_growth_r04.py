"""What a plan does once, and doesn't do where it can give nothing."""

import re

from pyspark.sql import functions as F

from gleaner.functions import specs as S
from gleaner.functions import text as T
from gleaner.operators import chunking, metadata


def test_strip_takes_all_white_space_and_no_other_sign(spark):
    old = F.regexp_replace("c", rf"(?U)^[{T.BLANK}]+|[{T.BLANK}]+$", "")
    signs = [(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + [(chr(0x1F600),), ("",), (None,), (" a b　\x1f",)]
    rows = spark.createDataFrame(signs, "c string")
    assert rows.where(~T.strip(F.col("c")).eqNullSafe(old)).count() == 0
    assert "regexp_replace" not in rows.select(T.strip(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()


#: Texts with a specification, or two lines whose match begins in one and ends in the other.
HELD = ["3 x UART", "UART ports: 4", "USB 2.0 : 6", "four CAN\n= 2", "4\nGB RAM x", "RAM 4\nGB", "1 GbE LAN", "LAN 1000", "MIPI\nDSI", "Power 12\nV", "DC 5V", "RK3568", "i.MX\n8M plus", "ſTM32F4", "Yocto\n3.1", "FW\nv1.2", "P01D00001", "Flash 16\x1cMB", "2×USB", "3² CAN", "stRK3588", "Kameras nxp", "v1.2", "plain text"]


def _chunks(spark, texts):
    """Records of parents, each with a child for every pair of places between tokens."""
    spans = [(i, t, *span) for i, t in enumerate(texts) for span in {(a, b) for m in [[x.span() for x in chunking.TOKEN.finditer(t)]] for a, _ in m for _, b in m if a < b}]
    parents = spark.createDataFrame([(f"s{i}.pdf", 1, 1, "", 0, 0, len(t), t, None, None) for i, t in enumerate(texts)], "source string, section_no int, p_no int, parent_section string, parent_heading_level int, parent_char_start int, parent_char_end int, parent_text string, question string, answer string")
    own = "source string, section_no int, p_no int, parent_index int, parent_start_page int, parent_end_page int, parent_id string, parent_child_index int, parent_child_count int, char_start int, char_end int, start_page int, end_page int, file_path string, chunk_index int, chunk_id string, prev_chunk_id string, next_chunk_id string"
    children = spark.createDataFrame([(f"s{i}.pdf", 1, 1, 1, 1, 1, f"p{i}", 1, 1, a, b, 1, 1, f"s{i}.pdf", n, f"c{n}", "", "") for n, (i, _, a, b) in enumerate(spans)], own)
    return metadata.chunk_records(parents, children)


def test_what_a_parent_rules_out_is_in_none_of_its_children(spark):
    texts = HELD + [f"{b} {a}" for a, b in zip(HELD, HELD[1:] + HELD[:1], strict=True)] + ["G board RAM 4", "VDC power 12", "ports: UART", "x UART 3"]
    meta = F.concat("text", F.lit("\n\n"), "parent_text")
    rows = _chunks(spark, texts).withColumn("payload", S.extract(meta))
    plain = {"specs": F.col("payload.specs"), "tags": T.tags(F.col("text")), "chip_models": T.chip_models(meta), "text_product_codes": T.product_codes(meta), "vendors": T.vendors_of(meta, T.chip_models(meta)), "version": T.version(meta), "parent_token_count": T.count_length_tokens(F.col("parent_text"))}
    differ = F.coalesce(*(F.when(~F.col(c).eqNullSafe(e), F.lit(c)) for c, e in plain.items()), F.when(F.to_json("spec_evidence") != F.to_json("payload.spec_evidence"), "evidence"))
    wrong = rows.select("text", "parent_text", differ.alias("differ")).where("differ is not null").collect()
    assert wrong == []
    assert rows.count() > 300
    assert [r.x for r in spark.createDataFrame([("a plain text",), ("from the program",), ("RAM 4 GB",)], "t string").select(S.possible(F.col("t")).alias("x")).collect()] == [False, False, True]


def test_a_parents_text_is_read_before_its_children_are_rows(spark):
    plan = _chunks(spark, ["one two", "three"])._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"Generate explode\(children", plan)
    assert "may_specs" in below and "STM32" not in above.split("parent_token_count")[-1]
    assert below.count("AS may_specs") == 1 and "AS may_specs" not in above


def test_an_index_has_a_file_for_a_small_part_and_no_rows_twice(spark, tmp_path):
    import glob

    from gleaner.operators import lexindex

    docs = spark.range(400).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 50), F.concat(F.lit("v"), "id")).alias("text"))
    root = str(tmp_path / "index")
    lexindex.update(spark, root, docs, part_ids=10, block_ids=5)
    for table in ("postings", "blocks"):  # 40 parts, 4 tasks
        assert len(glob.glob(f"{root}/{table}/part=*/*.parquet")) == 40
    counts = lexindex.update(spark, root, docs.where("id % 2 = 0").withColumn("text", F.lit("new all")), part_ids=10, block_ids=5)
    assert counts == {"documents": 200, "deleted": 0, "parts": 40, "postings": 200 * 3 + 200 * 4}
    blocks = {(r.block, r.token): (r.df, r.max_tf, r.min_length) for r in lexindex.blocks(spark, root).collect()}
    assert blocks[0, "all"] == (5, 1, 2) and blocks[0, "new"] == (3, 1, 2) and (0, "v0") not in blocks and blocks[0, "v1"] == (1, 1, 3)


def test_few_queries_meet_the_index_by_block(spark, tmp_path, monkeypatch):
    from gleaner.operators import lexindex

    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 31)).alias("text"))
    asked = spark.createDataFrame([(q, f"all w{q % 7} v{q} w{q % 3}") for q in range(20)] + [(20, "nothing here")], "query_id long, question string")
    root = str(tmp_path / "index")
    lexindex.update(spark, root, docs.where("id < 200"), part_ids=100, block_ids=10)
    lexindex.update(spark, root, docs.where("id >= 195"), part_ids=100, block_ids=10)
    few, seen = lexindex.search(spark, root, asked, 5)
    got, scored = sorted(few.collect()), sorted(seen.collect())
    monkeypatch.setattr(lexindex, "FEW_QUERIES", 5)
    many, again = lexindex.search(spark, root, asked, 5)
    assert got == sorted(many.collect()) and scored == sorted(again.collect()) and len(got) == 100
    weights, rows = lexindex.save(lexindex._weights(asked, lexindex.blocks(spark, root)), "weights"), lexindex.postings(spark, root)
    wanted = spark.createDataFrame([(1, 2)], "query_id long, block long")
    plan = lambda few: lexindex.scores(wanted, weights, rows, 6, few)._jdf.queryExecution().executedPlan().toString()
    pair = re.compile(r"Exchange hashpartitioning\(query_id#\d+L?, id#")
    assert pair.search(plan(False)) and not pair.search(plan(True))


def test_tokens_that_nobody_asks_for_are_dropped_where_texts_are_read(spark, monkeypatch):
    from gleaner.operators import retrieval

    plans = []
    keep = retrieval.save
    monkeypatch.setattr(retrieval, "save", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    docs = spark.createDataFrame([(i, f"all w{i % 5} v{i}") for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(1, "w1 v3"), (2, "absent")], "query_id long, question string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = retrieval.lexical(asked, docs, 5).collect()
        monkeypatch.setattr(retrieval, "FEW_TOKENS", 0)
        assert few == retrieval.lexical(asked, docs, 5).collect() and len(few) == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
