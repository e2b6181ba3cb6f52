"""Operators on literal rows with answers worked out by hand, and invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import display
from gleaner.functions import specs as S
from gleaner.functions import text as T
from gleaner.operators import chunking, evaluate, expand, inspect, pages, planner, retrieval
from gleaner.plans import fixtures as X
from gleaner.plans import retrieve as R
from gleaner.sources import files, services


def words(n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice(["alpha", "beta", "i.MX8", "串", "gamma-ray", "x"]) + r.choice([" ", " ", ", ", ". ", "\n", "\n\n", "; "]) for _ in range(n))


@pytest.mark.parametrize("n,size,overlap", [(0, 20, 5), (10, 20, 5), (500, 50, 10), (2000, 320, 50), (900, 30, 29)])
def test_split_spans(n, size, overlap):
    text = words(n, n)
    budget = chunking.Budget(size, overlap)
    spans = chunking.split_spans(text, budget)
    starts = [a for a, _ in spans]
    assert starts == sorted(set(starts))
    covered = set()
    for a, b in spans:
        assert 0 <= a < b <= len(text) and text[a:b] == text[a:b].strip()
        if len(spans) > 1:
            assert len(chunking.TOKEN.findall(text[a:b])) <= size
        covered |= set(range(a, b))
    assert all(text[i].isspace() or i in covered for i in range(len(text)))


def test_split_prefers_paragraphs():
    text = " ".join(["w"] * 30) + "\n\n" + " ".join(["v"] * 60)
    (a, b), *_ = chunking.split_spans(text, chunking.Budget(40, 5))
    assert text[a:b] == " ".join(["w"] * 30)


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_recursive_spans(size):
    text = words(200, 9)
    spans = chunking.recursive_spans(text, size)
    assert all(b - a <= size for a, b in spans)
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
    grown = chunking.overlapped(text, spans, 12)
    assert all(a2 <= a and b2 == b for (a, b), (a2, b2) in zip(spans, grown, strict=True))


def window_by_hand(text, start, end, most):
    spans = [m.span() for m in chunking.TOKEN.finditer(text)]
    inside = [i for i, (a, b) in enumerate(spans) if b > start and a < end]
    return spans, inside


@pytest.mark.parametrize("most", [1, 5, 30, 1000])
def test_token_window(most):
    text = words(120, 4)
    for start, end in [(0, 10), (100, 200), (len(text) - 5, len(text)), (50, 50)]:
        out = expand.token_window(text, start, end, most)
        spans, inside = window_by_hand(text, start, end, most)
        if len(spans) <= most:
            assert out == text.strip()
            continue
        body = out.removeprefix("[...]\n").removesuffix("\n[...]")
        assert body in text
        assert len(chunking.TOKEN.findall(body)) == max(most, len(inside), 1)


def test_questions():
    got = [(q, c["ord"], c["field"], c["op"], next(str(v).lower() if isinstance(v, bool) else str(v) for v in (c["num_value"], c["bool_value"], c["str_value"]) if v is not None)) for q, text in X.QUESTIONS for c in planner.plan(text)]
    assert got == X.CONDITIONS


def test_comparators():
    assert [planner.comparator(x) for x in ("不超過", "不少於", "小於等於", "=", "none")] == [">", ">=", "<=", "==", None]
    assert planner.plan("3 個 UART 不超過")[0]["op"] == ">"
    assert planner.plan("UART > 3") == []
    assert planner.vendor_mentions("Renzsas and st parts") == ["ST", "Renesas"]


def test_native_specs_agree(spark):
    texts = [t for _, _, t in X.TEXTS] + [X.SHEET.replace("GB", " MB"), "Windows CE and Android 11 on RK3588S, i.MX 8M x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.extract("t").alias("x"), S.native_capacity(F.col("t"), "ram_gb").alias("ram"), S.native_systems(F.col("t")).alias("os"), S.native_chips(F.col("t")).alias("soc")).orderBy("i").collect()
    for r in rows:
        s = r["x"]["specs"]
        assert (r["ram"], r["os"], r["soc"]) == (s["ram_gb"], s["os_list"], s["cpu_soc"])
    assert rows[-1]["os"] == ["Android 11", "Windows CE"] and rows[-1]["soc"] == ["RK3588S", "i.MX 8M x"] and rows[-2]["ram"] == 2 / 1024


def test_single_page(spark):
    page = spark.createDataFrame([("a", "a.pdf", 1, "one1\ntwo2\nthree\nfour\nfive")], files.PAGE)
    assert [r["text"] for r in files.clean_pages(page).collect()] == ["three"]
    assert {r["line"] for r in pages.repeated_lines(page).collect()} == {"one1", "two2", "four", "five"}


def test_neighbours(spark):
    chunks = spark.createDataFrame([("c1", "", "c2"), ("c2", "c1", "c3"), ("c3", "c2", "c4"), ("c4", "c3", "")], "id string, prev_chunk_id string, next_chunk_id string")
    hits = spark.createDataFrame([(1, "c3", 1, 5.0), (1, "c2", 2, 4.0), (1, "c1", 3, 3.0)], "query_id int, id string, final_rank int, rerank_score double")
    rows = expand.neighbours(hits, chunks, 1).orderBy("ord").collect()
    assert [(r["id"], r["is_adjacent"], r["adjacent_to"], round(r["rerank_score"], 3)) for r in rows] == [("c3", False, None, 5.0), ("c2", True, "c3", 4.999), ("c4", True, "c3", 4.999), ("c1", True, "c2", 3.999)]


def test_fusion(spark):
    d = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id int, id string, dense_score double, dense_rank int")
    x = spark.createDataFrame([(1, "b", 3.0, 1), (1, "c", 2.0, 2)], "query_id int, id string, lexical_score double, lexical_rank int")
    assert [(r["id"], r["hybrid_score"]) for r in retrieval.fuse(d, x).orderBy("hybrid_rank").collect()] == [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]


def test_targets(spark):
    results = spark.createDataFrame([(1, "dense", 1, "k1", "s.pdf", 3, 5, ["A"], "Some Text"), (1, "dense", 2, "k2", "t.pdf", 1, 1, ["A", "B"], "other")], "query_id int, stage string, rank int, chunk_id string, source string, start_page int, end_page int, vendors array<string>, text string")
    none = dict.fromkeys(f.split()[0] for f in evaluate.TARGET.split(", "))
    cases = [({"chunk_id": "k2"}, 2), ({"page": 4}, 1), ({"source": "t.pdf", "page": 4}, None), ({"vendors": ["B"]}, 2), ({"text_contains": "some text"}, 1), ({}, None), ({"start_page": 5}, 1), ({"end_page": 2}, 2)]
    queries = spark.createDataFrame([(1,)], "query_id int")
    stages = spark.createDataFrame([("dense",)], "stage string")
    for target, rank in cases:
        t = spark.createDataFrame([(1, *(none | target).values())], "query_id int, " + evaluate.TARGET)
        assert evaluate.first_ranks(results, t, stages, queries).first()["first_rank"] == rank, target


def test_missing_targets_are_an_error(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    with pytest.raises(Exception, match="query without targets"):
        evaluate.checked_targets(queries.where("query_id = 1"), queries).collect()


def test_summary(spark):
    ranks = spark.createDataFrame([(1, "dense", 1), (2, "dense", None), (3, "dense", 4)], "query_id int, stage string, first_rank int")
    r = evaluate.stage_summary(ranks).first()
    assert (r["mrr"], r["mean_first_rank"], r["hit_1"], r["hit_3"], r["hit_5"]) == (0.4167, 2.5, 0.3333, 0.3333, 0.6667)


def test_overlap_and_gap(spark):
    rows = spark.createDataFrame([("s", 1, 0, 100), ("s", 2, 80, 180), ("s", 3, 200, 300)], "source string, position int, char_start int, char_end int")
    got = [(r["overlap_with_previous_chars"], r["gap_from_previous_chars"]) for r in inspect.overlaps(rows).orderBy("position").collect()]
    assert got == [(None, None), (20, None), (None, 20)]


def test_pdf_folder(spark, tmp_path):
    """Flat: subfolders, also ones that look like partitions, are neither read nor in the way."""
    folder = tmp_path / "docs"
    for sub in (folder / "x=1", folder / "sub"):
        sub.mkdir(parents=True)
        (sub / "b.pdf").write_bytes(b"y")
    decode = lambda _: [(1, ["Head line", "body of page one", "Foot line"], [[["Name", "Size"], ["ram", "2GB"]]]), (2, ["Head line", "second body", "more of it", "Foot line"], [])]
    for missing in (str(folder), str(tmp_path / "nowhere")):
        with pytest.raises(FileNotFoundError):
            files.read_pdfs(spark, missing, decode)
    (folder / "a.pdf").write_bytes(b"x")
    rows = files.read_pdfs(spark, str(folder), decode).orderBy("page").collect()
    assert [r["page"] for r in rows] == [1, 2] and "[TABLE 1]" in rows[0]["text"] and "second body" in rows[1]["text"] and {r["source"] for r in rows} == {"a.pdf"}


def test_round_trips(spark, tmp_path):
    page = spark.createDataFrame([("a", "a.pdf", 1, "日本 \"x\"")], files.PAGE)
    files.write_jsonl(page, str(tmp_path / "p"))
    assert files.read_jsonl(spark, str(tmp_path / "p"), files.PAGE).collect() == page.collect()
    vectors = page.select(F.col("source").alias("chunk_id"), services.encode(F.col("text")).alias("embedding"))
    files.write_vectors(vectors, str(tmp_path / "v"))
    assert len(files.read_vectors(spark, str(tmp_path / "v")).first()["embedding"]) == 64


def test_answers(spark):
    prompts = spark.createDataFrame([(1, "ok"), (2, "bad")], "query_id int, prompt string")

    def generator(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    assert [tuple(r) for r in services.answers(prompts, generator).orderBy("query_id").collect()] == [(1, "OK", None), (2, None, "ValueError: no")]


def test_faq_source(spark):
    page = spark.createDataFrame([("faq.pdf", "faq.pdf", 1, "Intro\nQ: What?\nA: That.\nmore\nQuestion: Why?\nAnswer: So.")], files.PAGE)
    rows = R.chunks_of(page).orderBy("chunk_index").collect()
    assert [(r["question"], r["answer"], r["chunk_id"], r["parent_id"]) for r in rows] == [("What?", "That.\nmore", "faq.pdf-p1-1-c1", "faq.pdf-p1-1-faq-parent-1"), ("Why?", "So.", "faq.pdf-p1-1-c2", "faq.pdf-p1-1-faq-parent-2")]
    assert [(r["prev_chunk_id"], r["next_chunk_id"]) for r in rows] == [("", "faq.pdf-p1-1-c2"), ("faq.pdf-p1-1-c1", "")]
    assert rows[0]["char_start"] == 6


def test_chunks_keep_their_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = files.clean_pages(R.pages_from_documents(docs))
    chunks = R.chunks_of(clean).select("source", "char_start", "char_end", "text", "token_count")
    rows = chunks.join(pages.documents_of(clean).select("source", F.col("text").alias("all")), "source").collect()
    assert rows and all(r["all"][r["char_start"] : r["char_end"]] == r["text"] and r["token_count"] <= 320 for r in rows)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], files.PAGE)
    assert files.clean_pages(none).count() == 0
    assert R.chunks_of(none).count() == 0
    empty = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id int, question string")
    assert retrieval.lexical(asked, empty).count() == 0
    assert T.VENDORS


def test_known_values_as_lists_and_records(spark):
    rows = [(1, ["a", None, "", "0"], "x", {"u": 1}), (2, [], "", {}), (3, None, None, None), (4, ["", None], "y\"", {"v": None})]
    df = spark.createDataFrame(rows, "id int, many array<string>, one string, map map<string,int>")
    got = {r["id"]: r for r in df.select("id", display.compact_list(F.col("many")).alias("a"), display.compact_list(F.col("one"), many=False).alias("b"), display.known_json(dict(df.dtypes), ("many", "one", "map", "none")).alias("j")).collect()}
    assert [got[i]["a"] for i in (1, 2, 3, 4)] == [["a", "0"], [], [], []]
    assert [got[i]["b"] for i in (1, 2, 3, 4)] == [["x"], [], [], ['y"']]
    assert json.loads(got[1]["j"]) == {"many": ["a", None, "", "0"], "one": "x", "map": {"u": 1}} and json.loads(got[2]["j"]) == {"one": ""} and got[3]["j"] == "{}"
    numbers = df.select(display.compact_list(F.array(F.lit(0), F.lit(None).cast("int"), F.lit(7))).alias("n"))
    assert numbers.first()["n"] == ["0", "7"] and df.select(display.known_json({}, ("many",)).alias("j")).first()["j"] == "{}"
