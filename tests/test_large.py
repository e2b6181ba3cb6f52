"""Documents larger than a task, medians, facets, marks: against plain Python."""

import html
import random
import re
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.operators import inspect, pages, running, sections
from gleaner.plans import retrieval_queries as RQ
from gleaner.sources import files


@pytest.mark.parametrize("block", [1, 3, 50])
def test_running_sums(spark, monkeypatch, block):
    monkeypatch.setattr(running, "BLOCK", block)
    r = random.Random(block)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(40)]), i, r.choice([None, 1, 5, -2])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, o int, t int, v int").repartition(5)
    got = {x["t"]: (x["s"], x["m"]) for x in running.before(df, "k", "o", ["t"], s=(F.sum, F.col("v")), m=(F.max, F.col("v"))).collect()}
    assert len(got) == 120
    for k, o, t, _ in rows:
        earlier = [v for kk, oo, tt, v in rows if kk == k and (oo if oo is not None else -1, tt) < (o if o is not None else -1, t) and v is not None]
        assert got[t] == ((sum(earlier), max(earlier)) if earlier else (None, None))
    assert running.before(df.where("false"), "k", "o", s=(F.sum, F.col("v"))).collect() == []


def sections_by_hand(text):
    """(start, end, heading) of the sections that aren't blank."""
    marks, at = [], 0
    for line in text.split("\n"):
        if re.fullmatch(r"\d+\. title \d+", line):
            marks.append((at, line))
        at += len(line) + 1
    cuts = ([(0, "")] if not marks or marks[0][0] else []) + marks
    ends = [a for a, _ in cuts[1:]] + [len(text)]
    return [(a, b, name) for (a, name), b in zip(cuts, ends, strict=True) if text[a:b].strip()]


@pytest.mark.parametrize("block", [2, 4_096])
def test_sections_of_sources_that_are_no_rows(spark, monkeypatch, block):
    """Pages to sections without their document: same as of the whole text."""
    monkeypatch.setattr(running, "BLOCK", block)
    r = random.Random(1)
    line = lambda: r.choice(["", "body text of a line", f"{r.randint(1, 9)}. title {r.randint(1, 99)}", "x " * 12])
    rows = [(s, f"{s}.pdf", p, "\n".join(line() for _ in range(r.randint(1, 6)))) for s in ("a", "b", "c") for p in range(1, 12 if s != "c" else 2)]
    rows += [("blank", "blank.pdf", 1, "\n"), ("plain", "plain.pdf", 1, "no heading\nat all"), (None, "n.pdf", 1, "1. title 1\nof none")]
    df = spark.createDataFrame(rows, files.PAGE).repartition(4)
    got = defaultdict(list)
    raw = sections.sections_of_lines(pages.lines_of(df))
    for x in raw.collect():
        got[x["source"]].append((x["section_no"], x["start"], x["end"], x["section"], x["text"]))
    texts = {s: "\n\n".join(t for ss, _, _, t in rows if ss == s) for s in {s for s, *_ in rows}}
    for s, text in texts.items():
        want = [(i + 1, a, b, name, text[a:b]) for i, (a, b, name) in enumerate(sections_by_hand(text))]
        assert sorted(got[s]) == want, s
    # Tiny sections take their successor in, in pairs.
    pairs = defaultdict(list)
    for x in sections.merged(raw).collect():
        pairs[x["source"]].append((x["section_no"], x["start"], x["end"], x["text"]))
    for s, own in got.items():
        own, want, i = sorted(own), [], 0
        while i < len(own):
            _, a, b, name, text = own[i]
            tiny = name and len(re.findall(r"[A-Za-z0-9]+|\S", text)) <= 8
            if tiny and i + 1 < len(own):
                b, text, i = own[i + 1][2], text + own[i + 1][4], i + 1
            want.append((len(want) + 1, a, b, text))
            i += 1
        assert sorted(pairs[s]) == want, s


def test_one_source_of_very_many_lines(spark):
    """Its lines are worked on by many tasks: no window holds a source but over totals."""
    df = spark.range(300).select(F.lit("big").alias("source"), F.lit("big.pdf").alias("file_path"), (F.col("id") + 1).cast("int").alias("page"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.when(i % 500 == 0, F.concat(F.lit("3. title "), i.cast("string"))).otherwise("line")), "\n").alias("text"))
    lines = pages.lines_of(df)
    placed = running.before(lines, "source", "pos", at=(F.sum, F.length("line") + 1)).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["n"] for r in placed.groupBy("task").agg(F.count("*").alias("n"), F.sum("at")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 300 * 1000 + 299 and max(tasks) < 0.6 * sum(tasks) and len(tasks) == 4
    found = sections.sections_of_lines(lines)
    assert found.count() == 600 and found.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == df.agg(F.sum(F.length("text") + 2)).first()[0] - 2


@pytest.mark.parametrize("values", [[], [4], [1, 9], [3, 3, 8], [1, 2, 2, 100], [None, 5, 7]])
def test_median(spark, values):
    got = inspect.median(inspect.value_counts(spark.createDataFrame([(v,) for v in values], "v int"), "v")).first()["median"]
    known = [v for v in values if v is not None]
    assert got == (statistics.median(known) if known else None)


def test_median_without_a_percentile(spark):
    chunks = spark.createDataFrame([("a", "", 3, ["x"]), ("b", "p", 8, []), (None, None, None, None)], "source string, parent_id string, token_count int, tags array<string>")
    made = inspect.statistics(chunks)
    assert "percentile" not in made._jdf.queryExecution().executedPlan().toString().lower()
    assert made.first().asDict() == {"chunk_count": 3, "source_count": 2, "parent_count": 1, "tag_count": 1, "token_min": 3, "token_max": 8, "token_mean": 5.5, "token_median": 5.5}
    assert inspect.statistics(chunks.where("false")).first()["token_median"] == 0.0


CHUNK = "position int, chunk_id string, source string, section string, title string, tags array<string>, specs struct<ram_gb:double,has_lvds:boolean,os_list:array<string>>, spec_evidence map<string,array<string>>, table_context string, text string"


def facets_by_hand(rows, selected, terms):
    values = []
    for n, (_, cid, source, section, title, tags, specs, evidence, table, text) in enumerate(rows):
        ram, lvds, systems = specs or (None, None, None)
        spec = [f for f, on in (("with_specs", ram is not None or lvds is not None or systems), ("evidence", any(evidence.values()) if evidence else False), ("table", table), ("ram_gb", ram is not None), ("has_lvds", lvds), ("os_list", systems)) if on]
        own = {"source": [source or ""], "section": [section or title or ""], "tag": sorted({t for t in tags or [] if t}), "spec": spec}
        hay = " ".join(map(str, (cid, source, section, title, tags, specs, evidence, text))).lower()
        if all(t in hay for t in terms.lower().split()):
            values.append((n, own))
    out = Counter()
    for facet in ("source", "section", "tag", "spec"):
        for _, own in values:
            if all(v in own[f] for f, v in selected.items() if f != facet):
                out.update((facet, v) for v in own[facet])
    return out


@pytest.mark.parametrize("selected,terms", [({}, ""), ({"source": "a"}, ""), ({"source": "a", "tag": "t1", "spec": "has_lvds"}, ""), ({"tag": "t2", "section": "s1"}, "word3"), ({"source": "nowhere", "tag": "t1"}, "")])
def test_facets(spark, selected, terms):
    r = random.Random(3)
    some = lambda *x: r.choice(x)
    rows = [(i, f"c{i}", some("a", "b", None), some("s1", "", None), some("s1", "t", None), some(None, [], ["t1"], ["t1", "t2", "t1", None]), some(None, (None, False, []), (2.0, True, ["Linux"]), (None, True, None)), some(None, {}, {"ram_gb": ["x"]}, {"ram_gb": []}), some("", "extracted_table", None), f"word{i % 7} <b>") for i in range(80)]
    df = spark.createDataFrame(rows, CHUNK)
    got = {(x["facet"], x["value"]): x["n"] for x in inspect.facet_counts(df, selected, terms).collect()}
    assert got == dict(facets_by_hand(rows, selected, terms))
    whole = inspect.browse(df, **selected, terms=terms).count()
    for facet, value in selected.items():
        assert got.get((facet, value), 0) == whole
    with pytest.raises(ValueError, match="colour"):
        inspect.facet_counts(df, {"colour": "red"})


def test_marks(spark):
    text, terms = "a+b <Tag> & 'Öl' tag ÖL x$y one two", "a+b tag öl $ one two three"
    safe = html.escape(text).replace("&#x27;", "&#39;")
    want = re.sub("(" + "|".join(map(re.escape, terms.split()[:6])) + ")", r"<mark>\1</mark>", safe, flags=re.I)
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [x["h"] for x in df.select(inspect.highlighted(F.col("t"), terms).alias("h")).collect()] == [want, None, ""]
    assert df.select(inspect.highlighted(F.col("t"), " ").alias("h")).first()["h"] == safe


def test_audit_headings(spark, sf_dir):
    """A source's heading stands where it changes, values that are unknown say None."""
    audit = RQ.part_chunks(spark, sf_dir).limit(0)
    assert files.inspection_summary(audit.withColumnRenamed("position", "index"), "now").first()["line"].count("- total_chunks: 0") == 1
    columns = "index long, source string, chunk_id string, page_label string, char_start int, char_end int, char_length int, estimated_tokens int, parent_id string, prev_chunk_id string, next_chunk_id string, section string, product_codes array<string>, chip_models array<string>, vendors array<string>, overlap_with_previous_chars int, gap_from_previous_chars int, notes array<string>, text string"
    row = lambda i, s, text: (i, s, f"c{i}", "1-2", 0, None, 5, 2, "p", "", "n", None, ["A", "B"], [], None, None, 3, [], text)
    df = spark.createDataFrame([row(1, "a", "x" * 30), row(2**33, "a", None), row(2**33 + 5, "b", "y"), row(2**33 + 6, "a", "z")], columns).repartition(3)
    got = [x["markdown"] for x in files.inspection_markdown(df, 20).orderBy("index").collect()]
    assert [g.startswith("\n## ") for g in got] == [True, False, True, True]
    assert got[0] == "\n## a\n\n### 1. c1\n\n- page: 1-2\n- char_range: 0-None\n- chars/tokens: 5 / 2\n- parent_id: p\n- prev/next:  / n\n- section: \n- product_codes: A, B\n- chip_models: \n- vendors: \n- overlap/gap from previous chars: None / 3\n- notes: none\n\n```text\nxxxx\n...[truncated]\n```\n"
