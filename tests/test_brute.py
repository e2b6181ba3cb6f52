"""Queries and operators that SQL can't express, against plain Python written from
their definitions."""

import bisect
import hashlib
import json
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner import cli
from gleaner.functions import specs as S
from gleaner.operators import chunking, pages, planner, products, ranking
from gleaner.plans import fixtures as X
from gleaner.plans import queries as Q
from gleaner.plans import reports
from gleaner.plans import retrieval_queries as RQ
from gleaner.plans import retrieve as R
from gleaner.sources import files

TOKEN = re.compile(r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[一-鿿]|\S")
SEPARATORS = ("\n\n", "\n", "Q:", "A:", "Question:", "Answer:", ". ", "; ", ", ", " ")


def split_by_hand(text, size, overlap):
    """From the definition: among the places where a piece may end, the best kind of
    separator wins, of that kind the last; without any, the piece is full."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    starts = [a for a, _ in spans]

    def stop(first):
        if first + size >= len(spans):
            return len(spans)
        least = max(1, min(size, max(20, int(size * 0.55))))
        low, high = spans[first + least - 1][1], spans[first + size - 1][1]
        last_of_kind = {rank: at + len(s) for rank, s in enumerate(SEPARATORS) for at in range(low, high - len(s) + 1) if text.startswith(s, at)}
        places = (bisect.bisect_left(starts, last_of_kind[rank]) for rank in sorted(last_of_kind))
        return next((i for i in places if i > first), first + size)

    if len(spans) <= size:
        return [(spans[0][0], spans[-1][1])] if spans else []
    pieces = [(0, stop(0))]
    while pieces[-1][1] < len(spans):
        first = max(pieces[-1][1] - overlap, pieces[-1][0] + 1)
        pieces.append((first, stop(first)))
    return [(spans[i][0], spans[j - 1][1]) for i, j in pieces]


def test_chunks_token_split(spark, sf_dir):
    texts = {r["id"]: r["text"] for r in Q.all_texts(spark, sf_dir).collect()}
    got = defaultdict(list)
    for r in Q.chunks_token_split(spark, sf_dir).orderBy("id", "c_no").collect():
        got[r["id"]].append((r["c_start"], r["c_end"], r["digest"]))
    for i, text in texts.items():
        want = [(a, b, hashlib.md5(text[a:b].encode()).hexdigest()) for a, b in split_by_hand(text, 320, 50)]
        assert got[i] == want, i


def test_parent_child_chunks(spark, sf_dir):
    """Parents are the pieces of the sections, children those of the parents; every
    link, page and offset follows from the cleaned documents."""
    rows = [r.asDict() for r in Q.parent_child_chunks(spark, sf_dir).collect()]
    literal = X.texts(spark).select("source", F.concat(F.lit("docs/"), "source").alias("file_path"), F.lit(1).alias("page"), "text").where("text <> ''")
    clean = Q.clean_pages(spark, sf_dir).select("source", "file_path", "page", "text").unionByName(literal)
    text_of, spans_of = {}, defaultdict(list)
    by_source = defaultdict(list)
    for r in clean.collect():
        by_source[r["source"]].append((r["page"], r["text"]))
    for source, own in by_source.items():
        at = 0
        for page, text in sorted(own):
            spans_of[source].append((at, at + len(text), page))
            at += len(text) + 2
        text_of[source] = "\n\n".join(t for _, t in sorted(own))
    chunks = defaultdict(list)
    for r in rows:
        chunks[r["source"]].append(r)
    assert set(chunks) == {s for s, t in text_of.items() if t}
    for source, own in chunks.items():
        own.sort(key=lambda r: r["chunk_index"])
        whole = text_of[source]
        assert [r["chunk_index"] for r in own] == list(range(1, len(own) + 1))
        assert [r["prev_chunk_id"] for r in own] == [""] + [r["chunk_id"] for r in own[:-1]]
        assert [r["next_chunk_id"] for r in own] == [r["chunk_id"] for r in own[1:]] + [""]
        parents = defaultdict(list)
        for r in own:
            if not r.get("question"):
                assert whole[r["char_start"] : r["char_end"]] == r["text"]
                parents[r["parent_id"], r["parent_char_start"], r["parent_char_end"]].append(r)
            hit = [p for a, b, p in spans_of[source] if a < r["char_end"] and b > r["char_start"]]
            assert (r["start_page"], r["end_page"]) == (hit[0], hit[-1])
        for (_, a, b), kids in parents.items():
            assert whole[a:b] == kids[0]["parent_text"] and len(TOKEN.findall(whole[a:b])) <= 850
            assert [(k["char_start"] - a, k["char_end"] - a) for k in kids] == split_by_hand(whole[a:b], 320, 50)


def window_by_hand(text, start, end, most):
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= most:
        return text.strip()
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    inside = [i for i, (a, b) in enumerate(spans) if b > start and a < end] or [min(sum(b <= start for _, b in spans), len(spans) - 1)]
    low, high = inside[0], inside[-1] + 1
    room = max(most - (high - low), 0)
    low, high = low - room // 2, high + room - room // 2
    if low < 0 or high > len(spans):
        lack = max(most, inside[-1] + 1 - inside[0]) - (min(high, len(spans)) - max(low, 0))
        low, high = max(max(low, 0) - lack, 0), min(min(high, len(spans)) + lack, len(spans))
    body = text[spans[low][0] : spans[high - 1][1]]
    return ("[...]\n" if low else "") + body + ("\n[...]" if high < len(spans) else "")


def test_token_windows(spark, sf_dir):
    texts = {r["id"]: r["text"] for r in RQ.searched(spark, sf_dir).collect()}
    got = {r["id"]: r["digest"] for r in RQ.token_windows(spark, sf_dir).collect()}
    assert got == {i: hashlib.md5(window_by_hand(t, len(t) // 3, len(t) // 2, 120).encode()).hexdigest() for i, t in texts.items()}


def test_adjacent_expand(spark, sf_dir):
    """A walk from each hit in order of rank, that stops at what came before."""
    ids = defaultdict(list)
    for r in Q.strides(spark, sf_dir).orderBy("source", "position").collect():
        ids[r["source"]].append(r["chunk_id"])
    place = {c: (s, i) for s, own in ids.items() for i, c in enumerate(own)}
    hits = defaultdict(list)
    for r in RQ.adjacent_hits(spark, sf_dir).orderBy("query_id", "final_rank").collect():
        hits[r["query_id"]].append((r["id"], r["rerank_score"]))
    want = set()
    for q, own in hits.items():
        seen, out = set(), []
        for hit, score in own:
            s, at = place[hit]
            if hit not in seen:
                seen.add(hit)
                out.append((hit, score, False, None))
            back, ahead = [], []
            for side, steps in ((back, range(at - 1, at - 3, -1)), (ahead, range(at + 1, at + 3))):
                for i in steps:
                    if not 0 <= i < len(ids[s]) or ids[s][i] in seen:
                        break
                    side.append(ids[s][i])
                    seen.add(ids[s][i])
            out += [(x, score - 0.001, True, hit) for x in back[::-1] + ahead]
        want |= {(q, n, i, round(x, 6), adj, to) for n, (i, x, adj, to) in enumerate(out, 1)}
    got = {(r["query_id"], r["ord"], r["id"], round(r["rerank_score"], 6), r["is_adjacent"], r["adjacent_to"]) for r in RQ.adjacent_expand(spark, sf_dir).collect()}
    assert got == want and want


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return RQ._retrieved(spark, sf_dir)


def test_retrieve_final(spark, found):
    """Contexts are the parents of the chosen chunks and their neighbours, in order."""
    _, chunks, stages = found
    known = {r["id"]: r for r in chunks.collect()}
    by_stage = {s: defaultdict(list) for s in stages}
    for s, rows in stages.items():
        rank = "rank" if s == "final" else f"{s}_rank"
        for r in rows.orderBy("query_id", rank).collect():
            by_stage[s][r["query_id"]].append(r)
    assert set(by_stage["final"]) == set(by_stage["dense"]) == {q for q, _ in X.QUESTIONS}
    for q, contexts in by_stage["final"].items():
        ranked = by_stage["rerank"][q]
        scores = [r["rerank_score"] for r in ranked]
        assert scores == sorted(scores, reverse=True) and {r["id"] for r in ranked} == {r["id"] for r in by_stage["hybrid"][q]}
        assert {r["id"] for r in by_stage["hybrid"][q] if not r[ranking.MATCH]} <= {r["id"] for r in by_stage["dense"][q]} | set(known)
        assert len({c["context_id"] for c in contexts}) == len(contexts)
        first = known[contexts[0]["matched_child_ids"][0]]
        for c in contexts:
            kids = [known[i] for i in c["matched_child_ids"]]
            assert all((k["parent_id"] or k["id"]) == c["context_id"] for k in kids)
            assert [k["char_start"] for k in kids] == sorted(k["char_start"] for k in kids)
            assert c["child_text"] == "\n\n".join(k["text"] for k in kids if k["text"])
            body = kids[0]["parent_text"]
            want = window_by_hand(body, min(k["char_start"] for k in kids) - kids[0]["parent_char_start"], max(k["char_end"] for k in kids) - kids[0]["parent_char_start"], 700) if body else c["child_text"]
            assert c["text"] == want
        assert first is not None


def test_retrieve_structured_and_answers(spark, found):
    questions, chunks, stages = found
    asked = questions.select("query_id", "question")
    filtered = R.structured_filter(asked, chunks, stages)
    table = {r["key"]: r for r in filtered.products.collect()}
    plans = defaultdict(list)
    for r in filtered.conditions.collect():
        plans[r["query_id"]].append(r)

    def meets(p, c):
        if c["field"] == "vendor" or c["op"] == "contains":
            values = p["vendors"] if c["field"] == "vendor" else p["specs"][c["field"]]
            return any(c["str_value"].lower().replace(" ", "") in v.lower().replace(" ", "") for v in values)
        v = p["specs"][c["field"]]
        if v is None:
            return False
        if c["bool_value"] is not None:
            return v == c["bool_value"]
        return {">=": v >= c["num_value"], ">": v > c["num_value"], "<=": v <= c["num_value"], "<": v < c["num_value"], "==": v == c["num_value"]}[c["op"]]

    got = defaultdict(list)
    for r in filtered.ranked.orderBy("query_id", "place").collect():
        got[r["query_id"]].append(r["key"])
    assert {q: set(v) for q, v in got.items()} == {q: s for q, cs in plans.items() if (s := {k for k, p in table.items() if all(meets(p, c) for c in cs)})}
    prompts = {r["query_id"]: r for r in R.answer_prompts(asked, stages["final"], filtered).collect()}
    contexts = {q: [] for q, _ in X.QUESTIONS}
    for r in stages["final"].orderBy("rank").collect():
        contexts[r["query_id"]].append(r["text"])
    for q, question in X.QUESTIONS:
        p = prompts[q]
        assert p["is_structured"] == (q in plans) and question in p["prompt"]
        assert ("Structured query plan:" in p["prompt"]) == (q in plans)
        assert all((t in p["prompt"]) == (q not in plans) for t in contexts[q] if len(t) > 40)
    plain = {r["query_id"]: r for r in R.answer_prompts(asked, stages["final"]).collect()}
    assert not any(r["is_structured"] for r in plain.values())


def test_inspection_report(spark, sf_dir):
    rows = [r["markdown"] for r in RQ.inspection_report(spark, sf_dir).collect()]
    chunks = Q.own_chunks(spark, sf_dir).collect()
    assert len(rows) == len(chunks)
    by_id = {re.search(r"^### \d+\. (.*)$", m, re.M)[1]: m for m in rows}
    assert set(by_id) == {c["chunk_id"] for c in chunks}
    assert {m.split("\n")[1] for m in rows if m.startswith("\n## ")} == {f"## {c['source']}" for c in chunks}
    for c in chunks:
        m = by_id[c["chunk_id"]]
        assert f"- chars/tokens: {len(c['text'])} / {len(TOKEN.findall(c['text']))}\n" in m
        body = m.split("```text\n", 1)[1].rsplit("\n```", 1)[0]
        assert body == c["text"] if len(c["text"]) <= 400 else body.startswith(c["text"][:300]) and body.endswith("[truncated]")


# -- specifications -----------------------------------------------------------------


def specs_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.extract("t").alias("x")).orderBy("i").collect()
    return [(r["x"]["specs"].asDict(), r["x"]["spec_evidence"]) for r in rows]


UNITS = {"x", "個", "組", "路", "port", "ports"}


def scanned(line, names):
    """(number, where the mention starts, where its number stands if that comes first):
    a scanner over words, numbers and marks."""
    found = [(m.group(), m.start()) for m in re.finditer(r"[A-Za-z][A-Za-z0-9]*|[0-9]+|\S", line)]
    word = lambda i: found[i][0] if i < len(found) else ""
    for i, (token, at) in enumerate(found):
        if token.isdigit():
            ahead = i + 2 if word(i + 1).lower() in UNITS else i + 1
            if word(ahead).upper() in names:
                yield int(token), at, at
        elif token.upper() in names:
            j = i + 1
            if token.upper() == "USB" and len(word(j)) == 1 and word(j).isdigit():  # its version
                j += 3 if word(j + 1) == "." and word(j + 2).isdigit() else 1
            j += word(j).lower() in {"port", "ports"}
            if word(j) in {":", "="} and word(j + 1).isdigit():
                yield int(word(j + 1)), at, None


def counts_by_hand(text, names, skip):
    """The sum over a text's mentions, those of one number and wording once.  A mention
    reaches to the next number before a name, and is worded by what is before a colon."""
    once = set()
    for line in text.split("\n"):
        if skip and "pcie" in line.lower():
            continue
        found = list(scanned(line, names))
        for n, at, _ in found:
            later = [x for _, _, x in found if x is not None and x > at and line[x - 1].isspace()]
            wording = line[at : min(later, default=len(line))].partition(":")[0]
            once.add((n, " ".join(wording.lower().split())))
    return sum(n for n, _ in once) or None


def test_interface_counts(spark):
    r = random.Random(3)
    piece = lambda: r.choice(["{} x UART", "{}x UART", "UART: {}", "UART ports = {}", "{} UART, {} x I2C", "I2C {}", "IIC: {}", "{} ports SPI", "Mini-PCIe {} x UART", "USB 2.0: {}", "{} x USB 3.0", "{} CAN and {} x CAN FD", "nothing {}"]).replace("{}", str(r.randint(0, 9)))
    texts = ["\n".join(" ".join(piece() for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 5))) for _ in range(200)]
    for text, (specs, proofs) in zip(texts, specs_of(spark, texts), strict=True):
        for field, names in (("uart_count", ("UART",)), ("i2c_count", ("I2C", "IIC")), ("spi_count", ("SPI",)), ("can_count", ("FDCAN", "CAN")), ("usb_count", ("USB",))):
            assert specs[field] == counts_by_hand(text, names, field != "usb_count"), (field, text)
            assert (specs[field] is None) or proofs[field]


def test_specs_of_a_sheet(spark):
    (one, proof), (two, _), (none, empty), (odd, _) = specs_of(spark, [X.SHEET, X.SHEET + "\n\n" + X.SHEET, None, "512MB RAM\n2 x UART Mini-PCIe\nEthernet 10/100"])
    assert one == two
    assert (one["uart_count"], one["i2c_count"], one["usb_count"], one["spi_count"], one["ethernet_count"]) == (3, 2, 1, None, None)
    assert (one["ram_gb"], one["flash_gb"], one["cpu_soc"], one["power_input"], one["has_lvds"], one["has_mipi_csi"]) == (2.0, 16.0, ["i.MX8M Mini"], ["DC 12V"], True, None)
    assert proof["ram_gb"] == ["RAM: 2GB LPDDR4"] and proof["uart_count"] == ["3 x UART"] and proof["cpu_soc"] == ["CPU: NXP i.MX8M Mini"]
    assert none["os_list"] == [] and empty == {}
    assert (odd["ram_gb"], odd["ethernet_count"], odd["uart_count"]) == (0.5, 1, None)


def test_evidence_lines(spark):
    cases = {"Row 3: Column 1 : a   b": "a b", ": x :": "x", "y" * 200: "y" * 177 + "...", "2×：m²": "2x:m2"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.clean_evidence(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in rows} == cases


# -- pages, filters, streams, command lines ------------------------------------------


def test_aligned():
    assert chunking.aligned("ab cd", 2) == 2 and chunking.aligned("ab cd", 3) == 3 and chunking.aligned("ab cd", 4) == 3
    assert chunking.aligned("abcd ef", 2) == 5 and chunking.aligned("abcd", 2) == 2 and chunking.aligned("ab", 9) == 2 and chunking.aligned("ab", -1) == 0
    assert chunking.aligned("a " + "b" * 60 + " c", 50) == 63 or chunking.aligned("a " + "b" * 60 + " c", 50) == 50


def test_pages_of_spans(spark, monkeypatch):
    monkeypatch.setattr(pages, "STRETCH", 7)
    r = random.Random(2)
    spans_of = {}
    for source in ("a", None):
        at, own = 0, []
        for page in range(1, 12):
            n = r.choice([0, 3, 20, 55])
            own.append((source, page, at, at + n))
            at += n + 2
        spans_of[source] = own
    spans = [(s, a, a + r.choice([0, 1, 2, 9, 60])) for s in spans_of for a in range(0, 200, 3)]
    spans += spans[:5]
    rows = pages.pages_of_spans(spark.createDataFrame(spans, "source string, char_start int, char_end int"), spark.createDataFrame([x for own in spans_of.values() for x in own], "source string, page int, start int, end int"))
    want = []
    for s, a, b in spans:
        hit = [p for _, p, x, y in spans_of[s] if x < b and y > a] or [min(spans_of[s], key=lambda x: abs(x[2] - a))[1]]
        want.append((s, a, b, hit[0], hit[-1]))
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


def test_pages_without_a_source_stay(spark):
    rows = spark.createDataFrame([(None, "f", 1, "one\ntwo\nthe body\nfour\nfive"), (None, "f", 2, "one\ntwo\nmore\nfour\nfive")], files.PAGE)
    assert sorted(r["text"] for r in files.clean_pages(rows).collect()) == ["more", "the body"]


def test_structured_filter_by_hand(spark):
    r = random.Random(5)
    specs = [(i, r.choice([None, r.randint(1, 4)]), r.choice([None, 0.5, 2.0]), r.choice([None, True, False]), r.sample(["A 1", "b", "Linux"], r.randint(0, 2)), r.sample(["NXP", "ST"], r.randint(0, 2))) for i in range(40)]
    full = ", ".join(f"{f}:{'double' if f.endswith('_gb') else 'int'}" for f in ("uart_count", "i2c_count", "spi_count", "can_count", "usb_count", "ethernet_count", "ram_gb", "flash_gb")) + ", has_lvds:boolean, has_mipi_dsi:boolean, has_mipi_csi:boolean, cpu_soc:array<string>, os_list:array<string>, power_input:array<string>"
    rows = spark.createDataFrame([(str(i), v, (u, None, None, None, None, None, g, None, b, None, None, [], o, [])) for i, u, g, b, o, v in specs], f"key string, vendors array<string>, specs struct<{full}>")
    asked = []
    for q in range(60):
        for n in range(r.randint(0, 3)):
            kind = r.randint(0, 3)
            asked.append((q, n, *[("uart_count", r.choice([">=", ">", "<", "<=", "=="]), float(r.randint(1, 4)), None, None), ("ram_gb", r.choice([">=", "<"]), 1.0, None, None), ("has_lvds", "==", None, r.choice([True, False]), None), ("vendor" if r.random() < 0.5 else "os_list", "contains", None, None, r.choice(["st", "a1", "lin"]))][kind], ""))
    conditions = spark.createDataFrame(asked, "query_id int, ord int, field string, op string, num_value double, bool_value boolean, str_value string, text string")
    want = set()
    for q in {a[0] for a in asked}:
        for i, u, g, b, o, v in specs:
            def holds(c, u=u, g=g, b=b, o=o, v=v):
                _, _, field, op, n, flag, text, _ = c
                x = {"uart_count": u, "ram_gb": g, "has_lvds": b, "vendor": v, "os_list": o}[field]
                if op == "contains":
                    return any(text in y.lower().replace(" ", "") for y in x)
                if x is None:
                    return False
                return x == flag if field == "has_lvds" else {">=": x >= n, ">": x > n, "<": x < n, "<=": x <= n, "==": x == n}[op]
            if all(holds(c) for c in asked if c[0] == q):
                want.add((q, str(i)))
    made = planner.structured_filter(rows, conditions)
    assert {(x["query_id"], x["key"]) for x in made.collect()} == want
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in made._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_in_injection(spark, sf_dir):
    plan = ranking.inject(RQ.candidates(spark, sf_dir), RQ.part_chunks(spark, sf_dir), ranking.intents(RQ.nation_questions(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_keeps_earlier_pages(spark, tmp_path):
    from gleaner.streaming.ingest import chunk_stream, page_stream

    text = lambda s: f"head one\nhead two\n{s}\nfoot one\nfoot two"
    batches = [[("a.pdf", "a.pdf", 1, text("first body"))], [("a.pdf", "a.pdf", 2, text("second body")), ("b.pdf", "b.pdf", 1, text("another"))], [("a.pdf", "a.pdf", 1, text("first body anew"))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, files.PAGE).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        chunk_stream(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    got = {r["source"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.pdf": "first body anew\n\nsecond body", "b.pdf": "another"}


def test_command_lines(spark, sf_dir, tmp_path, capsys):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files.write_jsonl(R.pages_from_documents(docs).unionByName(X.texts(spark).select("source", F.col("source").alias("file_path"), F.lit(1).alias("page"), "text")), str(tmp_path / "pages"))
    at = lambda n: str(tmp_path / n)
    run = lambda *argv: cli.run(cli.parser().parse_args(argv), spark)
    run("chunk", "--pages", at("pages"), "--out", at("chunks"))
    run("embed", "--chunks", at("chunks"), "--out", at("vectors"))
    run("index", "--chunks", at("chunks"), "--vectors", at("vectors"), "--out", at("flat"))
    assert spark.read.parquet(at("flat")).count() == spark.read.parquet(at("chunks")).count() > 0
    capsys.readouterr()
    run("ask", "Which NXP products support LVDS", "--chunks", at("chunks"), "--vectors", at("vectors"), "--debug-retrieval", "--debug-dir", at("debug"))
    said = capsys.readouterr().out
    assert "- has_lvds == True" in said and "Structured query plan:" in said
    trace = json.loads(spark.read.text(at("debug/retrieval_latest")).first()[0])
    assert list(trace) == ["schema_version", "generated_at", "question", "args", "stages", "structured_filter"] and set(trace["stages"]) == set(reports.STAGES) and trace["stages"]["final"]
    with (tmp_path / "set.jsonl").open("w") as f:
        f.write(json.dumps({"query": "UART I2C USB Yocto Linux", "targets": [{"text_contains": "os: yocto linux"}]}) + "\n" + json.dumps({"query": "no such thing", "targets": [{"source": "nowhere.pdf"}]}) + "\n")
    run("evaluate", "--dataset", at("set.jsonl"), "--chunks", at("chunks"), "--vectors", at("vectors"), "--output", at("report"))
    report = json.loads("".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*"))))
    assert set(report) == {"summary", "queries"} and len(report["queries"]) == 2 and set(report["summary"]) == {*reports.STAGES, "improvement_vs_dense"}
    assert report["queries"][0]["stages"]["rerank"]["first_relevant_rank"] and report["queries"][1]["stages"]["final"]["first_relevant_rank"] is None
    run("inspect", "--chunks", at("chunks"), "--out", at("audit"), "--limit", "3")
    audit = "".join(f.read_text() for f in sorted((tmp_path / "audit").glob("part-*")))
    assert audit.startswith("# Chunk Inspection\n\n- generated_at: ") and "- total_chunks: 3\n" in audit and audit.count("### ") == 3 and audit.index("## Source Summary") < audit.index("\n## ", audit.index("## Source Summary") + 5)
    run("preview", "--chunks", at("chunks"), "--out", at("preview"), "--source", "board.pdf")
    assert spark.read.text(at("preview")).count() == spark.read.parquet(at("chunks")).where("source = 'board.pdf'").count()
    asked = iter(["", "how thick is the board", "q"])
    args = cli.parser().parse_args(["ask", "--chunks", at("chunks"), "--vectors", at("vectors"), "--no-print-results"])
    capsys.readouterr()
    cli.interactive(spark, args, lambda _: next(asked))
    assert "Question: how thick is the board" in capsys.readouterr().out


def test_capacity_lines(spark):
    conditions = spark.createDataFrame([(1, 1, "ram_gb", ">=", 4.0, None, None, ""), (1, 2, "uart_count", ">=", 2.0, None, None, "")], RQ.conditions(spark).schema)
    none = spark.createDataFrame([], "query_id int, place int, key string, label string, first_rank int")
    table = RQ.spec_chunks(spark, "/root/testdata/sf0.001").limit(1).withColumn("product_codes", F.array().cast("array<string>")).drop("product_codes_")
    context = products.structured_context(none, products.rollup(table), conditions).first()["context"]
    assert context.splitlines()[1:3] == ["- ram_gb >= 4.0", "- uart_count >= 2"] and math.isclose(1, 1)
