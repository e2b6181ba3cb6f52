"""The maintained lexical index against one built anew, and the jobs that use it."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexindex, retrieval
from jobs import lexical_index, retrieval_report, settings

SCHEMA = "id long, text string, gone boolean"
WORDS = "alpha beta gamma delta RK3568 uart i2c 串口支援 linux yocto power".split()


def doc(i, version=0):
    return " ".join(WORDS[(i * 7 + k * (k + version)) % len(WORDS)] for k in range(3 + (i + version) % 9))


def rows(df):
    return sorted(map(tuple, df.select("part", "block", "token", "id", "tf", "length").collect()))


def bounds(df):
    return sorted(map(tuple, df.select("part", "block", "token", "df", "max_tf", "min_length", "total_length").collect()))


def frame(spark, changes):
    return spark.createDataFrame([(i, t, g) for i, t, g in changes], SCHEMA).repartition(3)


def test_index_equals_a_rebuild(spark, tmp_path):
    """After inserts, new versions and deletions, a part emptied among them."""
    texts, root = {}, str(tmp_path / "index")
    steps = [
        [(i, doc(i), False) for i in range(60)],
        [(i, doc(i, 1), False) for i in range(50, 90)] + [(3, None, False), (4, "", None)],
        [(i, None, True) for i in (*range(20, 40), 85, 5000)] + [(i, doc(i), False) for i in range(100, 110)],
        [(7, "x", True), (7, "later", False), (7, "earlier", False), (None, "no id", False)],
    ]
    for step in steps:
        for i, t, gone in sorted(step, key=lambda x: (not x[2], x[1] or "") if x[0] is not None else (False, "")):
            if i is not None and gone:
                texts.pop(i, None)
            elif i is not None:
                texts[i] = t
        lexindex.update(spark, root, frame(spark, step), part_ids=20, block_ids=5)
        again = str(tmp_path / f"again-{len(texts)}")
        lexindex.update(spark, again, frame(spark, [(i, t, False) for i, t in texts.items()]), part_ids=20, block_ids=5)
        assert rows(lexindex.postings(spark, root)) == rows(lexindex.postings(spark, again))
        assert bounds(lexindex.blocks(spark, root)) == bounds(lexindex.blocks(spark, again))
    assert {r["id"] for r in lexindex.postings(spark, root).collect()} == set(texts)


def test_repeated_update_changes_nothing(spark, tmp_path):
    """As after a failure between the two tables: blocks are lost, the update is repeated."""
    root = str(tmp_path / "index")
    change = frame(spark, [(i, doc(i), False) for i in range(30)])
    assert lexindex.update(spark, root, change, 10, 5) | {"postings": 0} == {"documents": 30, "deleted": 0, "parts": 3, "postings": 0}
    was = rows(lexindex.postings(spark, root)), bounds(lexindex.blocks(spark, root))
    shutil.rmtree(f"{root}/blocks")
    lexindex.update(spark, root, change, 10, 5)
    assert (rows(lexindex.postings(spark, root)), bounds(lexindex.blocks(spark, root))) == was
    assert lexindex.update(spark, root, frame(spark, []), 10, 5)["parts"] == 0
    assert lexindex.update(spark, root, frame(spark, [(99, None, True)]), 10, 5)["parts"] == 0


def test_scattered_ids_are_refused(spark, tmp_path, monkeypatch):
    """Before anything is written."""
    monkeypatch.setattr(lexindex, "MAX_PARTS", 3)
    with pytest.raises(ValueError, match="too scattered"):
        lexindex.update(spark, str(tmp_path / "index"), frame(spark, [(i, doc(i), False) for i in range(40)]), 10, 5)
    assert lexindex.postings(spark, str(tmp_path / "index")).isEmpty()


def test_untouched_parts_are_not_written(spark, tmp_path):
    root = str(tmp_path / "index")
    lexindex.update(spark, root, frame(spark, [(i, doc(i), False) for i in range(40)]), 10, 5)
    files = lambda: {str(f) for f in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    counts = lexindex.update(spark, root, frame(spark, [(12, "new text", False), (41, "more", False)]), 10, 5)
    gone, made = before - files(), files() - before
    assert counts["parts"] == 2 and gone and all("part=1/" in f for f in gone) and all("part=1/" in f or "part=4/" in f for f in made)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_skips_blocks_and_loses_nothing(spark, tmp_path, k):
    """Exact, though blocks that can't hold one of the best are skipped."""
    root = str(tmp_path / "index")
    texts = {i: ("rare word " * 3 if i % 97 == 5 else "") + doc(i) + (" filler" * (i % 40)) for i in range(600)}
    for part in range(3):
        lexindex.update(spark, root, frame(spark, [(i, t, False) for i, t in texts.items() if i % 3 == part]), 200, 10)
    asked = spark.createDataFrame([(1, "rare word"), (2, "alpha beta uart"), (3, "nothing such"), (4, "rare rare alpha"), (5, None)], "query_id long, question string")
    best, seen = lexindex.search(spark, root, asked, k)
    plain = retrieval.lexical(asked, spark.createDataFrame(list(texts.items()), "id long, text string"), k)
    columns = ["query_id", "id", "lexical_score", "lexical_rank"]
    assert sorted(map(tuple, best.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    counts = {r["query_id"]: (r["n_blocks"], r["n_scored"]) for r in seen.collect()}
    assert set(counts) == {1, 2, 4} and counts[1][0] <= 7 and counts[4][0] == 60
    if k == 3:
        assert counts[4][1] < 15
    empty, none = lexindex.search(spark, str(tmp_path / "no index"), asked, k)
    assert empty.collect() == [] and none.collect() == []


# jobs


def copy(spark, df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("deleted", F.lit(False))


def test_index_job_over_growing_input(spark, sf_dir, documents, tmp_path):
    """Two runs take what is new each; the result is that of one run over everything; a
    run without news writes nothing."""
    folder, out, mark = (str(tmp_path / x) for x in ("documents", "out", "checkpoint"))
    setting = lexical_index.Settings(deleted_column="deleted", part_ids=50, block_ids=10, files_a_batch=2)
    for i in range(3):
        copy(spark, documents.where(F.col("doc_id") % 4 == i), folder)
    first = lexical_index.run(spark, folder, out, mark, setting)
    assert first["batches"] == 2 and first["documents"] == documents.where("doc_id % 4 < 3").count()
    new = documents.where("doc_id % 4 = 3")
    changed = documents.where("doc_id in (1, 2)").withColumn("text", F.lit("a new version"))
    gone = documents.where("doc_id in (4, 5)").withColumn("deleted", F.lit(True))
    for df in (new, changed.unionByName(gone)):
        copy(spark, df, folder)
    second = lexical_index.run(spark, folder, out, mark, setting)
    assert (second["documents"], second["deleted"]) == (new.count() + changed.count(), 2)
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    assert lexical_index.run(spark, folder, out, mark, setting)["batches"] == 0
    assert files == {str(f): f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    whole = documents.where("doc_id not in (4, 5)").withColumn("text", F.when(F.col("doc_id").isin(1, 2), "a new version").otherwise(F.col("text")))
    again = str(tmp_path / "again")
    copy(spark, whole, str(tmp_path / "whole"))
    lexical_index.run(spark, str(tmp_path / "whole"), again, str(tmp_path / "mark"), setting)
    assert rows(lexindex.postings(spark, out)) == rows(lexindex.postings(spark, again))
    assert bounds(lexindex.blocks(spark, out)) == bounds(lexindex.blocks(spark, again))


def test_index_job_goes_on_after_a_failure(spark, documents, tmp_path, monkeypatch):
    """A batch that fails after writing postings is taken again by the next run."""
    folder, out, mark = (str(tmp_path / x) for x in ("documents", "out", "checkpoint"))
    copy(spark, documents, folder)
    write, calls = lexindex._write, []

    def fails(made, path, mode):
        calls.append(path)
        if path.endswith("blocks"):
            raise RuntimeError("lost")
        write(made, path, mode)

    monkeypatch.setattr(lexindex, "_write", fails)
    with pytest.raises(Exception, match="lost"):
        lexical_index.run(spark, folder, out, mark)
    monkeypatch.setattr(lexindex, "_write", write)
    assert len(calls) == 2 and lexical_index.run(spark, folder, out, mark)["documents"] == documents.count()
    lexical_index.run(spark, folder, str(tmp_path / "again"), str(tmp_path / "mark"))
    assert rows(lexindex.postings(spark, out)) == rows(lexindex.postings(spark, str(tmp_path / "again")))
    assert bounds(lexindex.blocks(spark, out)) == bounds(lexindex.blocks(spark, str(tmp_path / "again")))


def report_by_hand(found, questions, texts):
    """(stage, query_id) -> first relevant rank."""
    first = {}
    for r in found:
        q, text = questions[r["query_id"]], texts.get(r["id"])
        good = bool(q) and text is not None and q.lower() in text.lower()
        assert r["relevant"] == good
        key = (r["stage"], r["query_id"])
        first[key] = min(first.get(key, 10**9), r["rank"]) if good else first.get(key, 10**9)
    return first


def test_report_job(spark, sf_dir, tmp_path):
    """Against plain Python, over a small corpus with gaps; a rerun leaves the same, and
    stages of others' partitions stay."""
    texts = {1: "The Quick brown fox", 2: "quick", 3: None, 4: "lazy dog of the fox", 5: ""}
    questions = {1: "quick BROWN", 2: "fox", 3: None, 4: "absent", 7: ""}
    tables = {
        "documents": spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
        "questions": spark.createDataFrame([*questions.items(), (None, "no id")], "item_id long, text string"),
        "vectors": spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (4, [0.0, 1.0]), (9, None)], "vec_id long, embedding array<float>"),
    }
    paths = {name: str(tmp_path / name) for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    index, out = str(tmp_path / "index"), str(tmp_path / "out")
    lexical_index.run(spark, paths["documents"], index, str(tmp_path / "mark"))
    given = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    done = retrieval_report.run(spark, paths["questions"], paths["documents"], paths["vectors"], index, out)
    assert done["questions"] == 5 and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == given
    spark.range(1).selectExpr("id as query_id", "'other' as stage").write.mode("append").partitionBy("stage").parquet(f"{out}/metrics")
    everything = lambda: sorted(str(r) for r in retrieval_report.whole(spark, out).collect())
    was = everything()
    retrieval_report.run(spark, paths["questions"], paths["documents"], paths["vectors"], index, out)
    assert everything() == was
    found = spark.read.parquet(f"{out}/results").collect()
    first = report_by_hand(found, questions, texts)
    assert {r["stage"] for r in found} == {"dense", "lexical", "hybrid"} and any(v < 10**9 for v in first.values())
    for r in spark.read.parquet(f"{out}/metrics").where("stage <> 'other'").collect():
        best = first.get((r["stage"], r["query_id"]), 10**9)
        assert r["first_rank"] == (best if best < 10**9 else None) and r["hit_3"] == (best <= 3) and r["mrr"] == pytest.approx(1 / best, abs=1e-8)
    summary = {r["stage"]: r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert set(summary) == {"dense", "lexical", "hybrid"} and all(r["queries"] == 5 for r in summary.values())


def test_reports_of_nothing(spark, tmp_path):
    """Empty tables and no index at all give empty results and zero rates."""
    kinds = {"documents": "doc_id long, text string", "questions": "item_id long, text string", "vectors": "vec_id long, embedding array<float>"}
    for name, schema in kinds.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    lexical_index.run(spark, str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "mark"))
    done = retrieval_report.run(spark, *(str(tmp_path / n) for n in ("questions", "documents", "vectors", "index", "out")))
    assert done == {"questions": 0, "results": 0, "metrics": 0, "summary": 0}
    assert retrieval_report.whole(spark, str(tmp_path / "out")).collect() == []


def test_command_lines_of_the_jobs(spark, documents, tmp_path, monkeypatch):
    """Arguments and the config files that are shipped; only main() makes a session."""
    path = str(tmp_path / "documents")
    copy(spark, documents, path)
    stopped = []
    for job in (lexical_index, retrieval_report):
        monkeypatch.setattr(job, "session", lambda name: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: stopped.append(1))
    here = lexical_index.__file__.rsplit("/", 1)[0]
    lexical_index.main(["--documents", path, "--out", str(tmp_path / "index"), "--checkpoint", str(tmp_path / "mark"), "--config", f"{here}/lexical_index.json"])
    sf = "/root/testdata/sf0.001"
    retrieval_report.main(["--questions", f"{sf}/benchmark.parquet", "--documents", path, "--vectors", f"{sf}/embeddings.parquet", "--index", str(tmp_path / "index"), "--out", str(tmp_path / "out"), "--config", f"{here}/retrieval_report.json"])
    assert len(stopped) == 2 and spark.read.parquet(str(tmp_path / "out/summary")).count() == 3
    (tmp_path / "wrong.json").write_text(json.dumps({"widht": 3}))
    with pytest.raises(ValueError, match="widht"):
        settings.read_settings(spark, str(tmp_path / "wrong.json"), retrieval_report.Settings)
