"""Pages that arrive out of order, twice, late or never."""

from gleaner.streaming import assembly

ROWS = "source string, file_path string, page int, text string, n_pages int, seen string"


def page(source, n, text, of, minute):
    return source, f"{source}.path", n, text, of, f"2024-01-01T00:{minute:02d}:00Z"


def test_documents_go_on_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run(rows):
        """What one run gives out: (source, page, text, state)."""
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(folder)
        before = spark.read.schema(assembly.OUT).parquet(out).collect() if (tmp_path / "out").exists() else []
        with assembly.rocks(spark):
            stream = assembly.assembled(spark.readStream.schema(assembly.PAGE).json(folder), "10 minutes")
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        assert query.awaitTermination(240) and query.exception() is None
        was = sorted((r["source"], r["page"], r["text"], r["state"]) for r in before)
        now = sorted((r["source"], r["page"], r["text"], r["state"]) for r in spark.read.parquet(out).collect())
        assert all(x in now for x in was)
        return [x for x in now if x not in was]

    # Two of three pages in the wrong order, one of them twice; another document whole.
    assert run([page("a", 3, "a3", 3, 1), page("a", 1, "a1 draft", 3, 1), page("b", 1, "b1", 2, 1), page("b", 2, "b2", None, 1), page("a", 1, "a1", 3, 2), (None, "x", 1, "no source", 1, "2024-01-01T00:01:00Z")]) == [("b", 1, "b1", "complete"), ("b", 2, "b2", "complete")]
    # The last page completes a; c will never be whole; b says one page again and one anew.
    assert run([page("a", 2, None, 3, 3), page("c", 2, "c2", 9, 3), page("b", 1, "b1", 2, 3), page("b", 2, "b2 anew", 2, 3)]) == [("a", 1, "a1", "complete"), ("a", 2, "", "complete"), ("a", 3, "a3", "complete"), ("b", 2, "b2 anew", "late")]
    # Time passes: c goes on as it is, and its other page is late.
    assert run([page("d", 1, "d1", 5, 30)]) in ([], [("c", 2, "c2", "partial")])
    run([page("d", 2, "d2", 5, 31), page("c", 1, "c1", 9, 31)])
    assert {("c", 2, "c2", "partial"), ("c", 1, "c1", "late")} <= {(r["source"], r["page"], r["text"], r["state"]) for r in spark.read.parquet(out).collect()}


def test_chunks_are_added_by_batch(spark, tmp_path):
    """A second run adds a document and doesn't write the first one's files again."""
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    text = lambda s: f"head of all\nline two\n{s}\nfoot one\nfoot two"
    given, kept = spark.conf.get(assembly._PROVIDER), {}
    for n, rows in enumerate([[page("a", 2, text("second body"), 2, 1), page("a", 1, text("first body"), 2, 1)], [page("b", 1, text("of b"), 1, 2), page("a", 1, text("anew"), 2, 2)]]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(folder)
        query = assembly.chunk_documents(spark, folder, out, mark)
        assert query.awaitTermination(240) and query.exception() is None
        files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
        assert kept.items() <= files.items()
        kept = files
    assert spark.conf.get(assembly._PROVIDER) == given
    assert {r["source"]: r["text"] for r in spark.read.parquet(out).collect()} == {"a": "first body\n\nsecond body", "b": "of b"}
    assert [(r["source"], r["page"]) for r in spark.read.parquet(f"{out}-late").collect()] == [("a", 1)]
