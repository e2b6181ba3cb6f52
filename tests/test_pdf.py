"""PDF files made here, of several layouts, read back as pages."""

import zlib

import pytest

from gleaner import cli
from gleaner.sources import files, pdf


def stream(data, flate=True, extra=b""):
    body = zlib.compress(data) if flate else data
    return b"<< /Length %d%s%s >>\nstream\n%s\nendstream" % (len(body), b" /Filter /FlateDecode" if flate else b"", extra, body)


def written(objects, packed=()):
    """A file of numbered objects; those in ``packed`` go into an object stream."""
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        if n not in packed:
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if packed:
        at, heads, bodies = 0, [], []
        for n in packed:
            heads.append(b"%d %d" % (n, at))
            bodies.append(objects[n])
            at += len(objects[n]) + 1
        head = b" ".join(heads) + b"\n"
        out += b"900 0 obj\n%s\nendobj\n" % stream(head + b"\n".join(bodies), extra=b" /Type /ObjStm /N %d /First %d" % (len(packed), len(head)))
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"1 beginbfchar <0001> <4E32> endbfchar 2 beginbfrange <0002> <0004> <0041> <0010> <0011> [<53E3> <D83DDE00>] endbfrange"
FONTS = {7: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>", 9: stream(CMAP)}
TABLE = b"0.5 w 50 700 200 20 re S 50 680 200 20 re S 150 680 m 150 720 l S BT /F1 10 Tf 55 705 Td (Name) Tj 100 0 Td (Size) Tj -100 -20 Td (ram) Tj 100 0 Td (2GB) Tj ET"


def text(*lines, at=(50, 780), lead=12):
    return b"BT /F1 10 Tf %d %d Td %d TL " % (*at, lead) + b" T* ".join(b"(%s) Tj" % x for x in lines) + b" ET "


def two_level_file(flate=True, packed=()):
    """Four pages under two nodes, in another order than their numbers; resources are
    inherited, by reference and in place."""
    inside = b"/Resources << /Font << /F1 7 0 R /F2 8 0 R >> >>"
    return written({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 4 " + inside + b" >>",
        3: b"<< /Type /Pages /Parent 2 0 R /Kids [10 0 R] /Count 1 >>", 4: b"<< /Type /Pages /Parent 2 0 R /Kids [12 0 R 11 0 R 13 0 R] /Count 3 >>",
        10: b"<< /Type /Page /Parent 3 0 R /Contents 20 0 R >>", 11: b"<< /Type /Page /Parent 4 0 R /Contents [21 0 R 22 0 R] /Resources 30 0 R >>", 12: b"<< /Type/Page /Parent 4 0 R /Contents 23 0 R >>", 13: b"<< /Type /Page /Parent 4 0 R >>",
        20: stream(text(b"last page", b"with \\(brackets\\) and \\101\\102"), flate), 21: stream(text(b"Head", b"second line") + text(b"another block", at=(50, 600)), flate), 22: stream(TABLE, flate),
        23: stream(b"q 1 0 0 1 10 0 cm BT /F2 12 Tf 1 0 0 1 40 700 Tm <00010010> Tj [<0002> -250 <00030004>] TJ ET Q BT /F1 9 Tf 300 700 Td (right) ' ET BI /W 1 ID \xff(x) Tj EI", flate),
        30: b"<< /Font 31 0 R >>", 31: b"<< /F1 7 0 R >>", **FONTS,
    }, packed)


@pytest.mark.parametrize("flate,packed", [(True, ()), (False, ()), (True, (1, 2, 3, 4, 10, 11, 12, 13, 7, 30, 31))])
def test_pages_of_a_file(spark, tmp_path, flate, packed):
    (tmp_path / "a.pdf").write_bytes(two_level_file(flate, packed))
    got = {r["page"]: r for r in pdf.raw_pages(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["blocks"] == ["串口A BC right"]
    assert got[2]["blocks"] == ["Head\nsecond line", "Name Size", "ram 2GB", "another block"]
    assert got[2]["tables"] == [[["Name", "Size"], ["ram", "2GB"]]]
    assert got[3]["blocks"] is None and got[3]["tables"] is None
    assert got[4]["blocks"] == ["last page\nwith (brackets) and AB"] and got[4]["tables"] is None


def test_folder_of_files(spark, tmp_path):
    """To cleaned pages: numbers stay, repeated lines and empty pages go; damage and files
    without pages are passed over, subfolders aren't read."""
    one = lambda i: stream(text(b"Company head", b"head two", b"body %d of it" % i, b"more %d" % i, b"foot one", b"Company foot"))
    many = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(5)) + b"] >>", **FONTS}
    for i in range(5):
        many |= {10 + i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 7 0 R >> >> >>" % (20 + i), 20 + i: one(i) if i != 2 else stream(b"")}
    (tmp_path / "many.pdf").write_bytes(written(many))
    (tmp_path / "two.pdf").write_bytes(two_level_file())
    (tmp_path / "later.pdf").write_bytes(written(many) + b"\n21 0 obj\n" + stream(text(b"Company head", b"head two", b"changed", b"more", b"foot one", b"Company foot")) + b"\nendobj\n")
    (tmp_path / "broken.pdf").write_bytes(two_level_file()[:700])
    (tmp_path / "none.pdf").write_bytes(b"")
    (tmp_path / "junk.pdf").write_bytes(b"\xff\x00 1 0 obj stream\n" * 9)
    (tmp_path / "x=1").mkdir()
    (tmp_path / "x=1" / "b.pdf").write_bytes(two_level_file())
    rows = files.read_pdfs(spark, str(tmp_path)).collect()
    by = {(r["source"], r["page"]): r["text"] for r in rows}
    assert [by[("many.pdf", i + 1)] for i in (0, 1, 3, 4)] == [f"body {i} of it\nmore {i}" for i in (0, 1, 3, 4)] and ("many.pdf", 3) not in by
    assert by[("later.pdf", 2)] == "changed\nmore" and "[TABLE 1]" in by[("two.pdf", 2)]
    assert not {s for s, _ in by} & {"none.pdf", "junk.pdf", "b.pdf"}
    with pytest.raises(FileNotFoundError):
        files.read_pdfs(spark, str(tmp_path / "nowhere"))


def test_chunks_from_the_command_line(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(two_level_file())
    cli.run(cli.parser().parse_args(["chunk", "--docs", str(tmp_path / "docs"), "--out", str(tmp_path / "chunks")]), spark)
    rows = spark.read.parquet(str(tmp_path / "chunks")).collect()
    assert {r["source"] for r in rows} == {"a.pdf"} and any("Row 1:" in r["text"] and "Size: 2GB" in r["text"] for r in rows)


def test_maps_to_unicode():
    assert pdf.to_unicode(CMAP) == {1: "串", 2: "A", 3: "B", 4: "C", 16: "口", 17: "😀"}
    assert pdf.to_unicode(b"") == {}


def test_tables_apart(spark):
    """Two grids of a page, a frame, and a row whose cells join."""
    rules = []

    def grid(xs, ys):
        rules.extend((0.0, y, 0.0) and ("rule", float(xs[0]), float(y), float(xs[-1]), float(y)) for y in ys)
        rules.extend(("rule", float(x), float(ys[0]), float(x), float(ys[-1])) for x in xs)

    grid([0, 50, 100], [500, 510, 520])
    grid([0, 100], [400, 410])
    grid([0, 30, 60, 90], [300, 310, 320])
    marks = [(*r, 0.0, None) for r in rules] + [("text", 5.0, 512.0, 9.0, 512.0, 8.0, "a"), ("text", 55.0, 512.0, 60.0, 512.0, 8.0, "b"), ("text", 5.0, 502.0, 9.0, 502.0, 8.0, "c"), ("text", 20.0, 502.0, 25.0, 502.0, 8.0, "d"), ("text", 61.0, 303.0, 70.0, 303.0, 8.0, "z"), ("text", 5.0, 403.0, 9.0, 403.0, 8.0, "framed")]
    df = spark.createDataFrame([("f", 1, i, *m) for i, m in enumerate(marks)], "file_path string, page int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, size double, text string")
    assert [r["tables"] for r in pdf.tables(df).collect()] == [[[["a", "b"], ["c d", ""]], [["", "", ""], ["", "", "z"]]]]
