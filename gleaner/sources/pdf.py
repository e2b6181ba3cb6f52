"""PDF folders as rows: objects, page tree, text runs, lines, blocks and ruled tables.

A file's objects become rows in a worker, and so do a page's text runs and ruled
lines.  What holds them together is relational: references are joins by file and object
number, the page tree is climbed a level at a time, runs are grouped into lines and
blocks, and cells are found by the rules around them.  A file is one row when read, a
page's content one row when drawn; all other steps are dealt by file and page.

Read are unencrypted files with plain or Flate streams, object streams, one-byte fonts
(Latin-1) and fonts with a ToUnicode map.  Of an object written twice the later one
counts.  Glyph widths aren't read: a run's end is estimated.  What can't be decoded
(other filters, encryption) gives no text; a file without pages gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.sources.tables import save

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_OPENS = re.compile(rb"stream\r?\n|endobj")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
#: Levels of a page tree; a deeper or circular one ends there.
DEPTH = 32
#: Ends of rules closer than this are one place; runs are one line within it.
NEAR = 1.0
_REF = r"(\d+)\s+\d+\s+R\b"


def _unpacked(head: bytes, raw: bytes) -> bytes | None:
    """The stream's bytes; None if a filter isn't known or the data are damaged."""
    if b"/Filter" not in head:
        return raw
    if re.search(rb"/Filter\s*(?:\[\s*)?/FlateDecode\s*(?:\]|/|>>|$)", head) is None or b"/Predictor" in head:
        return None
    try:
        return zlib.decompressobj().decompress(raw)
    except zlib.error:
        return None


def file_objects(content: bytes) -> Iterator[tuple[int, int, str, bytes | None]]:
    """(offset, number, head, stream) of each object of a file, those in object
    streams too."""
    at = 0
    while found := _OBJECT.search(content, at):
        opens = _OPENS.search(content, found.end())
        end = opens.start() if opens else len(content)
        head, stream, at = content[found.end() : end], None, opens.end() if opens else len(content)
        if opens and opens.group() != b"endobj":
            length = _LENGTH.search(head)
            close = at + int(length.group(1)) if length else -1
            if close < 0 or not content[close : close + 12].lstrip().startswith(b"endstream"):
                close = content.find(b"endstream", at)
                close = len(content) if close < 0 else close
            stream, at = None if b"/Image" in head else _unpacked(head, content[at:close]), close
        if stream is not None and re.search(rb"/Type\s*/ObjStm", head):
            first = int(re.search(rb"/First\s+(\d+)", head).group(1))
            numbers = list(map(int, stream[:first].split()))
            starts = [*numbers[1::2], len(stream) - first]
            for i, number in enumerate(numbers[::2]):
                yield found.start(), number, stream[first + starts[i] : first + starts[i + 1]].decode("latin-1"), None
        else:
            yield found.start(), int(found.group(1)), head.decode("latin-1"), stream


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The *.pdf files of a folder, not below it; none is an error."""
    try:  # a pattern, not the folder: no subfolder is read as a partition
        return spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*.pdf")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no PDF in {folder}") from None


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, num, head, stream) of the files of a folder."""
    schema = pa.schema([("file_path", pa.string()), ("at", pa.int64()), ("num", pa.int64()), ("head", pa.string()), ("stream", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = [dict(zip(schema.names, (path.as_py(), *x), strict=True)) for x in file_objects(content.as_py())]
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 500], schema)

    found = save(files(spark, folder).select("path", "content").mapInArrow(scan, "file_path string, at long, num long, head string, stream binary"), "pdf-objects")
    last = found.groupBy("file_path", "num").agg(F.max_by(F.struct("head", "stream"), "at").alias("x"))
    return save(last.select("file_path", "num", "x.head", "x.stream"), "pdf-latest")


def _ref(name: str, head: str = "head") -> Column:
    return F.nullif(F.regexp_extract(head, rf"/{name}\s+{_REF}", 1), F.lit("")).cast("long")


def _refs(name: str, head: str = "head") -> Column:
    """Object numbers of an array, or of a single reference."""
    inside = F.regexp_extract(head, rf"/{name}\s*\[([^\]]*)\]", 1)
    single = F.regexp_extract(head, rf"/{name}\s+(\d+\s+\d+\s+R\b)", 1)
    return F.transform(F.regexp_extract_all(F.concat(inside, single), F.lit(_REF), F.lit(1)), lambda x: x.cast("long"))


def page_tree(found: DataFrame) -> DataFrame:
    """(file_path, page, num, head, resources): pages in the order of the tree, with the
    object that holds their resources, their own or the nearest inherited."""
    kids = found.where(F.col("head").rlike(r"/Kids\s*\[")).select("file_path", F.col("num").alias("parent"), F.when(F.col("head").rlike("/Resources"), F.col("num")).alias("gives"), F.posexplode(_refs("Kids")).alias("nth", "at"))
    kids = save(kids, "pdf-kids")
    own = F.when(F.col("head").rlike("/Resources"), F.col("num"))
    rows = found.where(F.col("head").rlike(r"/Type\s*/Page(?![A-Za-z])")).select("file_path", "num", F.col("num").alias("at"), F.array().cast("array<int>").alias("key"), own.alias("resources"))
    for _ in range(DEPTH):
        climbed = rows.join(kids, ["file_path", "at"], "left")
        rows = save(climbed.select("file_path", "num", F.col("parent").alias("at"), F.when(F.col("nth").isNotNull(), F.concat(F.array("nth"), "key")).otherwise(F.col("key")).alias("key"), F.coalesce("resources", "gives").alias("resources")), "pdf-tree")
        if rows.where("at is not null").isEmpty():
            break
    page = F.row_number().over(Window.partitionBy("file_path").orderBy("key", "num"))
    return rows.select("file_path", "num", page.alias("page"), "resources").join(found.select("file_path", "num", "head"), ["file_path", "num"])


def page_content(found: DataFrame) -> DataFrame:
    """(file_path, page, parts, fonts): a page's content streams in order, and name, code
    size and ToUnicode map of its fonts."""
    tree = save(page_tree(found), "pdf-pages")
    streams = found.where("stream is not null").select("file_path", F.col("num").alias("ref"), "stream")
    parts = tree.select("file_path", "page", F.posexplode(_refs("Contents")).alias("nth", "ref")).join(streams, ["file_path", "ref"])
    parts = parts.groupBy("file_path", "page").agg(F.array_sort(F.collect_list(F.struct("nth", "stream"))).alias("parts"))
    other = lambda name: found.select("file_path", F.col("num").alias(name), F.col("head").alias(f"{name}_head"))
    # Resources and the fonts' dictionary may stand in the page or be objects of their own.
    res = tree.join(other("resources"), ["file_path", "resources"]).withColumn("apart", _ref("Resources", "resources_head")).join(other("apart"), ["file_path", "apart"], "left")
    res = res.withColumn("res", F.coalesce("apart_head", "resources_head")).withColumn("fonts", _ref("Font", "res")).join(other("fonts"), ["file_path", "fonts"], "left")
    named = F.regexp_extract_all(F.coalesce("fonts_head", F.regexp_extract("res", r"/Font\s*<<([^>]*)>>", 1)), F.lit(rf"(/[^\s/<>\[\]()]+\s+\d+)\s+\d+\s+R\b"), F.lit(1))
    fonts = res.select("file_path", "page", F.explode(F.transform(named, lambda x: F.split(x, r"\s+"))).alias("f")).select("file_path", "page", F.substring(F.col("f")[0], 2, 200).alias("name"), F.col("f")[1].cast("long").alias("font"))
    fonts = fonts.join(other("font"), ["file_path", "font"]).withColumn("ref", _ref("ToUnicode", "font_head")).join(streams, ["file_path", "ref"], "left")
    fonts = fonts.groupBy("file_path", "page").agg(F.collect_list(F.struct("name", F.col("font_head").rlike("/Type0").alias("wide"), F.col("stream").alias("cmap"))).alias("fonts"))
    return tree.select("file_path", "page").join(parts, ["file_path", "page"], "left").join(fonts, ["file_path", "page"], "left")


_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s()<>\[\]{}/%]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"][A-Za-z0-9*]*|%[^\r\n]*", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|\r?\n|(.))", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _PLAIN.get(m[2], m[2]) if m[2] else b"", token[1:-1])


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map."""
    out = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, many, one in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:\[([^\]]*)\]|<([0-9A-Fa-f]+)>)", block):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65_535)
            if many:
                out |= {low + i: text(h) for i, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many))}
            else:
                first = text(one)
                out |= {c: first[:-1] + chr(ord(first[-1]) + c - low) for c in range(low, high + 1)}
    return out


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def drawn(content: bytes, fonts: dict[str, tuple[bool, dict[int, str]]]) -> Iterator[tuple[str, float, float, float, float, float, str | None]]:
    """(kind, x0, y0, x1, y1, size, text) of the text runs and the ruled lines of a page,
    in the order they are drawn."""
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, tm, line, lead, font, size, here, args = unit, [], unit, unit, 0.0, (False, {}), 1.0, (0.0, 0.0), []

    def shown(raw: bytes) -> str:
        wide, codes = font
        step = 2 if wide else 1
        return "".join(codes.get(c, chr(c) if not wide else "") for c in (int.from_bytes(raw[i : i + step], "big") for i in range(0, len(raw) - step + 1, step)))

    def run(text: str):
        nonlocal tm
        at = _times(tm, ctm)
        height = abs(size) * (abs(at[3]) or abs(at[1]) or 1.0)
        wide = 0.5 * abs(size) * len(text)
        tm = _times((1.0, 0.0, 0.0, 1.0, wide, 0.0), tm)
        return "text", at[4], at[5], _times(tm, ctm)[4], at[5], height, text

    def rule(x0: float, y0: float, x1: float, y1: float):
        (a, b), (c, d) = ((ctm[0] * x + ctm[2] * y + ctm[4], ctm[1] * x + ctm[3] * y + ctm[5]) for x, y in ((x0, y0), (x1, y1)))
        if abs(a - c) <= NEAR or abs(b - d) <= NEAR:
            yield "rule", min(a, c), min(b, d), max(a, c), max(b, d), 0.0, None

    for token in _TOKEN.findall(re.sub(rb"\bBI\s.*?\sEI\b", b" ", content, flags=re.S)):
        if token[:1] in b"(<[]/" or token[:1].isdigit() or token[:1] in b"+-.":
            args.append(token)
            continue
        if token[:1] == b"%":
            continue
        numbers = [float(t) for t in args if t[:1] not in b"(<[]/"]
        texts = [t for t in args if t[:1] == b"(" or (t[:1] == b"<" and t != b"<<")]
        n = len(numbers)
        if token == b"q":
            saved.append(ctm)
        elif token == b"Q":
            ctm = saved.pop() if saved else ctm
        elif token == b"cm" and n >= 6:
            ctm = _times(tuple(numbers[-6:]), ctm)
        elif token == b"BT":
            tm = line = unit
        elif token == b"Tf" and n:
            size, font = numbers[-1], fonts.get(next((t[1:].decode("latin-1") for t in args if t[:1] == b"/"), ""), (False, {}))
        elif token == b"TL" and n:
            lead = numbers[-1]
        elif token == b"Tm" and n >= 6:
            tm = line = tuple(numbers[-6:])
        elif token in (b"Td", b"TD") and n >= 2:
            lead = -numbers[-1] if token == b"TD" else lead
            tm = line = _times((1.0, 0.0, 0.0, 1.0, *numbers[-2:]), line)
        elif token == b"T*":
            tm = line = _times((1.0, 0.0, 0.0, 1.0, 0.0, -lead), line)
        elif token in (b"Tj", b"'", b'"') and texts:
            if token != b"Tj":
                tm = line = _times((1.0, 0.0, 0.0, 1.0, 0.0, -lead), line)
            yield run(shown(_string(texts[-1])))
        elif token == b"TJ":  # a wide step to the right is a space
            pieces = [shown(_string(t)) if t[:1] in b"(<" else " " if t[:1] == b"-" and float(t) < -180 else "" for t in args if t not in (b"[", b"]")]
            yield run("".join(pieces))
        elif token == b"re" and n >= 4:
            x, y, w, h = numbers[-4:]
            for edge in ((x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)):
                yield from rule(*edge)
        elif token == b"m" and n >= 2:
            here = (numbers[-2], numbers[-1])
        elif token == b"l" and n >= 2:
            yield from rule(*here, numbers[-2], numbers[-1])
            here = (numbers[-2], numbers[-1])
        args = []


def marks(content: DataFrame) -> DataFrame:
    """(file_path, page, seq, kind, x0, y0, x1, y1, size, text) of all pages."""
    names = ("file_path", "page", "seq", "kind", "x0", "y0", "x1", "y1", "size", "text")
    schema = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5, pa.string()), strict=True)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                fonts = {f["name"]: (f["wide"], to_unicode(f["cmap"] or b"")) for f in page["fonts"] or []}
                found = drawn(b"\n".join(p["stream"] for p in page["parts"] or []), fonts)
                rows = [dict(zip(names, (page["file_path"], page["page"], i, *x), strict=True)) for i, x in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return save(content.mapInArrow(draw, "file_path string, page int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, size double, text string"), "pdf-marks")


_PAGE = ["file_path", "page"]


def blocks(found: DataFrame) -> DataFrame:
    """(file_path, page, blocks): runs of one height are a line, from left to right; lines
    closer than one and a half sizes are a block, from top to bottom."""
    runs = found.where("kind = 'text' and text <> ''")
    below = Window.partitionBy(*_PAGE).orderBy(F.desc("y0"), "x0", "seq")
    runs = runs.withColumn("line", F.sum((F.coalesce(F.lag("y0").over(below) - F.col("y0"), F.lit(NEAR * 2)) > NEAR).cast("int")).over(below))
    parts = F.array_sort(F.collect_list(F.struct("x0", "seq", "x1", "size", "text")))
    lines = runs.groupBy(*_PAGE, "line").agg(F.max("y0").alias("y"), F.max("size").alias("size"), parts.alias("runs"))
    gap = lambda a, x: (a["at"] < x["x0"] - 0.15 * x["size"]) & ~a["out"].endswith(" ") & ~x["text"].startswith(" ")
    joined = F.aggregate("runs", F.struct(F.lit(1e9).alias("at"), F.lit("").alias("out")), lambda a, x: F.struct(x["x1"].alias("at"), F.concat(a["out"], F.when(gap(a, x), " ").otherwise(""), x["text"]).alias("out")))
    lines = lines.withColumn("text", joined["out"])
    down = Window.partitionBy(*_PAGE).orderBy("line")
    far = F.coalesce(F.lag("y").over(down) - F.col("y") > 1.5 * F.greatest("size", F.lag("size").over(down)), F.lit(True))
    lines = lines.withColumn("block", F.sum(far.cast("int")).over(down))
    texts = lines.groupBy(*_PAGE, "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "\n").alias("text"))
    return texts.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(F.struct("block", "text")))["text"].alias("blocks"))


def tables(found: DataFrame) -> DataFrame:
    """(file_path, page, tables): between two neighbouring horizontal rules there is a row
    if two vertical rules at least go all the way; what stands between neighbouring ones
    is a cell.  Rows that follow each other are a table; one of a single cell is a frame."""
    rules = found.where("kind = 'rule'")
    level = F.round(F.col("y0") / NEAR) * NEAR
    flat = rules.where(F.col("y1") - F.col("y0") <= NEAR).where(F.col("x1") - F.col("x0") > NEAR).groupBy(*_PAGE).agg(F.array_sort(F.collect_set(level)).alias("ys"))
    upright = rules.where(F.col("x1") - F.col("x0") <= NEAR).where(F.col("y1") - F.col("y0") > NEAR)
    bands = flat.select(*_PAGE, F.explode(F.transform(F.sequence(F.lit(1), F.size("ys") - 1), lambda i: F.struct(F.get("ys", i - 1).alias("low"), F.get("ys", i).alias("high"), i.alias("i")))).alias("b")).where("b.i > 0 and b.high is not null").select(*_PAGE, "b.*")
    across = (F.col("y0") <= F.col("low") + NEAR) & (F.col("y1") >= F.col("high") - NEAR)
    rows = bands.join(upright.select(*_PAGE, "x0", "y0", "y1"), _PAGE).where(across).groupBy(*_PAGE, "i", "low", "high").agg(F.array_sort(F.collect_set(F.round(F.col("x0") / NEAR) * NEAR)).alias("xs")).where(F.size("xs") > 1)
    up = Window.partitionBy(*_PAGE).orderBy(F.desc("i"))
    rows = rows.withColumn("table", F.sum((F.coalesce(F.lag("i").over(up) - F.col("i"), F.lit(2)) > 1).cast("int")).over(up))
    cells = rows.select(*_PAGE, "table", "i", "low", "high", F.explode(F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda k: F.struct(k.alias("k"), F.get("xs", k - 1).alias("left"), F.get("xs", k).alias("right")))).alias("c")).select(*_PAGE, "table", "i", "low", "high", "c.*")
    runs = found.where("kind = 'text' and text <> ''").select(*_PAGE, "x0", "y0", "seq", "text")
    inside = (F.col("y0") >= F.col("low")) & (F.col("y0") < F.col("high")) & (F.col("x0") >= F.col("left")) & (F.col("x0") < F.col("right"))
    texts = cells.join(runs, _PAGE).where(inside).groupBy(*_PAGE, "table", "i", "k").agg(F.array_join(F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("y"), "x0", "seq", "text")))["text"], " ").alias("text"))
    cells = cells.select(*_PAGE, "table", "i", "k").join(texts, [*_PAGE, "table", "i", "k"], "left")
    grid = cells.groupBy(*_PAGE, "table", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("cells"))
    grid = grid.groupBy(*_PAGE, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("i"), "cells"))), lambda x: x["cells"]).alias("rows")).where((F.size("rows") > 1) | (F.size(F.get("rows", F.lit(0))) > 1))
    return grid.groupBy(*_PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("table", "rows"))), lambda x: x["rows"]).alias("tables"))


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, page, blocks, tables) of every page of every *.pdf in a folder; a
    folder without any is an error."""
    content = save(page_content(objects(spark, folder)), "pdf-content")
    found = marks(content)
    return content.select(*_PAGE).join(blocks(found), _PAGE, "left").join(tables(found), _PAGE, "left")
