"""Pages: repeated header and footer lines, cleaning, documents, page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import text as T
from gleaner.operators.running import before


def repeated_lines(pages: DataFrame, min_pages: int = 2) -> DataFrame:
    """(source, line, n): lines among the first or last two of their pages that
    occur there ``min_pages`` times (once suffices in a source of one page).  A
    short page's line may count twice; numbers and lines under three characters
    don't count."""
    edges = pages.withColumn("rows", T.lines(F.col("text")))
    both = F.concat(F.slice("rows", 1, 2), F.slice("rows", F.greatest(F.size("rows") - 1, F.lit(1)), F.lit(2)))
    found = edges.select("source", F.explode(F.transform(both, T.collapse)).alias("line"))
    found = found.where(~F.col("line").rlike(r"^\d+$") & (F.length("line") >= 3)).groupBy("source", "line").agg(F.count("*").alias("n"))
    size = pages.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("pages"))
    return found.join(size, F.col("source").eqNullSafe(F.col("s"))).where(F.col("n") >= F.least(F.lit(min_pages), "pages")).select("source", "line", "n")


def strip_repeated(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """``pages`` without repeated lines, page numbers and confidentiality marks,
    cleaned; pages that end up empty are dropped."""
    rows = pages.select("source", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("key", T.collapse(T.strip(F.col("line"))))
    rows = rows.where((F.col("key") == "") | ~(F.col("key").rlike(T.PAGE_NUMBER) | F.lower("key").isin(*T.CONFIDENTIAL)))
    marks = repeated.select(F.col("source").alias("s"), F.col("line").alias("mark"))
    rows = rows.join(marks, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("mark")), "left_anti")
    line = F.when(F.col("key") == "", "").otherwise(F.col("line"))
    texts = rows.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    texts = texts.select(F.col("source").alias("s"), F.col("page").alias("p"), T.normalize(F.array_join(F.col("rows.line"), "\n")).alias("text")).where("text <> ''")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("page").eqNullSafe(F.col("p"))
    return pages.drop("text").join(texts, same).drop("s", "p")


def page_spans(pages: DataFrame) -> DataFrame:
    """(source, page, start, end) of each page in its document's text."""
    rows = pages.select("source", "page", F.length("text").cast("long").alias("length"))
    rows = before(rows, "source", "page", ["length"], start=(F.sum, F.col("length") + 2)).withColumn("start", F.coalesce("start", F.lit(0)))
    return rows.select("source", "page", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("length")).cast("int").alias("end"))


def lines_of(pages: DataFrame) -> DataFrame:
    """(source, pos, line, last): the lines of each document that documents_of()
    would make, without making it, so a document may be larger than a row.  ``pos`` counts
    lines; ``last`` marks the document's last one."""
    rows = pages.select("source", "page", F.length("text").alias("length"), F.split("text", "\n").alias("rows"))
    rows = before(rows, "source", "page", ["length"], row=(F.sum, F.size("rows") + 1)).withColumn("row", F.coalesce("row", F.lit(0)))
    ends = rows.groupBy(F.struct("source").alias("g")).agg(F.max(F.col("row") + F.size("rows")).alias("n"))
    rows = rows.join(ends, F.struct("source") == F.col("g"))
    # An empty line stands between two pages.
    final = F.col("row") + F.size("rows") == F.col("n")
    rows = rows.select("source", "row", "n", F.posexplode(F.when(final, F.col("rows")).otherwise(F.concat("rows", F.array(F.lit(""))))).alias("i", "line"))
    return rows.select("source", (F.col("row") + F.col("i")).alias("pos"), "line", (F.col("row") + F.col("i") == F.col("n") - 1).alias("last"))


def documents_of(pages: DataFrame) -> DataFrame:
    """(source, file_path, text): pages in order, joined by an empty line."""
    rows = pages.groupBy("source").agg(F.min("file_path").alias("file_path"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("rows"))
    return rows.select("source", "file_path", F.array_join(F.col("rows.text"), "\n\n").alias("text"))


#: Characters of a stretch of a document, by which spans meet pages.
STRETCH = 4_096


def _stretches(start: str, end: str):
    return F.explode(F.sequence(F.floor(F.col(start) / STRETCH), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / STRETCH)))


def pages_of_spans(spans: DataFrame, pages: DataFrame, start: str = "char_start", end: str = "char_end", out: tuple[str, str] = ("start_page", "end_page")) -> DataFrame:
    """``spans`` (source and the two offsets) with the first and the last page that
    each overlaps; one that overlaps none gets the page that starts nearest, of two
    the first.

    Spans and pages meet by source and stretch of the document, so a span meets only the
    pages around it and a long source is many keys; those few spans that lie between pages
    are compared with all of their source."""
    at = spans.select(F.col("source").alias("s"), F.col(start).alias("a"), F.col(end).alias("b")).distinct()
    own = pages.select(F.col("source").alias("ps"), F.col("start").alias("pa"), F.col("end").alias("pb"), "page")
    near = at.withColumn("k", _stretches("a", "b")).join(own.withColumn("pk", _stretches("pa", "pb")), F.col("s").eqNullSafe(F.col("ps")) & (F.col("k") == F.col("pk")) & (F.col("pa") < F.col("b")) & (F.col("pb") > F.col("a")))
    order = F.struct("pa", "pb", "page")
    hit = near.groupBy("s", "a", "b").agg(F.min_by("page", order).alias(out[0]), F.max_by("page", order).alias(out[1]))
    key = lambda x, y: x["s"].eqNullSafe(y["s"]) & (x["a"] == y["a"]) & (x["b"] == y["b"])
    rest = at.join(hit, key(at, hit), "left_anti")
    beside = rest.join(own, F.col("s").eqNullSafe(F.col("ps"))).groupBy("s", "a", "b").agg(F.min_by("page", F.struct(F.abs(F.col("pa") - F.col("a")), "pa", "pb", "page")).alias(out[0]))
    found = hit.unionByName(beside.withColumn(out[1], F.col(out[0])))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col(start) == F.col("a")) & (F.col(end) == F.col("b"))
    return spans.join(found, same, "left").drop("s", "a", "b")
