"""Sections of documents, native: headings split, tiny ones join their successor.

Lines and sections are numbered and summed in blocks (``running``), so a source of any
number of lines is worked on by many tasks; a task holds one section's text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.functions import text as T
from gleaner.operators.running import before
from gleaner.sources.tables import save


def lines_of(documents: DataFrame) -> DataFrame:
    """(source, pos, line, last) of texts that are rows; pages.lines_of() gives the same
    of pages."""
    rows = documents.select("source", F.split("text", "\n").alias("rows")).select("source", F.size("rows").alias("n"), F.posexplode("rows").alias("pos", "line"))
    return rows.select("source", "pos", "line", (F.col("pos") == F.col("n") - 1).alias("last"))


def sections_of_lines(lines: DataFrame) -> DataFrame:
    """(source, section_no, start, end, text, section, heading_level): a document
    heading starts a section; blank ones are dropped, and a document without any
    is one section."""
    rows = lines.withColumn("heading", T.is_document_heading(F.col("line")))
    rows = before(rows, "source", "pos", start=(F.sum, F.length("line").cast("long") + 1), part=(F.sum, F.col("heading").cast("int")))
    rows = rows.withColumn("start", F.coalesce("start", F.lit(0))).withColumn("part", F.coalesce("part", F.lit(0)) + F.col("heading").cast("int"))
    parts = rows.groupBy("source", "part").agg(
        F.min("start").alias("start"), F.sum(F.length("line").cast("long") + 1).alias("size"), F.max("last").alias("last"), F.max("heading").alias("headed"),
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"),
    )
    # The line end before the next section belongs to this one.
    text = F.concat(F.array_join("rows.line", "\n"), F.when(F.col("last"), "").otherwise("\n"))
    name = F.when(F.col("headed"), T.strip(F.get(F.col("rows.line"), 0))).otherwise("")
    parts = parts.select(
        "source", "part", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size") - F.col("last").cast("int")).cast("int").alias("end"), text.alias("text"), F.substring(name, 1, 120).alias("section"),
        F.when(F.col("headed"), T.heading_level(name)).otherwise(0).alias("heading_level"),
    ).where(T.strip(F.col("text")) != "")
    numbered = before(parts, "source", "part", n=(F.sum, F.lit(1)))
    return numbered.select("source", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("section_no"), "start", "end", "text", "section", "heading_level")


def raw_sections(documents: DataFrame) -> DataFrame:
    return sections_of_lines(lines_of(documents))


def outline(documents: DataFrame) -> DataFrame:
    """raw_sections() with ``tokens`` instead of the text: headings, places and sizes of
    lines decide on sections, so no text is dealt out or written for them."""
    bare = T.strip(F.col("line"))
    rows = lines_of(documents).select(
        "source", "pos", "last", (F.length("line").cast("long") + 1).alias("size"), (bare != "").alias("solid"), T.count_length_tokens(F.col("line")).alias("tokens"), T.is_document_heading(F.col("line")).alias("heading"),
        F.when(T.is_document_heading(F.col("line")), F.struct(F.substring(bare, 1, 120).alias("section"), T.heading_level(bare).alias("level"))).alias("head"),
    )
    rows = before(rows, "source", "pos", start=(F.sum, F.col("size")), part=(F.sum, F.col("heading").cast("int")))
    rows = rows.withColumn("start", F.coalesce("start", F.lit(0))).withColumn("part", F.coalesce("part", F.lit(0)) + F.col("heading").cast("int"))
    parts = rows.groupBy("source", "part").agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.max("last").alias("last"), F.max("head").alias("head"), F.max("solid").alias("solid"), F.sum("tokens").alias("tokens"))
    parts = parts.where("solid").select("source", "part", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size") - F.col("last").cast("int")).cast("int").alias("end"), F.coalesce("head.section", F.lit("")).alias("section"), F.coalesce("head.level", F.lit(0)).alias("heading_level"), "tokens")
    numbered = before(parts, "source", "part", n=(F.sum, F.lit(1)))
    return numbered.select("source", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("section_no"), "start", "end", "section", "heading_level", "tokens")


def merged(sections: DataFrame, tiny: int = 8) -> DataFrame:
    """``sections`` where a headed section of at most ``tiny`` tokens takes its
    successor in: in a run of tiny sections those at even places do.  Sections of outline()
    have no text."""
    texts = "text" in sections.columns
    tokens = T.count_length_tokens(F.col("text")) if texts else F.col("tokens")
    rows = save(sections.withColumn("tiny", (F.col("section") != "") & (tokens <= tiny)).withColumn("group", F.struct("source")), "sections")
    # Numbers alone decide.  Places in a run count from the last section before that isn't tiny.
    runs = before(rows.select("group", "section_no", "tiny"), "group", "section_no", stored=True, solid=(F.max, F.when(~F.col("tiny"), F.col("section_no"))))
    even = F.col("tiny") & ((F.col("section_no") - F.coalesce("solid", F.lit(0)) - 1) % 2 == 0)
    runs = save(runs.select("group", "section_no", even.alias("even")), "runs")
    prior = runs.select("group", (F.col("section_no") + 1).alias("section_no"), F.col("even").alias("taken"))
    runs = runs.join(prior, ["group", "section_no"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    runs = before(runs, "group", "section_no", gone=(F.sum, F.col("taken").cast("int"))).where(~F.col("taken"))
    after = rows.select("group", (F.col("section_no") - 1).alias("section_no"), F.col("end").alias("next_end"), F.col("section").alias("next_section"), *([F.col("text").alias("next_text")] if texts else []))
    rows = rows.join(runs.select("group", "section_no", "even", "gone"), ["group", "section_no"]).join(after, ["group", "section_no"], "left")
    takes = F.col("even") & F.col("next_end").isNotNull()
    label = F.when((F.col("next_section") != "") & (F.col("next_section") != F.col("section")), F.concat_ws(" / ", "section", "next_section")).otherwise(F.col("section"))
    return rows.select(
        "source", (F.col("section_no") - F.coalesce("gone", F.lit(0))).cast("int").alias("section_no"), "start", F.when(takes, F.col("next_end")).otherwise(F.col("end")).alias("end"), *([F.when(takes, F.concat("text", "next_text")).otherwise(F.col("text")).alias("text")] if texts else []),
        F.when(takes, F.substring(label, 1, 120)).otherwise(F.col("section")).alias("section"), "heading_level",
    )


def cut(documents: DataFrame, outlined: DataFrame) -> DataFrame:
    """The sections ``outlined`` (of outline() or merged()) with their texts; a document
    meets its outline as one row and is cut once."""
    parts = outlined.groupBy(F.struct("source").alias("group")).agg(F.collect_list(F.struct("section_no", "start", "end", "section", "heading_level")).alias("parts"))
    rows = documents.select("source", "text").join(parts, F.struct("source") == F.col("group")).select("source", "text", "parts")
    kinds = {f.name: f.dataType for f in outlined.schema.fields} | {"text": StringType()}
    names = ["source", "section_no", "start", "end", "text", "section", "heading_level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, own = batch.column(1)[i].as_py(), batch.column(2)[i].values
                bounds = zip(own.field("start").to_pylist(), own.field("end").to_pylist(), strict=True)
                made = {"source": pa.repeat(batch.column(0)[i], len(own)), "text": pa.array([text[a:b] for a, b in bounds], pa.string())}
                yield pa.RecordBatch.from_arrays([made[n] if n in made else own.field(n) for n in names], names)

    return rows.mapInArrow(run, StructType([StructField(n, kinds[n]) for n in names]))


def sections_of(documents: DataFrame, tiny: int = 8) -> DataFrame:
    return cut(documents, merged(outline(documents), tiny))
