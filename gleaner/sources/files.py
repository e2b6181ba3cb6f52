"""Readers and writers: PDF folders, page and chunk JSON lines, vectors, indexes,
reports.  All paths go through Spark, so any file system it knows will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions import text as T
from gleaner.functions.display import page_label, text_preview
from gleaner.operators.pages import repeated_lines, strip_repeated
from gleaner.operators.running import before
from gleaner.sources import pdf

PAGE = "source string, file_path string, page int, text string"
RAW_PAGE = "page int, blocks array<string>, tables array<array<array<string>>>"


def read_pdfs(spark: SparkSession, folder: str, decode: Callable[[bytes], list[tuple[int, list[str], list]]] | None = None) -> DataFrame:
    """Pages of every *.pdf in a folder: source, file_path, page, text.

    They are decoded by ``gleaner.sources.pdf``, or by ``decode``, which turns a file's bytes
    into (page, text blocks, tables).  Subfolders aren't read; a folder without a PDF is an
    error.  Pages keep their numbers; empty ones are dropped."""
    if decode is None:
        return clean_pages(page_texts(pdf.raw_pages(spark, folder)))
    files = pdf.files(spark, folder)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(path, *page) for path, content in zip(batch["path"], batch["content"], strict=True) for page in decode(content)]
            yield pd.DataFrame(rows, columns=["file_path", "page", "blocks", "tables"])

    raw = files.select("path", "content").mapInPandas(run, f"file_path string, {RAW_PAGE}")
    return clean_pages(page_texts(raw))


def page_texts(raw: DataFrame) -> DataFrame:
    """Pages from decoded blocks and tables (``RAW_PAGE`` and file_path): cleaned
    blocks in order, then the tables that hold anything, numbered."""
    none = F.array().cast("array<string>")
    blocks = F.filter(F.transform(F.coalesce("blocks", none), T.normalize), lambda x: x != "")
    texts = F.filter(F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t, i: T.table_rows(t, i + 1)), lambda x: x != "")
    tables = F.transform(texts, lambda x, i: F.concat(F.lit("[TABLE "), (i + 1).cast("string"), F.lit("]\n"), T.normalize(x)))
    source = F.regexp_replace("file_path", "^.*/", "")
    return raw.select(source.alias("source"), "file_path", "page", F.array_join(F.concat(blocks, tables), "\n\n").alias("text"))


def clean_pages(pages: DataFrame, min_pages: int = 2) -> DataFrame:
    return strip_repeated(pages, repeated_lines(pages, min_pages))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing path is an error."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """chunk_id and embedding as Parquet."""
    df.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_flat_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Vectors with their chunks' metadata in one table, for exact search."""
    chunks.join(vectors, "chunk_id").write.mode("overwrite").parquet(path)


def collection(chunks: DataFrame, vectors: DataFrame, document: str = "text") -> DataFrame:
    """Rows of a vector collection: id, document, vector and scalar metadata, with
    arrays joined by commas."""
    rows = chunks.join(vectors, "chunk_id")
    skip = {"chunk_id", document, "embedding", "parent_text"}
    flat = []
    for name, kind in rows.dtypes:
        if name in skip:
            continue
        flat.append(F.array_join(name, ",").alias(name) if kind == "array<string>" else F.to_json(name).alias(name) if kind.startswith(("struct", "map", "array")) else F.col(name))
    return rows.select(F.col("chunk_id").alias("id"), F.col(document).alias("document"), "embedding", *flat)


def write_collection(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Rebuilds the collection."""
    collection(chunks, vectors).write.mode("overwrite").parquet(path)


def latest_by_id(chunks: DataFrame) -> DataFrame:
    """One row an id: the last by ``position``."""
    last = chunks.groupBy("chunk_id").agg(F.max("position").alias("position"))
    return chunks.join(last, ["chunk_id", "position"], "left_semi")


def inspection_markdown(audit: DataFrame, preview: int = 400, full: bool = False) -> DataFrame:
    """(index, markdown): a section for each audited chunk; where the source changes, its
    heading goes before."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    rows = before(audit.withColumn("all", F.lit(0)), "all", "index", prior=(F.max, F.struct("index", F.coalesce("source", F.lit("")).alias("source"))))
    new = ~F.coalesce(F.col("prior.source") == F.coalesce("source", F.lit("")), F.lit(False))
    fields = {
        "page": plain("page_label"), "char_range": F.concat(shown("char_start"), F.lit("-"), shown("char_end")), "chars/tokens": F.concat(plain("char_length"), F.lit(" / "), plain("estimated_tokens")), "parent_id": plain("parent_id"),
        "prev/next": F.concat(plain("prev_chunk_id"), F.lit(" / "), plain("next_chunk_id")), "section": plain("section"), "product_codes": listed("product_codes"), "chip_models": listed("chip_models"), "vendors": listed("vendors"),
        "overlap/gap from previous chars": F.concat(shown("overlap_with_previous_chars"), F.lit(" / "), shown("gap_from_previous_chars")), "notes": F.when(F.size("notes") > 0, F.array_join("notes", ", ")).otherwise("none"),
    }
    lines = [F.concat(F.lit(f"- {k}: "), c) for k, c in fields.items()]
    body = F.coalesce(F.col("text"), F.lit(""))
    head = F.when(new, F.concat(F.lit("\n## "), plain("source"), F.lit("\n")))
    whole = F.concat_ws("\n", head, F.concat(F.lit("### "), F.col("index").cast("string"), F.lit(". "), plain("chunk_id")), F.lit(""), *lines, F.lit("\n```text"), body if full else text_preview(body, preview), F.lit("```\n"))
    return rows.select("index", whole.alias("markdown"))


def inspection_summary(audit: DataFrame, made: str) -> DataFrame:
    """(n, first, line): the head of the audit and a line for each source, the most
    frequent first (by falling n), then the first to appear."""
    sources = audit.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("n"), F.min("index").alias("first"))
    counts = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sources"))
    head = F.concat_ws("\n", F.lit("# Chunk Inspection\n"), F.lit(f"- generated_at: {made}"), F.concat(F.lit("- total_chunks: "), F.col("n").cast("string")), F.concat(F.lit("- sources: "), F.col("sources").cast("string")), F.lit("\n## Source Summary\n"))
    first = counts.select(F.lit(2**62).alias("n"), F.lit(0).cast("long").alias("first"), head.alias("line"))
    return first.unionByName(sources.select("n", F.col("first").cast("long").alias("first"), F.concat(F.lit("- "), "s", F.lit(": "), F.col("n").cast("string")).alias("line")))


def write_markdown(audit: DataFrame, path: str, preview: int = 400, full: bool = False, made: str = "") -> None:
    """Summary, then sections in order; Spark sorts by range, so no task holds them all."""
    head = inspection_summary(audit, made).select(F.lit(0).alias("part"), (-F.col("n")).alias("a"), F.col("first").alias("b"), "line")
    body = inspection_markdown(audit, preview, full).select(F.lit(1).alias("part"), F.col("index").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("markdown").alias("line"))
    head.unionByName(body).orderBy("part", "a", "b").select("line").write.mode("overwrite").text(path)


def script_json(df: DataFrame) -> DataFrame:
    """Rows as JSON that may stand inside a script element."""
    return df.select(F.replace(F.to_json(F.struct(*df.columns)), F.lit("</"), F.lit("<\\/")).alias("json"))


def printed(results: DataFrame) -> DataFrame:
    """(query_id, rank, line): a line with scores and metadata for each result."""
    score = lambda c: F.format_string("%.4f", F.coalesce(F.col(c), F.lit(0.0))) if c in results.columns else F.lit("0.0000")
    parts = [F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))]
    parts += [F.concat(F.lit(f"{label}="), score(f"{label}_score")) for label in ("rerank", "hybrid", "dense", "lexical")]
    parts += [F.concat(F.lit("source="), "source"), F.concat(F.lit("page="), page_label(F.col("start_page"), F.col("end_page")))]
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in results.columns else F.lit(None)
    parts += [F.concat(F.lit("section="), F.coalesce(has("section"), has("title"))), F.concat(F.lit("product="), has("product"))]
    parts += [F.when(F.size(c) > 0, F.concat(F.lit(f"{c}="), F.array_join(c, ","))) for c in ("product_codes", "text_product_codes", "source_product_codes", "chip_models", "vendors") if c in results.columns]
    parts += [F.when(F.col("version") != "", F.concat(F.lit("version="), "version"))] if "version" in results.columns else []
    parts += [F.when(F.col("is_adjacent"), F.lit("adjacent=true"))] if "is_adjacent" in results.columns else []
    return results.select("query_id", "rank", F.concat_ws(" ", *parts).alias("line"))
