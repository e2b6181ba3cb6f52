"""Token-budget splitting with overlap: truly sequential, so a Python worker does it,
batch by batch.  Everything around it is DataFrame code."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from gleaner.functions import text as T
from gleaner.operators.pages import pages_of_spans

# Fixed values.
CHILD, CHILD_OVERLAP, PARENT, PARENT_OVERLAP = 320, 50, 850, 100
SEPARATORS = ("\n\n", "\n", "Q:", "A:", "Question:", "Answer:", ". ", "; ", ", ", " ")
TOKEN = re.compile(r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[一-鿿]|\S")
FAQ = r"(?ms)^\s*(?:[Qq]|[Qq][Uu][Ee][Ss][Tt][Ii][Oo][Nn])\s*[:：]\s*(.*?)^\s*(?:[Aa]|[Aa][Nn][Ss][Ww][Ee][Rr])\s*[:：]\s*(.*?)(?=^\s*(?:[Qq]|[Qq][Uu][Ee][Ss][Tt][Ii][Oo][Nn])\s*[:：]|\z)"


@dataclass(frozen=True)
class Budget:
    size: int
    overlap: int
    separators: tuple[str, ...] = SEPARATORS

    @property
    def least(self) -> int:
        """Tokens before which no natural end is looked for."""
        return max(20, int(self.size * 0.55))


def trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span without white space at its ends; None if nothing is left."""
    part = text[start:end]
    lead = len(part) - len(part.lstrip())
    body = part.strip()
    return (start + lead, start + lead + len(body)) if body else None


def _natural_end(text: str, starts: list[int], low: int, high: int, first: int, budget: Budget) -> int | None:
    """Index of the token after the last separator, of the first kind that ends
    between the characters low and high."""
    window = text[low:high]
    for separator in budget.separators:
        at = -1
        for found in re.finditer(re.escape(separator), window):
            at = found.end()
        if at > 0 and (index := bisect_left(starts, low + at)) > first:
            return index
    return None


def split_spans(text: str, budget: Budget) -> list[tuple[int, int]]:
    """Spans of at most ``budget.size`` tokens; the next one starts ``overlap``
    tokens before the end of the last.  A text within the budget is one span."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    if len(tokens) <= budget.size:
        whole = trimmed(text, 0, len(text)) if tokens else None
        return [whole] if whole else []
    starts = [a for a, _ in tokens]
    out, first = [], 0
    while True:
        most = first + budget.size
        if most >= len(tokens):
            end = len(tokens)
        else:
            least = min(first + max(budget.least, 1), most)
            end = _natural_end(text, starts, tokens[least - 1][1], tokens[most - 1][1], first, budget) or most
        span = trimmed(text, tokens[first][0], tokens[end - 1][1])
        if span:
            out.append(span)
        if end >= len(tokens):
            return out
        first = max(end - budget.overlap, first + 1)


def recursive_spans(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans of at most ``size`` characters: cut at the first separator that the
    text has, pieces packed together, longer pieces cut further; characters at last."""

    def cut(start: int, end: int, rest: tuple[str, ...]) -> list[tuple[int, int]]:
        if end - start <= size:
            return [(start, end)]
        if not rest:
            return [(i, min(i + size, end)) for i in range(start, end, size)]
        ends = [m.end() + start for m in re.finditer(re.escape(rest[0]), text[start:end])]
        if not ends:
            return cut(start, end, rest[1:])
        out, at = [], start
        for a, b in zip([start, *ends], [*ends, end], strict=True):
            if b - at > size and a > at:
                out += cut(at, a, rest[1:])
                at = a
        return out + (cut(at, end, rest[1:]) if at < end else [])

    return [s for s in (trimmed(text, a, b) for a, b in cut(0, len(text), separators)) if s]


def aligned(text: str, start: int, limit: int = 40) -> int:
    """The nearest boundary of a word: ``start`` itself if white space is on either
    side of it, else up to ``limit`` characters back, else ahead."""
    if not 0 < start < len(text):
        return min(max(start, 0), len(text))
    low, high = max(start - limit, 0), start + limit
    spaces = [i for i, c in enumerate(text[low:high], low) if c.isspace()]
    if start in spaces or start - 1 in spaces:
        return start
    behind = [i for i in spaces if i < start]
    found = behind[-1:] or spaces[:1]
    return found[0] + 1 if found else start


def overlapped(text: str, spans: list[tuple[int, int]], overlap: int) -> list[tuple[int, int]]:
    """Each span but the first with up to ``overlap`` characters before it."""
    return [s if i == 0 else (min(aligned(text, max(s[0] - overlap, 0)), s[0]), s[1]) for i, s in enumerate(spans)]


def split_texts(rows: DataFrame, budget: Budget, name: str) -> DataFrame:
    """Each row of ``rows`` (with ``text`` and ``start``, its offset) once for each
    of its spans: columns <name>_no, <name>_start, <name>_end, <name>_text."""
    kept = rows.columns
    at_text, at_start = kept.index("text"), kept.index("start")
    made = [StructField(f"{name}_{c}", StringType() if c == "text" else IntegerType()) for c in ("no", "start", "end", "text")]
    schema = StructType([*rows.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, no, start, end, body = [], [], [], [], []
            for i, (text, offset) in enumerate(zip(batch.column(at_text).to_pylist(), batch.column(at_start).to_pylist(), strict=True)):
                for k, (a, b) in enumerate(split_spans(text or "", budget), 1):
                    owner.append(i)
                    no.append(k)
                    start.append(offset + a)
                    end.append(offset + b)
                    body.append(text[a:b])
            taken = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(batch.num_columns)]
            made = [pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(body, pa.string())]
            yield pa.RecordBatch.from_arrays(taken + made, [*kept, f"{name}_no", f"{name}_start", f"{name}_end", f"{name}_text"])

    return rows.mapInArrow(run, schema)


#: What names a parent's row, and what it holds besides.
PARENT_KEY = ["source", "section_no", "p_no"]
PARENT_FACTS = ["parent_section", "parent_heading_level", "parent_char_start", "parent_char_end", "parent_text", "question", "answer"]


def parents_of(sections: DataFrame, parent: Budget = Budget(PARENT, PARENT_OVERLAP)) -> DataFrame:
    """Parents of sections with their texts: PARENT_KEY and PARENT_FACTS."""
    base = sections.select("source", "section_no", F.col("section").alias("parent_section"), F.col("heading_level").alias("parent_heading_level"), "start", "text")
    none = F.lit(None).cast("string")
    rows = split_texts(base, parent, "p").withColumnsRenamed({"p_start": "parent_char_start", "p_end": "parent_char_end", "p_text": "parent_text"})
    return rows.withColumns({"question": none, "answer": none}).select(*PARENT_KEY, *PARENT_FACTS)


def children_of(parents: DataFrame, page_spans: DataFrame, child: Budget = Budget(CHILD, CHILD_OVERLAP)) -> DataFrame:
    """Children of ``parents``, a written table, by numbers alone: their parents' key,
    number, pages and id, and their own numbers and offsets.  child_text() reads the text."""
    number = parents.select(*PARENT_KEY, "parent_char_start", "parent_char_end").withColumn("parent_index", F.row_number().over(Window.partitionBy("source").orderBy("section_no", "p_no")))
    number = pages_of_spans(number, page_spans, "parent_char_start", "parent_char_end", ("parent_start_page", "parent_end_page"))
    number = number.withColumn("parent_id", F.format_string("%s-p%d-%d-parent-%d", "source", "parent_start_page", "parent_end_page", "parent_index"))
    spans = split_texts(parents.select(*PARENT_KEY, F.col("parent_text").alias("text"), F.col("parent_char_start").alias("start")), child, "c")
    spans = spans.select(F.struct(*PARENT_KEY).alias("key"), F.col("c_no").alias("parent_child_index"), F.col("c_start").alias("char_start"), F.col("c_end").alias("char_end"))
    counts = F.count("*").over(Window.partitionBy("key")).cast("int")
    rows = number.withColumn("key", F.struct(*PARENT_KEY)).drop("parent_char_start", "parent_char_end").join(spans.withColumn("parent_child_count", counts), "key").drop("key")
    return rows.select(*CHILD_NUMBERS)


#: Columns of children_of().
CHILD_NUMBERS = [*PARENT_KEY, "parent_index", "parent_start_page", "parent_end_page", "parent_id", "parent_child_index", "parent_child_count", "char_start", "char_end"]


def child_text() -> Column:
    """The text of a child that stands beside its parent; that of a question and answer is
    its parent's."""
    inside = F.substring("parent_text", F.col("char_start") - F.col("parent_char_start") + 1, F.col("char_end") - F.col("char_start"))
    return F.when(F.col("question").isNotNull(), F.col("parent_text")).otherwise(inside)


def faq_pairs(documents: DataFrame) -> DataFrame:
    """(source, pair_no, question, answer, text) of ``Q: … A: …`` pairs; blank ones
    are dropped.  Native: two extractions with one pattern, zipped."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(FAQ), F.lit(1)).alias("q"), F.regexp_extract_all("text", F.lit(FAQ), F.lit(2)).alias("a"))
    rows = documents.select("source", F.posexplode(pairs).alias("pos", "pair")).select("source", "pos", T.normalize(F.col("pair.q")).alias("question"), T.normalize(F.col("pair.a")).alias("answer"))
    rows = rows.where("question <> '' and answer <> ''")
    number = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    return rows.select("source", number.alias("pair_no"), "question", "answer", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("text"))


def faq_spans(documents: DataFrame, page_spans: DataFrame) -> DataFrame:
    """faq_pairs() as PARENT_FACTS and CHILD_NUMBERS, each pair its own parent and only
    child; offsets are those of the raw match."""
    between = F.split("text", FAQ, -1)
    found = F.regexp_extract_all("text", F.lit(FAQ), F.lit(0))
    raw = documents.select("source", F.posexplode(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))).alias("pos", "x"))
    upto = Window.partitionBy("source").orderBy("pos")
    raw = raw.withColumn("char_end", F.sum(F.col("x.b") + F.col("x.m")).over(upto).cast("int"))
    raw = raw.select("source", F.row_number().over(upto).alias("raw_no"), (F.col("char_end") - F.col("x.m")).alias("char_start"), "char_end")
    texts = F.arrays_zip(F.regexp_extract_all("text", F.lit(FAQ), F.lit(1)).alias("q"), F.regexp_extract_all("text", F.lit(FAQ), F.lit(2)).alias("a"))
    pairs = documents.select("source", F.posexplode(texts).alias("pos", "pair")).select("source", (F.col("pos") + 1).alias("raw_no"), T.normalize(F.col("pair.q")).alias("question"), T.normalize(F.col("pair.a")).alias("answer")).where("question <> '' and answer <> ''")
    rows = pairs.join(raw, ["source", "raw_no"]).withColumn("parent_index", F.row_number().over(Window.partitionBy("source").orderBy("raw_no")))
    rows = rows.withColumn("text", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer"))
    rows = pages_of_spans(rows, page_spans, out=("parent_start_page", "parent_end_page"))
    return rows.select(
        "source", F.col("parent_index").alias("section_no"), F.lit(1).alias("p_no"), F.lit("").alias("parent_section"), F.lit(0).alias("parent_heading_level"), "parent_index", F.col("char_start").alias("parent_char_start"), F.col("char_end").alias("parent_char_end"), F.col("text").alias("parent_text"),
        "parent_start_page", "parent_end_page", F.format_string("%s-p%d-%d-faq-parent-%d", "source", "parent_start_page", "parent_end_page", "parent_index").alias("parent_id"), F.lit(1).alias("parent_child_index"), "char_start", "char_end", F.lit(1).alias("parent_child_count"), "question", "answer",
    )
