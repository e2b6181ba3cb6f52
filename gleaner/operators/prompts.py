"""Context blocks and prompts as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.display import joined, page_label, specs_text

# The prompts' wording.
ANSWER = (
    "You are a retrieval-augmented assistant. Answer only from the provided context. You must synthesize information across multiple contexts when needed instead of relying on a single chunk. If the evidence is incomplete or conflicting, say so explicitly.\n\n"
    "Question: ",
    "\n\nContext:\n",
    "\n\nInstructions:\n1. Read all contexts before answering.\n2. Merge adjacent or related contexts when the answer spans multiple chunks.\n3. Do not invent facts outside the context.\n4. Prefer the most specific evidence such as tables, lists, versions, and product names.\n5. If the question asks for product names or model names, extract only product/model names explicitly shown in the context. Do not answer unrelated specifications.\n6. If the answer cannot be fully supported, state what is missing.\n\nOutput in Traditional Chinese with this structure:\nAnswer: <direct answer>\nEvidence:\n- <source filename + page + concise supporting fact>\n- <source filename + page + concise supporting fact>\nNotes: <optional caveat or missing information>",
)
STRUCTURED = (
    "You are a retrieval-augmented assistant. The system has already converted the user's question into structured conditions and already filtered the product list with program logic. Do not decide whether a product qualifies; only format and explain the filtered products below.\n\nQuestion: ",
    "\n\nStructured context:\n",
    "\n\nRules for comparison and recommendation questions:\n1. If the question asks to list products, return a concise product list from all provided structured context rows.\n2. List only products that are explicitly in 'Filtered matching products'.\n3. Do not recommend products that failed or are missing from the filtered list.\n4. Every product or recommendation must include the matching specification evidence.\n5. If no product passed the structured filter, say no clearly supported match was found.\n6. Do not invent specifications outside the structured context.\n\nOutput in Traditional Chinese with this structure:\nAnswer: <direct answer>\nProducts:\n- <product>: <why it matches, with exact specs>\nEvidence:\n- <source filename + page + concise supporting fact>\nNotes: <optional caveat or missing information>",
)


def prompt(question: Column, context: Column, structured: bool = False) -> Column:
    head, middle, tail = STRUCTURED if structured else ANSWER
    return F.concat(F.lit(head), question, F.lit(middle), context, F.lit(tail))


def block(columns: list[str], number: Column) -> Column:
    """One result as a block of labelled lines; ``columns``: those it has."""
    c = lambda name: F.col(name) if name in columns else F.lit(None).cast("string")
    has = lambda v: F.when(F.coalesce(v, F.lit("")) != "", v)
    line = lambda label, v: F.concat(F.lit(label + ": "), v)
    arrays = [line(a, has(joined(F.col(a)))) for a in ("product_codes", "text_product_codes", "source_product_codes", "chip_models", "vendors") if a in columns]
    first, last = (F.coalesce(F.col(x), F.col("page")) if x in columns else F.col("page") for x in ("start_page", "end_page"))
    role = F.coalesce(has(c("retrieval_role")), F.when(F.coalesce(c("is_adjacent").cast("boolean"), F.lit(False)), F.lit("adjacent_supporting_chunk")))
    lines = [
        F.concat(F.lit("[Context "), number.cast("string"), F.lit("]")),
        line("source", c("source")),
        line("page", page_label(first, last)),
        line("section", F.coalesce(has(c("section")), has(c("title")))),
        line("product", has(c("product"))),
        *arrays,
        line("version", has(c("version"))),
        *([line("specs", has(specs_text(F.col("specs"))))] if "specs" in columns else []),
        line("heading_level", c("heading_level").cast("string")),
        line("list_structure", has(c("list_structure"))),
        line("table_context", has(c("table_context"))),
        line("char_range", F.concat(c("char_start").cast("string"), F.lit("-"), c("char_end").cast("string"))),
        line("context_id", has(c("context_id"))),
        *([line("matched_child_ids", has(F.array_join("matched_child_ids", ", ")))] if "matched_child_ids" in columns else []),
        line("retrieval_role", role),
        line("matched_child_text", F.when(c("child_text") != c("text"), has(c("child_text")))),
        line("text", F.coalesce(c("text"), F.lit(""))),
    ]
    return F.concat_ws("\n", *lines)


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context): the blocks of each query by ``rank``, an empty line
    between them."""
    rows = results.select("query_id", "rank", block(results.columns, F.col("rank")).alias("block"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("x")).select("query_id", F.array_join(F.col("x.block"), "\n\n").alias("context"))
