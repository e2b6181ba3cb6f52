"""Command lines: ``python -m gleaner.cli chunk|embed|index|ask|evaluate|inspect|preview``.

``ask`` takes questions from its arguments, or one after the other from the terminal.
Encoder, reranker and language model are the services' defaults unless an
address of a chat service is given.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.display import metadata_text
from gleaner.operators import evaluate, inspect
from gleaner.plans import reports, retrieve
from gleaner.session import session
from gleaner.sources import files, services

FORMATS = ("flat", "collection")


def _search_options(p: argparse.ArgumentParser) -> None:
    o = retrieve.Options()
    for name, value in (("top-k", o.top_k), ("product-list-top-k", o.listing_k), ("dense-top-k", o.dense_k), ("hybrid-top-k", o.hybrid_k), ("adjacent-window", o.window), ("parent-context-tokens", o.context_tokens)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--chunks", required=True, help="chunk table (Parquet)")
    p.add_argument("--vectors", help="vectors that embed wrote; encoded anew if absent")
    p.add_argument("--measure", choices=("ip", "l2"), default=o.measure, help="ip as in a flat index, l2 as in a collection")
    p.add_argument("--disable-hybrid", action="store_true")
    p.add_argument("--disable-rerank", action="store_true")


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="gleaner", description=__doc__.splitlines()[0])
    sub = main.add_subparsers(dest="command", required=True)
    chunk = sub.add_parser("chunk", help="pages or PDF files to a chunk table")
    embed = sub.add_parser("embed", help="chunks to vectors")
    index = sub.add_parser("index", help="chunks and vectors to a search index")
    given = chunk.add_mutually_exclusive_group(required=True)
    given.add_argument("--pages", help="JSON lines of pages")
    given.add_argument("--docs", help="folder of PDF files")
    for p, needs in ((chunk, ("out",)), (embed, ("chunks", "out")), (index, ("chunks", "vectors", "out"))):
        for name in needs:
            p.add_argument(f"--{name}", required=True)
    embed.add_argument("--batch-size", type=int, default=32)
    index.add_argument("--backend", choices=FORMATS, default="flat")
    ask = sub.add_parser("ask", help="answer questions")
    ask.add_argument("question", nargs="*")
    ask.add_argument("--interactive", "-i", action="store_true")
    ask.add_argument("--service", help="address of a chat service; without one, prompts are printed")
    ask.add_argument("--model")
    ask.add_argument("--timeout", type=float, default=1200.0)
    for flag in ("retrieval-only", "no-print-results", "debug-retrieval", "disable-structured-filter"):
        ask.add_argument(f"--{flag}", action="store_true")
    ask.add_argument("--debug-dir", default="debug")
    ask.add_argument("--structured-product-limit", type=int, default=20)
    judge = sub.add_parser("evaluate", help="retrieval quality over a data set (JSON lines)")
    judge.add_argument("--dataset", required=True)
    judge.add_argument("--output")
    for p in (ask, judge):
        _search_options(p)
    audit = sub.add_parser("inspect", help="audit of a chunk table")
    audit.add_argument("--format", choices=("md", "jsonl"), default="md")
    audit.add_argument("--preview-chars", type=int, default=1400)
    audit.add_argument("--include-full-text", action="store_true")
    preview = sub.add_parser("preview", help="chunks as JSON for a browser page")
    for p in (audit, preview):
        p.add_argument("--chunks", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--source")
        p.add_argument("--limit", type=int)
    return main


def _chosen(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = spark.read.parquet(args.chunks)
    rows = rows.where(F.col("source") == args.source) if args.source else rows
    return rows.orderBy("position").limit(args.limit) if args.limit else rows


def _options(args: argparse.Namespace) -> retrieve.Options:
    return retrieve.Options(args.top_k, args.dense_top_k, args.hybrid_top_k, args.product_list_top_k, args.adjacent_window, args.parent_context_tokens, getattr(args, "structured_product_limit", 20), args.measure, not args.disable_hybrid, not args.disable_rerank)


def search(spark: SparkSession, asked: list[str], args: argparse.Namespace) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The questions as a table, the chunks, and the stages' results."""
    chunks = spark.read.parquet(args.chunks)
    vectors = files.read_vectors(spark, args.vectors).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector")) if args.vectors else chunks.select("id", services.encode(metadata_text(chunks.columns)).alias("vector"))
    rows = spark.createDataFrame(list(enumerate(asked, 1)), "query_id int, question string")
    questions = rows.withColumn("vector", services.encode(F.col("question")))
    return rows, chunks, retrieve.retrieve(questions, chunks, vectors, _options(args))


def _staged(stages: dict[str, DataFrame]) -> DataFrame:
    """The results of all stages with their rank in it."""
    out = None
    for name, rows in stages.items():
        rank = "rank" if "rank" in rows.columns else f"{name}_rank"
        own = rows.withColumn("stage", F.lit(name)).withColumn("rank", F.col(rank).cast("int"))
        if "chunk_id" not in own.columns and "id" in own.columns:
            own = own.withColumn("chunk_id", F.col("id"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def answer(spark: SparkSession, asked: list[str], args: argparse.Namespace) -> None:
    questions, chunks, stages = search(spark, asked, args)
    options = _options(args)
    filtered = None if args.disable_structured_filter else retrieve.structured_filter(questions, chunks, stages, options)
    if not args.no_print_results:
        for r in files.printed(stages["final"]).orderBy("query_id", "rank").toLocalIterator():
            print(r["line"])
        if filtered is not None:
            for r in reports.printed_products(filtered.ranked, filtered.products, filtered.conditions).orderBy("query_id", "place").toLocalIterator():
                print(r["line"])
    if args.debug_retrieval:
        now = datetime.now(timezone.utc)
        none = spark.createDataFrame([], "query_id int, ord int, field string, op string, num_value double, bool_value boolean, str_value string, text string"), spark.createDataFrame([], "query_id int, place int, key string, label string")
        conditions, ranked = (filtered.conditions, filtered.ranked) if filtered else none
        told = {k: v for k, v in vars(args).items() if k != "question"}
        payloads = reports.trace(questions, _staged(stages), conditions, ranked, told, now.isoformat(timespec="seconds"))
        reports.write_trace(payloads, args.debug_dir, now.strftime("%Y%m%d_%H%M%S_%f"))
    if args.retrieval_only:
        return
    prompts = retrieve.answer_prompts(questions, stages["final"], filtered, options)
    if args.service:
        told = services.answers(prompts.select("query_id", "prompt"), services.ChatService(args.service, args.model or "", args.timeout))
        for r in told.orderBy("query_id").toLocalIterator():
            print(r["answer"])
    else:
        for r in prompts.orderBy("query_id").toLocalIterator():
            print(r["prompt"])


def interactive(spark: SparkSession, args: argparse.Namespace, read=input) -> None:
    """Questions from the terminal until it ends or says exit, quit or q."""
    while True:
        try:
            question = read("Question> ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if question.lower() in ("exit", "quit", "q"):
            return
        if question:
            answer(spark, [question], args)


def judged(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Ranks of the data set's questions in each stage; writes the report if asked to."""
    target = evaluate.TARGET
    rows = files.read_jsonl(spark, args.dataset, f"query string, targets array<struct<{', '.join(f'{a}:{b}' for a, b in (x.strip().split(' ', 1) for x in target.split(', ')))}>>")
    asked = [(r["query"], r["targets"]) for r in rows.collect()]  # the questions to ask
    questions, _, stages = search(spark, [q for q, _ in asked], args)
    targets = spark.createDataFrame([(i, t) for i, (_, ts) in enumerate(asked, 1) for t in ts or ()], f"query_id int, t struct<{rows.schema['targets'].dataType.elementType.simpleString()[7:-1]}>").select("query_id", "t.*")
    named = spark.createDataFrame([(s,) for s in reports.STAGES], "stage string")
    results = _staged(stages)
    ranks = evaluate.first_ranks(results, targets, named, evaluate.checked_targets(targets, questions))
    if args.output:
        reports.write_report(ranks, questions.withColumnRenamed("question", "query"), results, args.output)
    return ranks


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "chunk":
        pages = files.read_pdfs(spark, args.docs) if args.docs else files.clean_pages(files.read_jsonl(spark, args.pages, files.PAGE))
        retrieve.indexed(retrieve.chunks_of(pages)).write.mode("overwrite").parquet(args.out)
    elif args.command == "embed":
        chunks = spark.read.parquet(args.chunks)
        files.write_vectors(chunks.select("chunk_id", services.encode(metadata_text(chunks.columns), batch=args.batch_size).alias("embedding")), args.out)
    elif args.command == "index":
        write = files.write_flat_index if args.backend == "flat" else files.write_collection
        write(spark.read.parquet(args.chunks), spark.read.parquet(args.vectors), args.out)
    elif args.command == "ask":
        if args.interactive or not args.question:
            interactive(spark, args)
        else:
            answer(spark, args.question, args)
    elif args.command == "evaluate":
        for r in evaluate.stage_summary(judged(spark, args)).collect():  # four rows
            print(" ".join(f"{k}={v}" for k, v in r.asDict().items()))
    elif args.command == "inspect":
        audit = inspect.inspection(_chosen(spark, args))
        if args.format == "md":
            files.write_markdown(audit, args.out, args.preview_chars, args.include_full_text, datetime.now(timezone.utc).isoformat(timespec="seconds"))
        else:
            files.write_jsonl(audit, args.out)
    else:
        files.script_json(_chosen(spark, args)).write.mode("overwrite").text(args.out)


def main(argv: list[str] | None = None) -> None:
    run(parser().parse_args(argv), session("gleaner"))


if __name__ == "__main__":
    main()
