"""Products: what the chunks of a product say together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import specs as S
from gleaner.functions import text as T
from gleaner.functions.display import BOOLEAN, LISTS, NUMERIC, format_spec, number, product_label


def with_key(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the label and the key of their product."""
    label = product_label(*(F.col(c) for c in ("source_product_codes", "product_codes", "text_product_codes", "source", "product", "chunk_id")))
    return chunks.withColumn("label", label).withColumn("key", F.upper("label"))


def rollup(chunks: DataFrame) -> DataFrame:
    """One row a product: key, label, product_codes, vendors, sources, specs (the
    largest number; true before false before unknown; ordered distinct lists with a
    chunk's chips before its systems), evidence (field -> source, page, snippet).
    ``chunks`` come in the order of their ``position``, products in none."""
    rows = with_key(chunks)
    none = F.array().cast("array<string>")
    codes = F.concat("product_codes", "text_product_codes", "source_product_codes")
    rows = rows.withColumn("codes", codes).withColumn("chips", F.concat("chip_models", F.coalesce("specs.cpu_soc", none)))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    made = [F.min_by("label", "position").alias("label"), F.min("position").alias("first"), union("codes").alias("product_codes"), union("vendors").alias("vendors"), F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("sources")]
    made += [F.max(f"specs.{f}").alias(f) for f in NUMERIC] + [F.bool_or(f"specs.{f}").alias(f) for f in BOOLEAN]
    whole = rows.groupBy("key").agg(*made)
    listed = listed_values(rows, {"cpu_soc": F.col("chips"), "os_list": F.col("specs.os_list"), "power_input": F.col("specs.power_input")})
    whole = whole.join(listed, "key", "left").withColumns({f: F.coalesce(f, none) for f in LISTS})
    whole = whole.select("key", "label", "product_codes", "vendors", "sources", F.struct(*NUMERIC, *BOOLEAN, *LISTS).alias("specs"), "first")
    return whole.join(evidence_of(rows), "key", "left").drop("first")


def listed_values(rows: DataFrame, fields: dict) -> DataFrame:
    """(key, one column a field): values in order of first appearance, once by lower
    case.  They are counted out per value before they meet in an array."""
    entries = F.array(*(F.struct(F.lit(f).alias("f"), v.alias("v")) for f, v in fields.items()))
    each = rows.select("key", "position", F.explode(entries).alias("e")).select("key", "position", "e.f", F.posexplode("e.v").alias("n", "v"))
    each = each.withColumn("v", F.btrim(T.collapse(F.col("v")), F.lit(" ,;/"))).where("v <> ''")
    once = each.groupBy("key", "f", F.lower("v").alias("k")).agg(F.min(F.struct("position", "n", "v")).alias("x"))
    lists = once.groupBy("key").pivot("f", list(fields)).agg(F.array_sort(F.collect_list("x")))
    return lists.select("key", *(F.transform(f, lambda x: x["v"]).alias(f) for f in fields))


def evidence_of(rows: DataFrame) -> DataFrame:
    """(key, evidence): snippets of each field in order, once for each source, page
    and snippet in lower case."""
    each = rows.select("key", "position", "source", "page", F.explode("spec_evidence").alias("field", "snippets"))
    each = each.select("key", "position", "source", "page", "field", F.posexplode("snippets").alias("n", "snippet")).withColumn("snippet", S.clean_evidence(F.col("snippet")))
    first = F.row_number().over(Window.partitionBy("key", "field", "source", "page", F.lower("snippet")).orderBy("position", "n"))
    once = each.withColumn("r", first).where("r = 1")
    fields = once.groupBy("key", "field").agg(F.array_sort(F.collect_list(F.struct("position", "n", F.struct("source", "page", "snippet").alias("e")))).alias("x"))
    fields = fields.select("key", "field", F.col("x.e").alias("e"))
    return fields.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "e")))).alias("evidence"))


def condition_fields(conditions: DataFrame) -> DataFrame:
    """(query_id, fields): the fields to show, cpu_soc first if no condition has it."""
    rows = conditions.where("field <> 'vendor'").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "field"))).alias("x"))
    rows = conditions.select("query_id").distinct().join(rows, "query_id", "left").select("query_id", F.coalesce(F.col("x.field"), F.array().cast("array<string>")).alias("f"))
    return rows.select("query_id", F.when(F.array_contains("f", "cpu_soc"), F.array_distinct("f")).otherwise(F.array_distinct(F.concat(F.array(F.lit("cpu_soc")), F.col("f")))).alias("fields"))


def structured_context(ranked: DataFrame, products: DataFrame, conditions: DataFrame, limit: int = 20, per_field: int = 2) -> DataFrame:
    """(query_id, context): the plan's conditions and the products that passed, in
    order, with up to ``per_field`` lines of evidence for each field."""
    amount = F.when(F.endswith("field", F.lit("_gb")), F.col("num_value").cast("string")).otherwise(number(F.col("num_value")))
    value = F.coalesce(amount, F.initcap(F.col("bool_value").cast("string")), "str_value")
    plan = conditions.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.format_string("- %s %s %s", "field", "op", value).alias("line")))).alias("p")).select("query_id", F.col("p.line").alias("plan"))
    shown = F.map_from_arrays(F.array(*(F.lit(f) for f in NUMERIC + BOOLEAN + LISTS)), F.array(*(format_spec(f, F.col(f"specs.{f}")) for f in NUMERIC + BOOLEAN + LISTS)))
    rows = ranked.where(F.col("place") <= limit).select("query_id", "place", "key").join(products, "key").join(condition_fields(conditions), "query_id").withColumn("shown", shown)
    specs = F.transform("fields", lambda f: F.concat(f, F.lit("="), F.element_at("shown", f)))
    vendor = F.when(F.size("vendors") > 0, F.array(F.concat(F.lit("vendor="), F.array_join("vendors", ", ")))).otherwise(F.array().cast("array<string>"))
    head = F.format_string("%d. %s: %s", "place", "label", F.array_join(F.concat(specs, vendor), ", "))

    def proof(f):
        some = F.slice(F.coalesce(F.element_at("evidence", f), F.array().cast("array<struct<source:string,page:int,snippet:string>>")), 1, per_field)
        return F.transform(some, lambda e: F.concat(F.lit("- "), f, F.lit(": "), e["source"], F.lit(" "), F.coalesce(F.concat(F.lit("p."), e["page"].cast("string")), F.lit("page unknown")), F.lit(": "), e["snippet"]))

    lines = F.array_join(F.concat(F.array(head), F.flatten(F.transform("fields", proof))), "\n")
    blocks = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", lines.alias("b")))).alias("x")).select("query_id", F.col("x.b").alias("blocks"))
    none = F.array(F.lit("- No product passed all structured conditions."))
    whole = F.concat(F.array(F.lit("Structured query plan:")), "plan", F.array(F.lit(""), F.lit("Filtered matching products:")), F.coalesce("blocks", none))
    return plan.join(blocks, "query_id", "left").select("query_id", F.array_join(whole, "\n").alias("context"))


