"""Display and metadata strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as T

NUMERIC = ("uart_count", "i2c_count", "spi_count", "can_count", "usb_count", "ethernet_count", "ram_gb", "flash_gb")
BOOLEAN = ("has_lvds", "has_mipi_dsi", "has_mipi_csi")
LISTS = ("cpu_soc", "os_list", "power_input")
SPECS = NUMERIC + BOOLEAN + LISTS
SPEC_TYPE = "struct<" + ",".join([f"{f}:{'double' if f.endswith('_gb') else 'int'}" for f in NUMERIC] + [f"{f}:boolean" for f in BOOLEAN] + [f"{f}:array<string>" for f in LISTS]) + ">"


def text_preview(c: Column, n: int) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, max(n - 16, 0)), r"(?U)\s+$", "")
    return F.when(F.length(c) > n, F.concat(cut, F.lit("\n...[truncated]"))).otherwise(c)


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def joined(values: Column, by: str = ", ") -> Column:
    """Non-blank values, stripped, in one string."""
    return F.array_join(F.filter(F.transform(values, lambda x: T.strip(x)), lambda x: x != ""), by)


def compact_list(c: Column, many: bool = True) -> Column:
    """The values of an array that are neither null nor empty, as strings in their order;
    of a single value (``many`` false) a list of it, if it is known.  Null gives an empty
    list."""
    values = c.cast("array<string>") if many else F.array(c.cast("string"))
    return F.coalesce(F.filter(values, lambda x: x != ""), F.array().cast("array<string>"))


def known_json(kinds: dict[str, str], columns: list[str] | tuple[str, ...]) -> Column:
    """A JSON object of the columns (types by name in ``kinds``, as ``dict(df.dtypes)``)
    that are known: null values and empty lists and maps are left out, nested values are
    written out whole, and columns that don't exist are passed over."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c].startswith(("array", "map")) else F.col(c)
    known = [some(c) for c in columns if c in kinds]
    return F.to_json(F.struct(*known)) if known else F.lit("{}")


def number(c: Column) -> Column:
    """A double without a useless fraction."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def specs_text(specs: Column) -> Column:
    """``field=value`` of the known specs, in field order."""
    parts = []
    for f in SPECS:
        v = specs[f]
        shown = joined(v) if f in LISTS else F.initcap(v.cast("string")) if f in BOOLEAN else v.cast("string")
        known = (F.size(v) > 0) if f in LISTS else v.isNotNull()
        parts.append(F.when(known & (shown != ""), F.concat(F.lit(f + "="), shown)))
    return F.concat_ws("; ", *parts)


def format_spec(field: str, value: Column) -> Column:
    if field in LISTS:
        return F.when(F.size(F.coalesce(value, F.array().cast("array<string>"))) == 0, "unknown").otherwise(F.array_join(value, ", "))
    if field.endswith("_gb"):
        return F.coalesce(F.concat(number(value), F.lit("GB")), F.lit("unknown"))
    if field in BOOLEAN:
        return F.when(value.isNull(), "unknown").when(value, "yes").otherwise("no")
    return F.coalesce(value.cast("string"), F.lit("unknown"))


def metadata_text(columns: list[str] | tuple[str, ...]) -> Column:
    """The text that is embedded, searched and reranked: labelled metadata lines,
    empty ones left out, then the content.  ``columns`` are those that exist."""
    labels = {"title": "Title", "section": "Section", "product": "Product", "product_codes": "Product codes", "text_product_codes": "Text product codes", "source_product_codes": "Source product codes", "chip_models": "Chip models", "vendors": "Vendors", "version": "Version", "doc_type": "Document type", "tags": "Tags", "specs": "Specs", "table_context": "Table context", "list_structure": "List structure", "text": "Content"}
    arrays = {"product_codes", "text_product_codes", "source_product_codes", "chip_models", "vendors", "tags"}

    def line(name: str) -> Column:
        value = joined(F.col(name)) if name in arrays else specs_text(F.col(name)) if name == "specs" else T.strip(F.col(name))
        return F.when(value != "", F.concat(F.lit(labels[name] + ": "), value))

    return F.concat_ws("\n", *(line(n) for n in labels if n in columns))


def boundary_notes(text: Column, start: Column, end: Column, table: Column, lists: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(T.strip(text) == "", F.lit("empty_text")),
            F.when(start.isNull() | end.isNull(), F.lit("missing_char_range")),
            F.when(text.rlike("^[A-Za-z0-9]"), F.lit("starts_with_word_char")),
            F.when(text.rlike(r"[A-Za-z0-9]\n?\z"), F.lit("ends_with_word_char")),
            F.when(table != "", F.concat(F.lit("table_context="), table)),
            F.when(lists != "", F.concat(F.lit("list_structure="), lists)),
        )
    )


def evidence_count(evidence: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(evidence), F.lit(0), lambda n, x: n + F.size(x)), F.lit(0))


def product_label(source_codes: Column, codes: Column, text_codes: Column, source: Column, product: Column, chunk_id: Column) -> Column:
    some = lambda c: F.nullif(T.first(c), F.lit(""))
    return F.coalesce(some(source_codes), some(codes), some(text_codes), F.nullif(T.stem(F.coalesce(source, F.lit(""))), F.lit("")), F.nullif(product, F.lit("")), chunk_id, F.lit("unknown"))


def identity_key(codes: Column, source: Column, chips: Column, chunk_id: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(codes, "|"), F.lit("")), F.nullif(source, F.lit("")), F.nullif(F.array_join(chips, "|"), F.lit("")), chunk_id)
