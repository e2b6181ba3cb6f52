"""Text functions: Column in, Column out, no Python worker.

Lines end at ``\\n``.  White space is what ``str.isspace`` takes for it, so patterns
use Unicode classes (``(?U)``) and name the four separators Java leaves out.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define the results.
BLANK = r"\s\x1c-\x1f"
LENGTH_TOKEN = r"(?U)[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[\x{4e00}-\x{9fff}]|[^\s\x1c-\x1f]"
WORD_TOKEN = r"[a-z0-9][a-z0-9._/-]*"
CJK_RUN = r"[\x{4e00}-\x{9fff}]{1,4}"
NUMBERED_HEADING = r"^\s*(?:\d+(?:\.\d+)+[.)]?|\d+[.)])\s+.{3,80}$"
CHAPTER_HEADING = r"(?i)^\s*(?:chapter|section)\s+\d+[:.)]?\s+.{3,80}$"
DOCUMENT_KEYWORDS = ("hardware", "software", "features", "specifications", "dimensions", "block diagram")
SECTION_KEYWORDS = (*DOCUMENT_KEYWORDS, "i/o", "display", "memory", "cpu")
QUANTITY_LINE = r"(?i)^\d+(?:\.\d+)?\s*(?:inch|inches|mm|cm|v|hz|khz|mhz|ghz|gb|mb)\b"
BULLET = r"^(?:[-*•]|[0-9]+[.)]|[A-Za-z][.)])\s+"
PAGE_NUMBER = r"(?i)^(?:page\s*)?\d+\s*(?:/|of)\s*\d+$"
CONFIDENTIAL = ("confidential", "company confidential")
VERSIONS = (r"(?i)\bFW\s*v?\d+(?:\.\d+){1,3}\b", r"(?i)\bFirmware\s*v?\d+(?:\.\d+){1,3}\b", r"(?i)\bYocto\s+\d+(?:\.\d+){1,2}\b", r"(?i)\bAndroid\s+\d+(?:\.\d+){0,2}\b", r"(?i)\bv\d+(?:\.\d+){1,3}\b")
TAGS = {
    "firmware": r"\b(?:firmware|fw)\b",
    "upgrade": r"\b(?:upgrade|update)\b",
    "hardware": r"\bhardware\b",
    "software": r"\bsoftware\b",
    "ethernet": r"\bethernet\b",
    "usb": r"\busb\b",
    "display": r"\b(?:display|hdmi|lvds|mipi|dsi)\b",
    "camera": r"\b(?:camera|csi)\b",
    "memory": r"\b(?:memory|ram|flash|emmc)\b",
    "power": r"\bpower\b",
    "gpio": r"\bgpio",
}
PRODUCT_CODE = r"(?i)\bP\d{2}D\d{5}(?:-\d{2})?(?:-[A-Z0-9]+)?\b"
CHIP = r"(?i)\b(?:RK\d{4}[A-Z0-9]*|STM32[A-Z0-9]+|RTL\d+[A-Z0-9]*|RZ/[A-Z0-9]+)\b"
IMX = r"(?U)\bi\.MX[0-9A-Za-z]+(?:\s+\w+)?\b"
LIST_INTENT = r"(?i)(產品|型號|有哪些|列出|尋找|list|which|what|product|model)"
VENDORS = ("NXP", "Rockchip", "ST", "Realtek", "Renesas")

_NO_STRINGS = "array<string>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The signs of [BLANK] under (?U): those a pattern has to look for at every place.
BLANKS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def swap(c: Column, old: str, new: str) -> Column:
    """translate() of a few rare signs: a text without them is only searched."""
    for a, b in zip(old, new, strict=True):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, rf"(?U)[{BLANK}]+", " ")


def normalize(c: Column) -> Column:
    """Cleaned text: plain line ends and spaces, no hyphenation at line ends, no
    more than one empty line in a row, no space around lines or text."""
    c = swap(c, " ", " ")
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    return strip(c)


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def first(values: Column) -> Column:
    """First element, or an empty string."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def unique(values: Column, key=F.upper) -> Column:
    """Ordered distinct values by ``key``, white space collapsed, blanks dropped."""
    clean = F.filter(F.transform(values, lambda x: strip(collapse(x))), lambda x: x != "")
    add = lambda seen, x: F.when(F.exists(seen, lambda y: key(y) == key(x)), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(clean, F.array().cast("array<string>"), add)


def count_length_tokens(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(LENGTH_TOKEN)), F.lit(0))


def length_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LENGTH_TOKEN), F.lit(0))


def lexical_tokens(c: Column) -> Column:
    """Lower-case words, then runs of up to four CJK characters."""
    return F.concat(F.regexp_extract_all(F.lower(c), F.lit(WORD_TOKEN), F.lit(0)), F.regexp_extract_all(c, F.lit(CJK_RUN), F.lit(0)))


def _heading(line: Column, keywords: tuple[str, ...]) -> Column:
    def shaped(line: Column) -> Column:
        like = line.rlike(NUMBERED_HEADING) | line.rlike(CHAPTER_HEADING) | F.lower(line).isin(*keywords)
        return (line != "") & (F.length(line) <= 100) & ~line.rlike(QUANTITY_LINE) & like

    return let(strip(line), shaped)


def is_section_heading(line: Column) -> Column:
    return _heading(line, SECTION_KEYWORDS)


def is_document_heading(line: Column) -> Column:
    return _heading(line, DOCUMENT_KEYWORDS)


def section_of(c: Column) -> Column:
    """First heading line, up to 120 characters, else empty."""
    return F.substring(first(F.filter(lines(c), is_section_heading)), 1, 120)


def title_of(c: Column) -> Column:
    """First heading line, else the first line, up to 120 characters."""
    own = lambda rows: F.concat(F.slice(F.filter(rows, is_section_heading), 1, 1), F.slice(rows, 1, 1))
    return F.substring(first(let(lines(c), own)), 1, 120)


def heading_level(c: Column) -> Column:
    def level(line: Column) -> Column:
        number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)", 1)
        capitals = (F.upper(line) == line) & (F.lower(line) != line) & (F.size(F.split(collapse(line), " ")) <= 8)
        return F.when(line == "", 0).when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).when(capitals, 1).when(is_section_heading(line), 2).otherwise(0)

    return let(first(lines(c)), level)


def list_structure(c: Column) -> Column:
    n = F.size(F.filter(lines(c), lambda x: x.rlike(BULLET)))
    return F.when(n >= 3, "list").when(n >= 1, "mixed").otherwise("")


def table_context(c: Column) -> Column:
    rows = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    pipes = F.size(F.filter(rows, lambda x: F.contains(x, F.lit("|"))))
    spaced = F.size(F.filter(rows, lambda x: x.rlike(r"(?U)\S\s{2,}\S")))
    return F.when(F.contains(c, F.lit("[TABLE")), "extracted_table").when((pipes >= 2) | (spaced >= 3), "table_like_layout").otherwise("")


def stem(path: Column) -> Column:
    """File name without folders and its last suffix."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def doc_type(path: Column) -> Column:
    name = F.lower(stem(F.coalesce(path, F.lit(""))))
    return F.when(F.contains(name, F.lit("faq")), "faq").when(F.contains(name, F.lit("manual")), "manual").when(name.rlike(r"p\d{2}d\d+"), "datasheet").otherwise("document")


def product_codes(c: Column) -> Column:
    return unique(F.transform(F.regexp_extract_all(c, F.lit(PRODUCT_CODE), F.lit(0)), F.upper))


def chip_models(c: Column) -> Column:
    chips = F.transform(F.regexp_extract_all(c, F.lit(CHIP), F.lit(0)), F.upper)
    return unique(F.concat(chips, F.regexp_extract_all(c, F.lit(IMX), F.lit(0))))


def requested_chips(question: Column) -> Column:
    chips = F.transform(F.regexp_extract_all(question, F.lit(CHIP), F.lit(0)), F.upper)
    return F.array_distinct(F.concat(chips, F.regexp_extract_all(question, F.lit("(?i)" + IMX), F.lit(0))))


#: Vendors that are found by name.
NAMED_VENDORS = {v: rf"(?i)\b{v}\b" for v in ("ST", "Rockchip", "NXP")}


def vendors_of(c: Column, chips: Column, around: dict[str, Column] | None = None) -> Column:
    """Vendors that the text names or its chips belong to, in a fixed order.  ``around``:
    whether another text names those of NAMED_VENDORS, if it counts too."""
    names = {v: c.rlike(p) if around is None else around[v] | c.rlike(p) for v, p in NAMED_VENDORS.items()}
    starts = lambda p: F.exists(chips, lambda m: F.startswith(m, F.lit(p)))
    imx = F.exists(chips, lambda m: F.startswith(F.lower(m), F.lit("i.mx")))
    tests = {"ST": names["ST"] | starts("STM32"), "Rockchip": names["Rockchip"] | starts("RK"), "NXP": names["NXP"] | imx, "Realtek": starts("RTL"), "Renesas": starts("RZ/")}
    return F.array_compact(F.array(*(F.when(test, F.lit(v)) for v, test in tests.items())))


def primary_product(chips: Column, vendors: Column, codes: Column) -> Column:
    chip = first(chips)
    of_st = (first(vendors) == "ST") & F.startswith(chip, F.lit("STM32"))
    return F.when(chip != "", F.when(of_st, F.concat(F.lit("ST "), chip)).otherwise(chip)).otherwise(first(codes))


def version(c: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in VERSIONS), F.lit(""))


def possible_tags(c: Column) -> Column:
    """Tags of which a word is in the text, within another one or not: parts of it have no
    others."""
    words = {t: re.sub(r"\\b|[(?:)]", "", p).split("|") for t, p in TAGS.items()}
    named = lambda low: F.array(*(F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in ws)), F.lit(t)) for t, ws in words.items()))
    return F.array_compact(let(F.lower(c), named))


def tags(c: Column, among: Column | None = None) -> Column:
    """``among``: tags that are looked for, all by default."""
    asked = lambda t, p: c.rlike("(?i)" + p) if among is None else F.array_contains(among, t) & c.rlike("(?i)" + p)
    return F.array_compact(F.array(*(F.when(asked(t, p), F.lit(t)) for t, p in TAGS.items())))


def language(c: Column) -> Column:
    cjk, ascii_ = F.regexp_count(c, F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (cjk >= ascii_ * 0.2), "zh").otherwise("en")


def wants_list(question: Column) -> Column:
    return question.rlike(LIST_INTENT)


def keyword_mentions(question: Column, vendors: Column) -> Column:
    """Vendors (longest first) that the question names as whole ASCII words."""
    clean = F.array_sort(unique(vendors, F.lower), lambda a, b: F.length(b) - F.length(a))
    quoted = lambda v: F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(v), F.lit(r"\E(?![a-z0-9])"))
    return F.filter(clean, lambda v: F.rlike(F.lower(question), quoted(v)))


def table_rows(table: Column, index: Column) -> Column:
    """A table (array of rows of cells) as lines ``header: cell`` under row marks.
    Lambdas name what they read as often as it has rows and cells, so each step is a
    value of its own (``let``): every cell is cleaned once."""
    cells = F.transform(table, lambda row: F.transform(row, lambda x: normalize(F.coalesce(x, F.lit("")))))
    filled = F.filter(cells, lambda row: F.exists(row, lambda x: x != ""))

    def sized(rows: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
        return let(let(width, lambda w: F.transform(rows, lambda row: F.concat(row, F.array_repeat(F.lit(""), w - F.size(row))))), headed)

    def headed(padded: Column) -> Column:
        head = F.get(padded, F.lit(0))
        shaped = (F.size(F.filter(head, lambda x: x != "")) >= 2) & (F.size(F.filter(head, lambda x: x.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]"))) >= 2)
        return let(F.struct(padded.alias("rows"), head.alias("head"), F.coalesce(shaped, F.lit(False)).alias("shaped")), named)

    def named(t: Column) -> Column:
        names = F.transform(t["head"], lambda x, i: F.when(t["shaped"] & (x != ""), x).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string"))))
        data = F.when(t["shaped"], F.slice(t["rows"], F.lit(2), F.greatest(F.size(t["rows"]) - 1, F.lit(0)))).otherwise(t["rows"])
        return let(F.struct(names.alias("names"), data.alias("data")), spelled)

    def spelled(t: Column) -> Column:
        def one(row: Column, i: Column) -> Column:
            pairs = F.filter(F.zip_with(t["names"], row, lambda n, x: F.when(x != "", F.concat(n, F.lit(": "), x))), lambda x: x.isNotNull())
            return F.array_join(F.concat(F.array(F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(":"))), pairs), "\n")

        body = F.concat(F.array(F.concat(F.lit("Table: Table "), index.cast("string"))), F.transform(t["data"], one))
        return F.when(F.size(t["data"]) + F.size(t["names"]) > 0, F.array_join(body, "\n")).otherwise("")

    return let(filled, sized)
