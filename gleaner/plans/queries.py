"""The engine's registered queries, each with the SQL that gives the same rows where
SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import specs as S
from gleaner.functions import tabular
from gleaner.functions import text as T
from gleaner.functions.display import compact_list, known_json
from gleaner.operators import chunking, inspect, pages, planner, sections
from gleaner.plans import fixtures as X
from gleaner.plans import retrieve as R
from gleaner.sources import files
from gleaner.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, text of the documents and the literal rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".pdf")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.unionByName(X.texts(spark))


TEXTS = f"texts AS (SELECT doc_id AS id, source || '.pdf' AS source, coalesce(text, '') AS text FROM documents UNION ALL SELECT id, source, text FROM {X.values(X.TEXTS, 'f', 'id, source, text')})"
NL = "chr(10)"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_normalize(x: str) -> str:
    x = f"replace({x}, chr(160), ' ')"
    x = rf"regexp_replace({x}, '\r\n?', {NL}, 'g')"
    x = rf"regexp_replace({x}, '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', {NL} || {NL}, 'g')"
    return sql_strip(f"array_to_string(list_transform(string_split({x}, {NL}), lambda l: {sql_strip('l')}), {NL})")


def sql_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {NL}), lambda l: {sql_strip('l')}), lambda l: l <> '')"


def sql_word(x: str, p: str) -> str:
    """Whether the pattern is there between word boundaries."""
    return rf"regexp_matches({x}, '(?i)(^|[^\pL\pN_])({p})($|[^\pL\pN_])')"


def sql_heading(x: str, keywords: tuple[str, ...]) -> str:
    words = ", ".join(f"'{k}'" for k in keywords)
    shaped = rf"(regexp_matches({x}, '^\s*(?:\d+(?:\.\d+)+[.)]?|\d+[.)])\s+.{{3,80}}$') OR regexp_matches({x}, '(?i)^\s*(?:chapter|section)\s+\d+[:.)]?\s+.{{3,80}}$') OR lower({x}) IN ({words}))"
    return rf"({x} <> '' AND length({x}) <= 100 AND NOT regexp_matches({x}, '(?i)^\d+(?:\.\d+)?\s*(?:inch|inches|mm|cm|v|hz|khz|mhz|ghz|gb|mb)($|[^\pL\pN_])') AND {shaped})"


# -- text -----------------------------------------------------------------------


@query(f"WITH {TEXTS} SELECT id, {sql_normalize('text')} AS text FROM texts")
def normalize_text(spark, sf_dir):
    return all_texts(spark, sf_dir).select("id", T.normalize(F.col("text")).alias("text"))


TOKENS = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[\x{4e00}-\x{9fff}]|[^\s]"


@query(f"WITH {TEXTS} SELECT id, CAST(length(regexp_extract_all(text, '{TOKENS}')) AS INT) AS tokens, md5(array_to_string(regexp_extract_all(text, '{TOKENS}'), ' ')) AS digest FROM texts")
def token_count(spark, sf_dir):
    text = F.col("text")
    return all_texts(spark, sf_dir).select("id", T.count_length_tokens(text).cast("int").alias("tokens"), F.md5(F.array_join(T.length_tokens(text), " ").cast("binary")).alias("digest"))


LEXICAL = r"list_concat(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9._/-]*'), regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]{{1,4}}'))"


@query(f"WITH {TEXTS} SELECT id, array_to_string({LEXICAL.format('text')}, ' ') AS tokens FROM texts")
def lexical_tokens(spark, sf_dir):
    return all_texts(spark, sf_dir).select("id", F.array_join(T.lexical_tokens(F.col("text")), " ").alias("tokens"))


@query(
    rf"""WITH {TEXTS}, l AS (SELECT id, text, {sql_lines('text')} AS rows FROM texts),
c AS (SELECT id, text, length(list_filter(rows, lambda x: regexp_matches(x, '^(?:[-*•]|[0-9]+[.)]|[A-Za-z][.)])\s+'))) AS bullets,
  length(list_filter(string_split(text, {NL}), lambda x: contains(x, '|'))) AS pipes, length(list_filter(string_split(text, {NL}), lambda x: regexp_matches(x, '\S\s{{2,}}\S'))) AS spaced,
  length(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')) AS cjk, length(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM l)
SELECT id, CASE WHEN bullets >= 3 THEN 'list' WHEN bullets >= 1 THEN 'mixed' ELSE '' END AS list_structure,
  CASE WHEN contains(text, '[TABLE') THEN 'extracted_table' WHEN pipes >= 2 OR spaced >= 3 THEN 'table_like_layout' ELSE '' END AS table_context,
  CASE WHEN cjk > 0 AND cjk >= latin * 0.2 THEN 'zh' ELSE 'en' END AS language FROM c"""
)
def text_structure(spark, sf_dir):
    text = F.col("text")
    return all_texts(spark, sf_dir).select("id", T.list_structure(text).alias("list_structure"), T.table_context(text).alias("table_context"), T.language(text).alias("language"))


_TAG_SQL = ", ".join(f"CASE WHEN {sql_word('text', p.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')) if t != 'gpio' else chr(39).join(['regexp_matches(text, ', r'(?i)(^|[^\pL\pN_])gpio', ')'])} THEN '{t}' END" for t, p in T.TAGS.items())


@query(f"WITH {TEXTS} SELECT id, array_to_string(list_filter([{_TAG_SQL}], lambda x: x IS NOT NULL), ',') AS tags FROM texts")
def text_tags(spark, sf_dir):
    return all_texts(spark, sf_dir).select("id", F.array_join(T.tags(F.col("text")), ",").alias("tags"))


_VERSION_SQL = ", ".join(rf"nullif(regexp_extract(text, '(?i)(?:^|[^\pL\pN_])({p})(?:$|[^\pL\pN_])', 1), '')" for p in (r"FW\s*v?\d+(?:\.\d+){1,3}", r"Firmware\s*v?\d+(?:\.\d+){1,3}", r"Yocto\s+\d+(?:\.\d+){1,2}", r"Android\s+\d+(?:\.\d+){0,2}", r"v\d+(?:\.\d+){1,3}"))


@query(f"WITH {TEXTS} SELECT id, coalesce({_VERSION_SQL}, '') AS version FROM texts")
def text_version(spark, sf_dir):
    return all_texts(spark, sf_dir).select("id", T.version(F.col("text")).alias("version"))


@query(
    rf"""WITH {TEXTS}, l AS (SELECT id, {sql_lines('text')} AS rows FROM texts),
h AS (SELECT id, coalesce(rows[1], '') AS line, coalesce(list_filter(rows, lambda x: {sql_heading('x', T.SECTION_KEYWORDS)})[1], '') AS heading FROM l)
SELECT id, left(heading, 120) AS section, left(CASE WHEN heading <> '' THEN heading ELSE line END, 120) AS title,
  CAST(CASE WHEN line = '' THEN 0 WHEN regexp_matches(line, '^\d') THEN length(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)', 1), '.'))
    WHEN upper(line) = line AND lower(line) <> line AND length(string_split_regex(line, '\s+')) <= 8 THEN 1 WHEN {sql_heading('line', T.SECTION_KEYWORDS)} THEN 2 ELSE 0 END AS INT) AS heading_level FROM h"""
)
def text_headings(spark, sf_dir):
    text = F.col("text")
    return all_texts(spark, sf_dir).select("id", T.section_of(text).alias("section"), T.title_of(text).alias("title"), T.heading_level(text).cast("int").alias("heading_level"))


IDENTITIES = """idents AS (SELECT p_partkey AS id, 'P' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'D' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS code, p_partkey % 4 AS kind, p_size FROM part)"""


@query(
    f"""WITH {IDENTITIES}
SELECT id, CASE WHEN p_size % 3 = 0 THEN 'manual' WHEN p_size % 3 = 1 THEN 'faq' ELSE 'datasheet' END AS doc_type, CASE WHEN kind = 0 THEN code ELSE '' END AS text_codes, code AS source_codes,
  CASE kind WHEN 0 THEN 'STM32F' || (400 + p_size) WHEN 1 THEN 'RK' || (3500 + p_size) WHEN 2 THEN 'RTL' || (8100 + p_size) ELSE '' END AS chips,
  CASE kind WHEN 0 THEN 'ST' WHEN 1 THEN 'Rockchip' WHEN 2 THEN 'Realtek' ELSE '' END AS vendors,
  CASE kind WHEN 0 THEN 'ST STM32F' || (400 + p_size) WHEN 1 THEN 'RK' || (3500 + p_size) WHEN 2 THEN 'RTL' || (8100 + p_size) ELSE code END AS product FROM idents"""
)
def product_identity(spark, sf_dir):
    """Every part as a file whose name holds its code, and a text with a chip or none."""
    size, kind = F.col("p_size"), F.col("p_partkey") % 4
    code = F.concat(F.lit("P"), F.lpad(size.cast("string"), 2, "0"), F.lit("D"), F.lpad((F.col("p_partkey") % 100_000).cast("string"), 5, "0"))
    name = F.when(size % 3 == 0, "manual").when(size % 3 == 1, "faq").otherwise("datasheet")
    chip = F.when(kind == 0, F.concat(F.lit("STM32F"), (size + 400).cast("string"))).when(kind == 1, F.concat(F.lit("RK"), (size + 3500).cast("string"))).when(kind == 2, F.concat(F.lit("RTL"), (size + 8100).cast("string"))).otherwise("nothing")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(code, F.lit("_"), name, F.lit(".pdf")).alias("source"), F.concat(F.lit("A board of "), chip, F.when(kind == 0, F.concat(F.lit(", code "), code)).otherwise("")).alias("text"))
    rows = rows.withColumn("chips", T.chip_models(F.col("text"))).withColumn("own", T.product_codes(F.col("text"))).withColumn("named", T.product_codes(F.regexp_replace("source", "_", " ")))
    rows = rows.withColumn("vendors", T.vendors_of(F.col("text"), F.col("chips"))).withColumn("codes", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("named")))
    return rows.select("id", T.doc_type(F.col("source")).alias("doc_type"), F.array_join("own", ",").alias("text_codes"), F.array_join("named", ",").alias("source_codes"), F.array_join("chips", ",").alias("chips"), F.array_join("vendors", ",").alias("vendors"), T.primary_product(F.col("chips"), F.col("vendors"), F.col("codes")).alias("product"))


def order_lists(spark, sf_dir):
    """id, and the flags, states and quantities of an order's lines in order."""
    own = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string").alias("quantity"), F.col("l_partkey").cast("string").alias("part"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(own)).alias("x"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS n, l_partkey, CAST(l_quantity AS INT) AS q, l_linenumber % 3 = 0 AS bare FROM lineitem)
SELECT id, 'Table: Table ' || id || string_agg(chr(10) || 'Row ' || n || ':' || chr(10) || 'Part: ' || l_partkey || CASE WHEN bare THEN '' ELSE chr(10) || 'Quantity: ' || q END, '' ORDER BY n) AS text FROM l GROUP BY id"""
)
def table_rows(spark, sf_dir):
    """Every order as a table of its lines, some with an empty cell."""
    cells = F.concat(F.array(F.array(F.lit("Part"), F.lit("Quantity"))), F.transform("x", lambda x: F.array(x["part"], F.when(x["l_linenumber"] % 3 == 0, "").otherwise(x["quantity"]))))
    rows = order_lists(spark, sf_dir).select("id", cells.alias("cells"))
    return rows.select("id", T.table_rows(F.col("cells"), F.col("id")).alias("text"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS n, trim(CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END || CASE WHEN l_linestatus = 'O' THEN ' o' ELSE '' END) AS v FROM lineitem),
f AS (SELECT id, upper(v) AS k, arg_min(v, n) AS v, min(n) AS n FROM l GROUP BY 1, 2) SELECT id, string_agg(v, '|' ORDER BY n) AS vals FROM f GROUP BY id"""
)
def ordered_distinct(spark, sf_dir):
    """The flags of every order's lines, in two spellings, once by upper case."""
    flag = lambda x: F.concat(F.lit(" "), F.when(x["l_linenumber"] % 2 == 0, F.lower(x["l_returnflag"])).otherwise(x["l_returnflag"]), F.when(x["l_linestatus"] == "O", "  o").otherwise(""))
    return order_lists(spark, sf_dir).select("id", F.array_join(T.unique(F.transform("x", flag)), "|").alias("vals"))


@query("SELECT l_orderkey AS id, bool_and(l_returnflag IN ('A', 'N')) AS subset, bool_or(l_returnflag IN ('A', 'N')) AS overlap FROM lineitem GROUP BY 1")
def array_subset(spark, sf_dir):
    wanted = F.array(F.lit("A"), F.lit("N"))
    rows = order_lists(spark, sf_dir).select("id", F.col("x.l_returnflag").alias("t"))
    return rows.select("id", (F.size(F.array_except("t", wanted)) == 0).alias("subset"), F.arrays_overlap("t", wanted).alias("overlap"))


@query(
    """WITH x AS (SELECT p_partkey AS id, CASE WHEN p_brand <> 'Brand#13' THEN p_brand END AS brand, CASE WHEN p_type = 'PROMO' THEN [] ELSE list_filter(regexp_split_to_array(p_name, '[ aeiou]'), lambda v: v <> '') END AS pieces, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part)
SELECT id, array_to_string(pieces, '|') AS pieces, CASE WHEN size IS NULL THEN 0 ELSE 1 END AS n_sizes,
'{' || array_to_string(list_filter([CASE WHEN brand IS NOT NULL THEN '"brand":"' || brand || '"' END, CASE WHEN len(pieces) > 0 THEN '"pieces":["' || array_to_string(pieces, '","') || '"]' END, CASE WHEN size IS NOT NULL THEN '"size":' || size END], lambda v: v IS NOT NULL), ',') || '}' AS record FROM x"""
)
def compact_records(spark, sf_dir):
    """Every part as a record of what is known of it: empty pieces, lists and values drop."""
    cut = F.when(F.col("p_type") != "PROMO", F.split("p_name", "[ aeiou]"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("brand"), compact_list(cut).alias("pieces"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"))
    return rows.select("id", F.array_join("pieces", "|").alias("pieces"), F.size(compact_list(F.col("size"), many=False)).alias("n_sizes"), known_json(dict(rows.dtypes), ("brand", "pieces", "size", "absent")).alias("record"))


# -- pages and sections -----------------------------------------------------------

PAGES = "pg AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page, text FROM (SELECT source || '-' || (doc_id // 100) AS source, doc_id, coalesce(text, '') AS text FROM documents) x)"
REPEATED = rf"""edges AS (SELECT source, unnest(list_concat(rows[1:2], rows[greatest(length(rows) - 1, 1):length(rows)])) AS line FROM (SELECT source, {sql_lines('text')} AS rows FROM pg) x),
squeezed AS (SELECT source, regexp_replace(line, '\s+', ' ', 'g') AS line FROM edges),
repeated AS (SELECT e.source, e.line, count(*) AS n FROM squeezed e WHERE NOT regexp_matches(e.line, '^\d+$') AND length(e.line) >= 3 GROUP BY 1, 2
  HAVING count(*) >= least(2, (SELECT count(*) FROM pg p WHERE p.source = e.source)))"""


def page_table(spark, sf_dir):
    return R.pages_from_documents(table(spark, sf_dir, "documents"))


@query(f"WITH {PAGES}, {REPEATED} SELECT source, line, n FROM repeated")
def repeated_lines(spark, sf_dir):
    return pages.repeated_lines(page_table(spark, sf_dir))


STRIPPED = rf"""parts AS (SELECT source, page, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS pos FROM pg),
keyed AS (SELECT *, regexp_replace({sql_strip('line')}, '\s+', ' ', 'g') AS key FROM parts),
kept AS (SELECT k.source, k.page, k.pos, CASE WHEN key = '' THEN '' ELSE k.line END AS line FROM keyed k WHERE (key = '' OR NOT (regexp_matches(key, '(?i)^(?:page\s*)?\d+\s*(?:/|of)\s*\d+$') OR lower(key) IN ('confidential', 'company confidential')))
  AND NOT EXISTS (SELECT 1 FROM repeated r WHERE r.source = k.source AND r.line = k.key)),
joined AS (SELECT source, page, string_agg(line, {NL} ORDER BY pos) AS text FROM kept GROUP BY 1, 2),
clean AS (SELECT source, page, {sql_normalize('text')} AS text FROM joined)"""


def clean_pages(spark, sf_dir):
    return files.clean_pages(page_table(spark, sf_dir))


@query(f"WITH {PAGES}, {REPEATED}, {STRIPPED} SELECT source, page, md5(text) AS digest, CAST(length(text) AS INT) AS chars FROM clean WHERE text <> ''")
def strip_repeated_lines(spark, sf_dir):
    return clean_pages(spark, sf_dir).select("source", "page", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"))


SPANS = 'spans AS (SELECT source, page, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS "start", CAST(length(text) AS INT) AS n FROM pg)'


@query(f'WITH {PAGES}, {SPANS} SELECT source, page, "start", "start" + n AS "end" FROM spans')
def page_spans(spark, sf_dir):
    return pages.page_spans(page_table(spark, sf_dir))


@query(f"WITH {PAGES} SELECT source, md5(string_agg(text, {NL} || {NL} ORDER BY page)) AS digest FROM pg GROUP BY source")
def document_text(spark, sf_dir):
    return pages.documents_of(page_table(spark, sf_dir)).select("source", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH {PAGES}, {SPANS}, ends AS (SELECT source, page, "start", "start" + n AS "end" FROM spans),
asked AS (SELECT source, k, k * 997 AS a, k * 997 + 1500 AS b FROM (SELECT DISTINCT source FROM pg) s, range(40) t(k)),
hit AS (SELECT a.source, a.k, min(e.page) AS first_page, max(e.page) AS last_page FROM asked a JOIN ends e ON e.source = a.source AND e."start" < a.b AND e."end" > a.a GROUP BY 1, 2),
near AS (SELECT a.source, a.k, arg_min(e.page, abs(e."start" - a.a) * 1000000 + e.page) AS page FROM asked a JOIN ends e ON e.source = a.source GROUP BY 1, 2)
SELECT source, CAST(k AS INT) AS k, coalesce(first_page, page) AS start_page, coalesce(last_page, page) AS end_page FROM near LEFT JOIN hit USING (source, k)"""
)
def span_pages(spark, sf_dir):
    spans = pages.page_spans(page_table(spark, sf_dir))
    asked = spans.select("source").distinct().join(spark.range(40).select(F.col("id").cast("int").alias("k")), F.lit(True)).withColumn("char_start", F.col("k") * 997).withColumn("char_end", F.col("k") * 997 + 1500)
    return pages.pages_of_spans(asked, spans).select("source", "k", "start_page", "end_page")


SECTIONS = rf"""rows AS (SELECT id AS source, text, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS pos FROM texts WHERE text <> ''),
marked AS (SELECT source, length(text) AS total, pos, {sql_strip('line')} AS line, coalesce(sum(length(line) + 1) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM rows),
flagged AS (SELECT *, {sql_heading('line', T.DOCUMENT_KEYWORDS)} AS heading FROM marked),
parts AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY source ORDER BY pos) AS part FROM flagged),
cut AS (SELECT source, part, min(off) AS a, max(total) AS total, bool_or(heading) AS headed, arg_min(line, pos) AS line FROM parts GROUP BY 1, 2),
ranged AS (SELECT c.*, coalesce(lead(a) OVER (PARTITION BY source ORDER BY part), total) AS b FROM cut c),
texted AS (SELECT r.source, r.part, r.a, r.b, CASE WHEN headed THEN left(line, 120) ELSE '' END AS section, substr(t.text, CAST(r.a AS INT) + 1, CAST(r.b - r.a AS INT)) AS text FROM ranged r JOIN texts t ON t.id = r.source),
raw AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY part) AS no FROM texted WHERE {sql_strip('text')} <> '')"""


def section_docs(spark, sf_dir):
    return all_texts(spark, sf_dir).where("text <> ''").select(F.col("id").alias("source"), "text")


@query(f'WITH {TEXTS}, {SECTIONS} SELECT source, CAST(no AS INT) AS section_no, CAST(a AS INT) AS "start", CAST(b AS INT) AS "end", section, md5(text) AS digest FROM raw')
def raw_sections(spark, sf_dir):
    return sections.raw_sections(section_docs(spark, sf_dir)).select("source", "section_no", "start", "end", "section", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f'WITH {PAGES}, texts AS (SELECT source AS id, string_agg(text, {NL} || {NL} ORDER BY page) AS text FROM pg GROUP BY source), {SECTIONS} SELECT source, CAST(no AS INT) AS section_no, CAST(a AS INT) AS "start", CAST(b AS INT) AS "end", section, md5(text) AS digest FROM raw')
def source_sections(spark, sf_dir):
    """Of the documents that whole sources make, without making them."""
    lines = pages.lines_of(page_table(spark, sf_dir))
    return sections.sections_of_lines(lines).select("source", "section_no", "start", "end", "section", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH {TEXTS}, {SECTIONS}, t AS (SELECT *, section <> '' AND length(regexp_extract_all(text, '{TOKENS}')) <= 8 AS tiny FROM raw),
r AS (SELECT *, sum(CASE WHEN tiny THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY no) AS run FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY source, run, tiny ORDER BY no) - 1 AS place, lead(no) OVER (PARTITION BY source ORDER BY no) IS NOT NULL AS more FROM r),
k AS (SELECT *, tiny AND place % 2 = 0 AND more AS takes FROM p),
n AS (SELECT *, coalesce(lag(takes) OVER w, false) AS taken, lead(b) OVER w AS nb, lead(section) OVER w AS ns FROM k WINDOW w AS (PARTITION BY source ORDER BY no))
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY no) AS INT) AS section_no, CAST(a AS INT) AS "start", CAST(CASE WHEN takes THEN nb ELSE b END AS INT) AS "end",
  CASE WHEN takes THEN left(CASE WHEN ns <> '' AND ns <> section THEN section || ' / ' || ns ELSE section END, 120) ELSE section END AS section FROM n WHERE NOT taken"""
)
def merged_sections(spark, sf_dir):
    return sections.merged(sections.outline(section_docs(spark, sf_dir))).select("source", "section_no", "start", "end", "section")


# -- chunks -----------------------------------------------------------------------


@query()
def chunks_token_split(spark, sf_dir):
    docs = all_texts(spark, sf_dir).select("id", "text", F.lit(0).alias("start"))
    return chunking.split_texts(docs, chunking.Budget(chunking.CHILD, chunking.CHILD_OVERLAP), "c").select("id", "c_no", "c_start", "c_end", F.md5(F.col("c_text").cast("binary")).alias("digest"))


def own_chunks(spark, sf_dir):
    literal = X.texts(spark).select("source", F.concat(F.lit("docs/"), "source").alias("file_path"), F.lit(1).alias("page"), "text").where("text <> ''")
    return R.chunks_of(clean_pages(spark, sf_dir).select("source", "file_path", "page", "text").unionByName(literal))


@query()
def parent_child_chunks(spark, sf_dir):
    return own_chunks(spark, sf_dir).drop("spec_evidence")


STRIDES = "ch AS (SELECT doc_id AS source, CAST(k AS INT) + 1 AS position, CAST(k * CASE WHEN doc_id % 2 = 0 THEN 400 ELSE 510 END AS INT) AS a, CAST(least(k * CASE WHEN doc_id % 2 = 0 THEN 400 ELSE 510 END + 500, length(text)) AS INT) AS b, doc_id || '-' || k AS chunk_id FROM (SELECT doc_id, text, unnest(range(0, 1 + (length(text) - 1) // CASE WHEN doc_id % 2 = 0 THEN 400 ELSE 510 END)) AS k FROM documents WHERE length(text) > 0) d)"


def strides(spark, sf_dir):
    """Chunks of 500 characters that overlap in even documents and leave gaps in odd
    ones."""
    step = F.when(F.col("doc_id") % 2 == 0, 400).otherwise(510)
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", "text", step.alias("step"))
    rows = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.col("step")).cast("int"))))
    start = (F.col("k") * F.col("step")).cast("int")
    return rows.select(F.col("doc_id").alias("source"), (F.col("k") + 1).alias("position"), start.alias("char_start"), F.least(start + 500, F.length("text")).alias("char_end"), F.concat_ws("-", "doc_id", "k").alias("chunk_id"))


@query(f"WITH {STRIDES} SELECT chunk_id, coalesce(lag(chunk_id) OVER w, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER w, '') AS next_chunk_id FROM ch WINDOW w AS (PARTITION BY source ORDER BY position)")
def chunk_links(spark, sf_dir):
    from gleaner.operators.metadata import linked

    return linked(strides(spark, sf_dir).withColumnRenamed("position", "chunk_index")).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query(f"WITH {STRIDES}, d AS (SELECT chunk_id, a - lag(b) OVER (PARTITION BY source ORDER BY position) AS delta FROM ch) SELECT chunk_id, CASE WHEN delta < 0 THEN -delta END AS overlap_with_previous_chars, CASE WHEN delta > 0 THEN delta END AS gap_from_previous_chars FROM d")
def chunk_overlap_gap(spark, sf_dir):
    return inspect.overlaps(strides(spark, sf_dir)).select("chunk_id", "overlap_with_previous_chars", "gap_from_previous_chars")


@query(
    f"""WITH pairs AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, {sql_normalize('text')} AS question, {sql_normalize('answer')} AS answer FROM pairs WHERE role = 'user' AND next_role = 'assistant')
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS pair_no, question, md5(answer) AS answer FROM p WHERE question <> '' AND answer <> ''"""
)
def faq_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("reply", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).where("role = 'user' and reply = 'assistant'")
    piece = F.concat(F.lit("Q: "), "text", F.lit("\nA: "), "answer", F.lit("\n"))
    docs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("x")).select(F.col("conv_id").alias("source"), F.array_join(F.col("x.p"), "").alias("text"))
    return chunking.faq_pairs(docs).select(F.col("source").alias("conv_id"), "pair_no", "question", F.md5(F.col("answer").cast("binary")).alias("answer"))


# -- specifications ----------------------------------------------------------------

SHEETS = """sheets AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 5 AS kind FROM part)"""


@query(
    f"""WITH {SHEETS} SELECT id, n % 4 + 1 AS uart_count, CASE WHEN kind = 1 THEN 2 END AS i2c_count, CASE WHEN kind = 2 THEN 1 + n % 3 END AS usb_count, CASE WHEN kind = 3 THEN 1 END AS ethernet_count, CAST(n AS DOUBLE) / CASE WHEN kind = 4 THEN 1024 ELSE 1 END AS ram_gb, CASE WHEN kind = 1 THEN 16.0::DOUBLE END AS flash_gb,
  'RK' || (3500 + n) AS cpu_soc, CASE WHEN kind = 0 THEN 'Yocto Linux,Linux' ELSE 'Ubuntu ' || n END AS os_list, 'DC 12V' AS power_input, CASE WHEN n % 2 = 0 THEN true END AS has_lvds, 'CPU: RK' || (3500 + n) || ' RAM: ' || n || CASE WHEN kind = 4 THEN 'MB' ELSE 'GB' END || ' LPDDR4 Mini-PCIe with 4 x UART' AS ram_proof, (n % 4 + 1) || ' x UART' AS uart_proof FROM sheets"""
)
def spec_extract(spark, sf_dir):
    """A sheet for every part; every third one twice in one text, as in a parent."""
    n, kind = F.col("p_size"), F.col("p_partkey") % 5
    number = lambda c: c.cast("string")
    more = F.when(kind == 1, "2 x I2C\nFlash: 16GB eMMC").when(kind == 2, F.concat(number(n % 3 + 1), F.lit(" x USB 2.0"))).when(kind == 3, "Ethernet 10/100").otherwise("Size: 12 x 10 mm")
    system = F.when(kind == 0, "Yocto Linux").otherwise(F.concat(F.lit("Ubuntu "), number(n)))
    sheet = F.concat_ws("\n", F.concat(F.lit("CPU: RK"), number(n + 3500)), F.concat(F.lit("RAM: "), number(n), F.when(kind == 4, "MB").otherwise("GB"), F.lit(" LPDDR4")), F.lit("Mini-PCIe with 4 x UART"), F.concat(number(n % 4 + 1), F.lit(" x UART")), more, F.concat(F.lit("OS: "), system), F.lit("Power Input: DC 12V"), F.when(n % 2 == 0, "LVDS display"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(sheet, F.lit("\n\n"), sheet)).otherwise(sheet)
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = parts.select(F.col("p_partkey").alias("id"), S.extract(text).alias("x")).select("id", "x.*")
    single, lists = ("uart_count", "i2c_count", "usb_count", "ethernet_count", "ram_gb", "flash_gb", "has_lvds"), ("cpu_soc", "os_list", "power_input")
    proof = lambda f: F.element_at("spec_evidence", f)[0]
    return rows.select("id", *(f"specs.{f}" for f in single), *(F.array_join(f"specs.{f}", ",").alias(f) for f in lists), proof("ram_gb").alias("ram_proof"), proof("uart_count").alias("uart_proof"))


def _cap_sql(include: str, exclude: str) -> str:
    return rf"list_max(list_transform(list_filter(wins, lambda w: {sql_word('w', include)} AND NOT {sql_word('w', exclude)} AND regexp_matches(w, '(?i)(\d+(?:\.\d+)?)\s*(GB|G|MB)($|[^\pL\pN_])')), lambda w: CAST(regexp_extract(w, '(?i)(\d+(?:\.\d+)?)\s*(GB|G|MB)($|[^\pL\pN_])', 1) AS DOUBLE) / CASE WHEN lower(regexp_extract(w, '(?i)(\d+(?:\.\d+)?)\s*(GB|G|MB)($|[^\pL\pN_])', 2)) = 'mb' THEN 1024 ELSE 1 END))"


@query(
    rf"""WITH {TEXTS}, l AS (SELECT id, text, {sql_lines("regexp_replace(translate(text, '×²：', 'x2:'), '[ \\t]+', ' ', 'g')".replace(chr(92) * 2, chr(92)))} AS rows FROM texts),
w AS (SELECT id, text, list_concat(rows, list_transform(range(1, length(rows) + 1), lambda i: array_to_string(rows[i:i + 2], ' '))) AS wins FROM l)
SELECT id, {_cap_sql('RAM|DDR|LPDDR|SDRAM|Memory', r'ROM|Flash|eMMC|Storage|Micro\s*SD|SD\s*Card')} AS ram_gb, {_cap_sql('Flash|eMMC|ROM|On Board Flash|On Board ROM', r'External Storage|Micro\s*SD|SD\s*Card|max')} AS flash_gb,
  CASE WHEN {sql_word('text', 'LVDS')} THEN true END AS has_lvds, CASE WHEN {sql_word('text', r'MIPI\s*DSI|DSI')} THEN true END AS has_mipi_dsi FROM w"""
)
def spec_capacity(spark, sf_dir):
    text = F.col("text")
    return all_texts(spark, sf_dir).select("id", S.native_capacity(text, "ram_gb").alias("ram_gb"), S.native_capacity(text, "flash_gb").alias("flash_gb"), S.native_flag(text, "has_lvds").alias("has_lvds"), S.native_flag(text, "has_mipi_dsi").alias("has_mipi_dsi"))


PLANNED = (
    """SELECT p_partkey AS query_id, ord, field, op, val FROM part, (VALUES (0, 1, 'uart_count', '>='), (1, 1, 'ram_gb', '>='), (2, 1, 'has_lvds', '=='), (2, 2, 'os_list', 'contains'), (3, 1, 'spi_count', '<='), (4, 1, 'cpu_soc', 'contains'), (4, 2, 'vendor', 'contains'), (5, 1, 'flash_gb', '>='), (5, 2, 'can_count', '>=')) AS c(kind, ord, field, op),
  LATERAL (SELECT CASE c.field WHEN 'has_lvds' THEN 'true' WHEN 'os_list' THEN 'Yocto' WHEN 'cpu_soc' THEN 'RK' || (3500 + p_size) WHEN 'vendor' THEN 'NXP' WHEN 'flash_gb' THEN CAST(CAST(p_size AS DOUBLE) / 2 AS VARCHAR) WHEN 'can_count' THEN '1.0' ELSE p_size || '.0' END AS val) v WHERE c.kind = p_partkey % 6"""
)


def part_questions(spark, sf_dir):
    """A question for every part, in six kinds."""
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    asked = F.when(kind == 0, F.concat(n, F.lit(" x UART ports"))).when(kind == 1, F.concat(F.lit("RAM "), n, F.lit("GB 以上"))).when(kind == 2, "支援 LVDS, runs Yocto").when(kind == 3, F.concat(F.lit("SPI "), n, F.lit(" 個以下")))
    asked = asked.when(kind == 4, F.concat(F.lit("the RK"), (F.col("p_size") + 3500).cast("string"), F.lit(" of NXP?"))).otherwise(F.concat((F.col("p_size") * 512).cast("string"), F.lit("MB Flash, supports CAN")))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("query_id"), asked.alias("question"))


_VALUE = "coalesce(cast(num_value AS string), cast(bool_value AS string), str_value) AS val"


@query(PLANNED)
def plan_conditions(spark, sf_dir):
    return planner.conditions_of(part_questions(spark, sf_dir)).selectExpr("query_id", "ord", "field", "op", _VALUE)


@query(PLANNED)
def plan_conditions_lateral(spark, sf_dir):
    """The same through the table function of SQL."""
    tabular.register(spark)
    return spark.sql(f"SELECT query_id, ord, field, op, {_VALUE} FROM {{asked}} q, LATERAL plan_conditions(q.question) c", asked=part_questions(spark, sf_dir))


_OPS = {0: ("以上", ">="), 1: ("不超過", ">"), 2: ("不少於", ">="), 3: ("小於等於", "<="), 4: ("=", "=="), 5: ("少於", "<"), 6: ("none", "")}


@query(f"SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 7 {' '.join(f'WHEN {k} THEN {X.quoted(op)}' for k, (_, op) in _OPS.items())} END AS op FROM lineitem")
def comparators(spark, sf_dir):
    """Every order line's quantity with a comparator's word behind it."""
    word = F.element_at(F.create_map(*(F.lit(x) for k, (w, _) in _OPS.items() for x in (k, w))), (F.col("l_partkey") % 7).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.col("l_quantity").cast("string"), F.lit(" 個"), word).alias("text"))
    op = F.lit("")
    for name, pattern in reversed(planner.COMPARATORS.items()):
        op = F.when(F.col("text").rlike(pattern), name).otherwise(op)
    return rows.select("id", op.alias("op"))
