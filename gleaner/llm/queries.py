"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import ann, chat, decontam, linededup, mixing, neardup, pii, sharding, tokencount, toxicity, warc, whiten
from gleaner.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = linededup.apply(linededup.build(docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = tokencount.sentencepiece_vocabulary(vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), pieces)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), size=4, percent=80)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x"), F.lit(probe).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own.select("conv_id", "x.turn", "x.role", "text"))
    return chat.digests(chat.segments(turns))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).docs.select("doc_id", "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_WS}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id <> h.owner) AS dropped FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"

OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT doc_id, w, least(4, length(w)) AS k FROM w),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM n WHERE k > 0) x),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""


def _escaped(x: str) -> str:
    """Length of a text once control characters are escaped."""
    return f"(length({x}) + length(regexp_replace({x}, '[^<\\[\\\\]', '', 'g')))"


OP5_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, {len("<s>") + len("<|text|>") + len("</s>")} + {_escaped("role")} + {_escaped("text")} AS size FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY seq) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) + sum(size) - coalesce(max(upto) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM c GROUP BY conv_id
"""

_LEAK_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP6_SQL = f"""
WITH i AS (SELECT item_id, w, length(w) AS m, least(5, length(w)) AS k FROM (SELECT item_id, {_LEAK_WORDS} AS w FROM benchmark) x WHERE length(w) > 0),
ig AS (SELECT item_id, m, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, m - k + 2)) AS p FROM i) x),
ic AS (SELECT item_id, m, k, g, count(*) AS v FROM ig GROUP BY 1, 2, 3, 4), it AS (SELECT item_id, sum(v) AS v FROM ic GROUP BY 1),
d AS (SELECT doc_id, w, length(w) AS n FROM (SELECT doc_id, {_LEAK_WORDS} AS w FROM documents) x WHERE length(w) > 0),
dg AS (SELECT doc_id, n, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT d.*, s.k, unnest(range(1, n - s.k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) s) x),
hit AS (SELECT DISTINCT dg.doc_id, dg.n, ic.item_id, ic.m, ic.k, dg.p FROM dg JOIN ic ON ic.k = dg.k AND ic.g = dg.g),
win AS (SELECT DISTINCT doc_id, n, item_id, m, k, s FROM (SELECT *, unnest(range(greatest(1, least(p - (m - k), greatest(n - m + 1, 1))), greatest(1, least(p, n - m + 1)) + 1)) AS s FROM hit) x),
own AS (SELECT win.doc_id, win.item_id, win.m, win.n, s, dg.g, count(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND dg.k = win.k AND dg.p BETWEEN s AND s + least(m, win.n) - win.k GROUP BY 1, 2, 3, 4, 5, 6),
sim AS (SELECT own.doc_id, own.item_id, s, least(own.m, own.n) AS window_words, sum(least(c, coalesce(ic.v, 0))) AS shared, sum(c) + max(it.v) - sum(least(c, coalesce(ic.v, 0))) AS total
  FROM own JOIN it USING (item_id) LEFT JOIN ic ON ic.item_id = own.item_id AND ic.g = own.g GROUP BY 1, 2, 3, 4),
good AS (SELECT * FROM sim WHERE 100 * shared >= 80 * total),
best AS (SELECT *, count(*) OVER w AS n_windows, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, s) AS r FROM good WINDOW w AS (PARTITION BY doc_id, item_id))
SELECT doc_id, item_id, CAST(s - 1 AS BIGINT) AS start_word, CAST(window_words AS BIGINT) AS window_words, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total, CAST(shared AS DOUBLE) / CAST(total AS DOUBLE) AS similarity, n_windows FROM best WHERE r = 1
"""

_NIBBLE = "(instr('0123456789abcdef', substr(hex || '0', {at}, 1)) - 1)"

OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((({_NIBBLE.format(at="1 + (5 * i) // 4")} * 16 + {_NIBBLE.format(at="2 + (5 * i) // 4")}) >> (3 - (5 * i) % 4)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < owner THEN owner END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM o
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_minhash": op3_minhash,
    "op4_sharding": op4_sharding,
    "op5_chat_format": op5_chat_format,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_graph_ann": op8_graph_ann,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op3_minhash": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op12_warc": OP12_SQL,
}
