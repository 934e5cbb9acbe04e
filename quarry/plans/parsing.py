"""Queries on chunking, page layout and forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import tables
from quarry.functions import text as X
from quarry.functions import values as V
from quarry.operators import chunking as C
from quarry.operators import layout as L
from quarry.sources.tables import table

SECTIONS = [
    '35. When police may arrest. (1) Any officer may arrest (a) a person who flees; (b) a person who hides. Provided that no one is hurt. (2) "Arrest" means custody. Explanation The word is wide. Illustrations A flees. (3) (x) odd',
    "Plain section without any marker at all. It has two sentences.",
    "Provided at the start. (1) The rule. Exception None. (12) Another rule (13) lower",
]


def _sections(spark, d):
    """Inline sections, and every document with subsection marks put after some of its sentences."""
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(SECTIONS)], "doc_id long, text string")
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"\.\n", ". (1) "), r"\. The ", ". Provided The ").alias("text"))
    return own.unionByName(docs)


def split_markers(spark, d):
    rows = _sections(spark, d).withColumn("p", C.split_markers(F.col("text")))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.sha2(F.array_join("p", "\n").cast("binary"), 256).alias("parts_sha256"))


def attach_blocks(spark, d):
    rows = _sections(spark, d).withColumn("b", C.attach_blocks(C.split_markers(F.col("text"))))
    text = F.array_join(F.transform("b", lambda b: F.concat(F.coalesce(b["label"], F.lit("-")), F.lit("|"), b["text"])), "\n")
    return rows.select("doc_id", F.size("b").cast("long").alias("n_blocks"), F.sha2(text.cast("binary"), 256).alias("blocks_sha256"))


def pack_sections(spark, d):
    rows = table(spark, d, "documents").select("doc_id", C.pack(F.filter(F.split("text", "\n"), lambda t: t != ""), V.STATUTE_CHARS).alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_chunks"), F.sha2(F.array_join("p", "\n").cast("binary"), 256).alias("chunks_sha256"))


def chunk_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return C.chunk_documents(docs).select(F.col("id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def chunk_pages_function(spark, d):
    """Documents in tens as pages, chunked by the table function in SQL."""
    tables.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("quarry_documents")
    return spark.sql("SELECT id AS upload, CAST(chunk_index AS BIGINT) AS chunk_index, page_start, page_end, sha2(text, 256) AS text_sha256 FROM quarry_chunk_pages(TABLE(SELECT doc_id div 10 AS id, CAST(doc_id % 10 + 1 AS INT) AS page, text FROM quarry_documents))")


def chunk_page_ranges(spark, d):
    """Documents in tens as the pages of an upload, long ones and those without n_chars too: which pages each chunk
    holds."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 10").alias("upload"), F.expr("doc_id % 10 + 1").alias("page"), "text")
    rows = C.chunk_documents(docs, "upload", "page")
    return rows.select(F.col("id").alias("upload"), F.col("chunk_index").cast("long").alias("chunk_index"), "page_start", "page_end", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _runs(spark, d):
    """Positioned runs made from line items: each order is a page, each item a run. place: where a run stands in the files."""
    i = table(spark, d, "lineitem")
    place = F.struct(F.xxhash64("_metadata.file_path"), "_metadata.row_index").alias("place")
    return i.select(place, F.expr("l_orderkey div 100").alias("doc_id"), F.expr("CAST(l_orderkey % 100 AS INT)").alias("page"), F.expr("CAST(l_partkey % 50 * 10 AS DOUBLE)").alias("x"), F.expr("CAST(780 - l_linenumber * 12 - l_suppkey % 3 * 4 AS DOUBLE)").alias("y"), F.expr("CAST(l_suppkey % 7 * 5 AS DOUBLE)").alias("width"), F.expr("CAST(7 + l_suppkey % 4 AS DOUBLE)").alias("height"), F.concat("l_returnflag", F.lit(" "), "l_linenumber").alias("str"))


def _lined(runs):
    """Lines, equal runs at one place as they came."""
    return L.lines(runs, ties=("place",))


def line_islands(spark, d):
    return _lined(L.body_runs(_runs(spark, d))).select("doc_id", "page", "y", "x", "text")


def margin_blocks(spark, d):
    return L.margin_blocks(_lined(L.body_runs(_runs(spark, d)).where("is_margin"))).select("doc_id", "page", "top_y", "text")


def page_paragraphs(spark, d):
    return L.page_text(_lined(L.body_runs(_runs(spark, d)))).select("doc_id", "page", "text")


def column_assign(spark, d):
    return _runs(spark, d).select(L.column_at(F.col("x")).alias("cell"), "height").groupBy("cell").agg(F.count("*").alias("n"), F.sum("height").alias("height"))


def table_cells(spark, d):
    return L.table_cells(_runs(spark, d)).select("doc_id", "page", F.col("line_no").cast("long").alias("line_no"), *(key for key, _, _ in V.TABLE_COLUMNS))


def _forms(spark, d):
    """Parts as the forms of manifests, 58 each: number, title, reference and recognised pages."""
    return table(spark, d, "part").select(F.expr("(p_partkey - 1) div 58").alias("manifest"), F.expr("(p_partkey - 1) % 58 + 1").alias("form_number"), F.expr("CASE p_partkey % 5 WHEN 0 THEN left(p_name, 5) WHEN 1 THEN repeat(p_name, 6) ELSE p_name END").alias("title"), F.expr("CASE WHEN p_partkey % 3 > 0 THEN p_type END").alias("see"), F.expr("CAST(p_partkey % 4 = 0 AS INT)").alias("n_ocr"), F.expr("190 + (p_partkey - 1) % 58 + p_partkey % 2").alias("start_page"))


def form_ranges(spark, d):
    return L.form_ranges(_forms(spark, d).select("manifest", "form_number", "start_page"), 249, "manifest")


def form_confidence(spark, d):
    return L.form_confidence(_forms(spark, d)).select("manifest", "form_number", "confidence", F.array_join("reasons", ";").alias("reasons"), "needs_review")


def form_search(spark, d):
    """Searches by a word, by a number and with a blank query."""
    forms = _forms(spark, d)
    found = None
    for q in ("a", "12", "  "):
        hit = L.form_search(forms, q).select(F.lit(q).alias("query"), "manifest", "form_number")
        found = hit if found is None else found.unionByName(hit)
    return found


# ---- the same in SQL ------------------------------------------------------------------------------------------
_q = lambda t: "'" + t.replace("'", "''") + "'"
_SP = X.SPACE
_trim = lambda c: f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"
_coll = lambda c: f"regexp_replace({c}, '{_SP}+', ' ', 'g')"
_SECT = "sect AS (SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {_q(t)})" for i, t in enumerate(SECTIONS)) + ") v(doc_id, text) UNION ALL SELECT doc_id, regexp_replace(regexp_replace(text, '\\.\\n', '. (1) ', 'g'), '\\. The ', '. Provided The ', 'g') FROM documents)"
_marked = "regexp_replace(text, '\\s(\\(\\d{1,2}\\))\\s([A-Z\"(])', chr(10) || '\\1 \\2', 'g')"
for _w in ("Provided\\b", "Explanation\\b", "Exception\\b", "Illustrations?\\b"):
    _marked = f"regexp_replace({_marked}, '\\s({_w})', chr(10) || '\\1', 'g')"
_PARTS = f"{_SECT}, parts AS (SELECT doc_id, list_filter(list_transform(string_split({_marked}, chr(10)), lambda p: {_trim('p')}), lambda p: p <> '') AS p FROM sect)"
_ATT = "regexp_matches(t, '^(Provided|Explanation|Exception|Illustration|Illustrations)\\b')"
_BLOCKS = f"{_PARTS}, flat AS (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM parts), numbered AS (SELECT *, sum(CASE WHEN {_ATT} AND i > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM flat), blocks AS (SELECT doc_id, b, string_agg(t, ' ' ORDER BY i) AS text, coalesce(nullif(regexp_extract(arg_min(t, i), '^(\\(\\d{{1,2}}\\))\\s', 1), ''), '-') AS label FROM numbered GROUP BY ALL)"
_S = lambda t: f"{{'out': []::VARCHAR[], 'buf': '', 't': {t}}}"


def _pack(parts: str, most: int) -> str:
    full = f"(s.buf <> '' AND length(s.buf) + length(x.t) + 1 > {most})"
    step = f"{{'out': CASE WHEN {full} THEN list_append(s.out, s.buf) ELSE s.out END, 'buf': CASE WHEN {full} OR s.buf = '' THEN x.t ELSE s.buf || ' ' || x.t END, 't': ''}}"
    fold = f"list_reduce(list_prepend({_S(chr(39) * 2)}, list_transform({parts}, lambda t: {_S('t')})), lambda s, x: {step})"
    return f"(SELECT CASE WHEN f.buf = '' THEN f.out ELSE list_append(f.out, f.buf) END FROM (SELECT {fold} AS f))"


_SENT = lambda c: f"string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
#: Sentences longer than the target are first cut the way a running buffer would be: see the recursive part.
_CHUNKS = f"""blk AS (SELECT {{key}}, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n+'), lambda b: {_trim(_coll("regexp_replace(b, '-\\n([a-z])', '\\1', 'g')"))}), lambda b: b <> '')) AS b, unnest(range(len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n+'), lambda b: {_trim(_coll("regexp_replace(b, '-\\n([a-z])', '\\1', 'g')"))}), lambda b: b <> '')))) AS bi FROM src),
longs AS (SELECT *, {_SENT('b')} AS ss FROM blk WHERE length(b) > 1500),
walk AS (SELECT {{key}}, bi, ss, 0 AS i, '' AS buf, NULL::VARCHAR AS out, 0 AS k FROM longs
  UNION ALL SELECT {{key}}, bi, ss,
    CASE WHEN length(buf) > 1500 THEN i WHEN buf <> '' AND i < len(ss) AND length(buf) + length(ss[i + 1]) + 1 > 1500 THEN i ELSE i + 1 END,
    CASE WHEN length(buf) > 1500 THEN substr(buf, CASE WHEN sp > 0 THEN sp + 2 ELSE 1501 END)
         WHEN buf <> '' AND (i >= len(ss) OR length(buf) + length(ss[i + 1]) + 1 > 1500) THEN '' WHEN buf = '' THEN ss[i + 1] ELSE buf || ' ' || ss[i + 1] END,
    CASE WHEN length(buf) > 1500 THEN substr(buf, 1, CASE WHEN sp > 0 THEN sp ELSE 1500 END)
         WHEN buf <> '' AND (i >= len(ss) OR length(buf) + length(ss[i + 1]) + 1 > 1500) THEN buf END, k + 1
  FROM (SELECT *, length(regexp_extract(substr(buf, 1, 1501), '^((?s).*) ', 1)) AS sp FROM walk) WHERE i < len(ss) OR buf <> ''),
pieces AS (SELECT {{key}}, bi, 0 AS k, b AS t FROM blk WHERE length(b) <= 1500 UNION ALL SELECT {{key}}, bi, k, out FROM walk WHERE out IS NOT NULL)"""
_CH = "{'out': []::STRUCT(t VARCHAR, a INTEGER, z INTEGER)[], 'buf': '', 'a': NULL::INTEGER, 'z': NULL::INTEGER, 't': %s, 'p': %s}"


def _chunks(key: str, page: str, group: str, order: str) -> str:
    full = "(s.buf <> '' AND length(s.buf) + length(x.t) + 2 > 1500)"
    tail = "regexp_replace(right(s.buf, 150), '^\\S*\\s', '')"
    before = f"CASE WHEN {full} THEN {tail} ELSE s.buf END"
    done = f"list_append(s.out, {{'t': {_trim('s.buf')}, 'a': s.a, 'z': s.z}})"
    step = f"{{'out': CASE WHEN {full} THEN {done} ELSE s.out END, 'buf': CASE WHEN {before} <> '' THEN {before} || chr(10) || chr(10) || x.t ELSE x.t END, 'a': CASE WHEN {full} THEN CASE WHEN {tail} <> '' THEN s.z ELSE x.p END ELSE coalesce(s.a, x.p) END, 'z': x.p, 't': '', 'p': 0}}"
    last = f"list_append(f.out, {{'t': {_trim('f.buf')}, 'a': f.a, 'z': f.z}})"
    return f"{_CHUNKS.replace("{key}", key)}, folded AS (SELECT {group}, list_reduce(list_prepend({_CH % (chr(39) * 2, '0')}, list({_CH % ('t', page)} ORDER BY {order})), lambda s, x: {step}) AS f FROM pieces GROUP BY {group}), chunks AS (SELECT {group}, CASE WHEN {_trim('f.buf')} = '' THEN f.out ELSE {last} END AS c FROM folded), flat AS (SELECT {group}, unnest(c) AS c, unnest(range(len(c))) AS chunk_index FROM chunks)"


_RUNS = "runs AS (SELECT l_orderkey // 100 AS doc_id, (l_orderkey % 100)::INTEGER AS page, (l_partkey % 50 * 10)::DOUBLE AS x, (780 - l_linenumber * 12 - l_suppkey % 3 * 4)::DOUBLE AS y, (l_suppkey % 7 * 5)::DOUBLE AS width, (7 + l_suppkey % 4)::DOUBLE AS height, l_returnflag || ' ' || l_linenumber AS str FROM lineitem)"


def _lines(where: str) -> str:
    return f"""{_RUNS}, r0 AS (SELECT *, coalesce(lag(y) OVER w - y > 2.5, true)::INTEGER AS new FROM runs WHERE y <= 765 AND {where} WINDOW w AS (PARTITION BY doc_id, page ORDER BY y DESC, x, str)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, str ROWS UNBOUNDED PRECEDING) AS line_no FROM r0),
r2 AS (SELECT *, row_number() OVER w AS place, CASE WHEN x - lag(x + width) OVER w > 1 THEN ' ' ELSE '' END || str AS part FROM r1 WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY x, y DESC, str)),
lines AS (SELECT doc_id, page, line_no, max(y) AS y, min(x) AS x, {_trim(_coll("string_agg(part, '' ORDER BY place)"))} AS text FROM r2 GROUP BY ALL)"""


_LINES = "list_filter(string_split(text, chr(10)), lambda t: t <> '')"
_MARGIN = "height < 9 AND (x < 110 OR x > 470)"
_COL = "CASE " + " ".join(f"WHEN x >= {start - V.COLUMN_SLACK} THEN '{key}'" for key, start, _ in reversed(V.TABLE_COLUMNS[1:])) + " ELSE 'section' END"
_FORMS = "forms AS (SELECT (p_partkey - 1) // 58 AS manifest, (p_partkey - 1) % 58 + 1 AS form_number, CASE p_partkey % 5 WHEN 0 THEN left(p_name, 5) WHEN 1 THEN repeat(p_name, 6) ELSE p_name END AS title, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS see, (p_partkey % 4 = 0)::INTEGER AS n_ocr, 190 + (p_partkey - 1) % 58 + p_partkey % 2 AS start_page FROM part)"

SQL = {
    "split_markers": f"WITH {_PARTS} SELECT doc_id, len(p) AS n_parts, sha256(array_to_string(p, chr(10))) AS parts_sha256 FROM parts",
    "attach_blocks": f"WITH {_BLOCKS} SELECT doc_id, coalesce(n, 0) AS n_blocks, sha256(coalesce(s, '')) AS blocks_sha256 FROM sect LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(label || '|' || text, chr(10) ORDER BY b) AS s FROM blocks GROUP BY doc_id) USING (doc_id)",
    "pack_sections": f"SELECT doc_id, len(p) AS n_chunks, sha256(array_to_string(p, chr(10))) AS chunks_sha256 FROM (SELECT doc_id, {_pack(_LINES, V.STATUTE_CHARS)} AS p FROM documents)",
    "chunk_documents": "WITH RECURSIVE src AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), " + _chunks("doc_id", "1", "doc_id", "bi, k") + " SELECT doc_id, chunk_index, length(c.t) AS n_chars, sha256(c.t) AS text_sha256 FROM flat",
    "chunk_page_ranges": "WITH RECURSIVE src AS (SELECT doc_id // 10 AS upload, (doc_id % 10 + 1)::INTEGER AS page, text FROM documents), " + _chunks("upload, page", "page", "upload", "page, bi, k") + " SELECT upload, chunk_index, c.a AS page_start, c.z AS page_end, sha256(c.t) AS text_sha256 FROM flat",
    "line_islands": f"WITH {_lines('true')} SELECT doc_id, page, y, x, text FROM lines",
    "margin_blocks": f"WITH {_lines(_MARGIN)}, b0 AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC) - y > 15, true)::INTEGER AS new FROM lines), b1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS b FROM b0) SELECT doc_id, page, max(y) AS top_y, string_agg(text, ' ' ORDER BY y DESC) AS text FROM b1 GROUP BY doc_id, page, b",
    "page_paragraphs": f"WITH {_lines('true')}, g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC) - y AS gap FROM lines), m AS (SELECT doc_id, page, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gs FROM g GROUP BY ALL) SELECT doc_id, page, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > coalesce(gs[(len(gs) - 1) // 2 + 1], 0) * 1.6::DOUBLE THEN chr(10) || chr(10) ELSE chr(10) END || text, '' ORDER BY y DESC) AS text FROM g JOIN m USING (doc_id, page) GROUP BY doc_id, page",
    "column_assign": f"WITH {_RUNS} SELECT {_COL} AS cell, count(*) AS n, sum(height) AS height FROM runs GROUP BY ALL",
    "table_cells": f"WITH {_RUNS}, r0 AS (SELECT *, coalesce(lag(y) OVER w - y > 2.5, true)::INTEGER AS new FROM runs WHERE y < 760 AND y > 55 WINDOW w AS (PARTITION BY doc_id, page ORDER BY y DESC, x, str)), r1 AS (SELECT *, {_COL} AS cell, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, str ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM r0) SELECT doc_id, page, line_no, " + ", ".join(f"coalesce(string_agg(str, ' ' ORDER BY x, str) FILTER (cell = '{key}'), '') AS {key}" for key, _, _ in V.TABLE_COLUMNS) + " FROM r1 GROUP BY ALL",
    "form_ranges": f"WITH {_FORMS} SELECT manifest, form_number, start_page, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY manifest ORDER BY start_page, form_number) - 1, 249)) AS end_page FROM forms",
    "form_confidence": f"WITH {_FORMS} SELECT manifest, form_number, confidence, reasons, confidence < 0.9 AS needs_review FROM (SELECT manifest, form_number, greatest(0, round(1::DOUBLE - CASE WHEN n_ocr > 0 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN see IS NULL THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN length(title) < 8 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN length(title) > 120 THEN 0.1::DOUBLE ELSE 0 END, 2)) AS confidence, concat_ws(';', CASE WHEN n_ocr > 0 THEN 'title recovered by OCR' END, CASE WHEN see IS NULL THEN 'no \"See section\" reference found under the title' END, CASE WHEN length(title) < 8 THEN 'title looks too short' END, CASE WHEN length(title) > 120 THEN 'title looks too long, may have swallowed body text' END) AS reasons FROM forms)",
    "form_search": f"WITH {_FORMS} SELECT 'a' AS query, manifest, form_number FROM forms WHERE contains(lower(title), 'a') UNION ALL SELECT '12', manifest, form_number FROM forms WHERE contains(lower(title), '12') OR form_number = 12 UNION ALL SELECT '  ', manifest, form_number FROM forms",
}
#: The name that the query of all documents had while chunk_page_ranges left long ones out.
SQL["chunk_pages_function"] = SQL["chunk_page_ranges"]
SQL["chunk_page_ranges_whole"], chunk_page_ranges_whole = SQL["chunk_page_ranges"], chunk_page_ranges
QUERIES = {name: globals()[name] for name in SQL}
