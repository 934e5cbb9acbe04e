"""Queries on job states, records, cards, labels, forms and table geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import values as V
from quarry.operators import citations as C
from quarry.operators import edges as E
from quarry.operators import retrieval as S
from quarry.plans import language, parsing, records, search
from quarry.sources.tables import table, written

ALLOWED = ["http://example.com/", "http://site1.example", "https://site2.example/"]


def payload_scroll(spark, d):
    """A point look-up by filter: the first 50 of a source, by id."""
    return table(spark, d, "documents").where("source = 'src7' AND lang = 'en'").select("doc_id", "source", "n_chars").orderBy("doc_id").limit(50)


def _jobs(spark, d):
    """Events as stages of a job per user."""
    stage = F.expr("CASE event_type WHEN 'signup' THEN 'parsing' WHEN 'click' THEN 'chunking' WHEN 'view' THEN 'embedding' WHEN 'purchase' THEN 'ready' ELSE 'failed' END")
    return table(spark, d, "events").select("user_id", "ts", "event_id", stage.alias("stage"), F.expr("least(1D, abs(value) / 200)").alias("share"))


def ingest_status(spark, d):
    return E.job_status(_jobs(spark, d), "user_id", ["ts", "event_id"], "stage", "share", 30)


def ready_documents(spark, d):
    return ingest_status(spark, d).where("status = 'ready'").select("user_id")


def stage_bar(spark, d):
    return ingest_status(spark, d).select("user_id", F.round(E.stage_bar(F.col("status"), F.col("progress")), 2).alias("percent"))


def retry_backoff(spark, d):
    """Waits of a poll and of a job's retry, per event of a user."""
    n = table(spark, d, "events").select("event_id", (F.col("event_id") % 9).alias("n"))
    return n.select("event_id", F.round(E.backoff(F.col("n"), 1200, 1.4, 5000), 3).alias("poll_ms"), E.backoff(F.col("n") % 2, 5000, 2, 1e9).alias("retry_ms"))


def session_records(spark, d):
    """Records that a user's index names, latest version of each; those that are gone are left out. The log holds a write
    per event, under the key of its number modulo 1,000; every seventh key is deleted by its last write."""
    log = table(spark, d, "events").select((F.col("event_id") % 1000).alias("key"), "ts", "event_id", "user_id", "event_type")
    held = E.latest(log, "key", "ts", "event_id").where("key % 7 > 0")
    index = log.select("user_id", "key").distinct()
    return index.join(held.select("key", "event_id", "event_type"), "key").select("user_id", "key", "event_id", "event_type")


def public_documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit(".pdf")).alias("filename"), F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("queued")).alias("status"), F.coalesce("n_chars", F.lit(0)).alias("bytes"), F.nullif(F.expr("n_chars div 3000"), F.lit(0)).alias("pages"), E.size_label(F.col("n_chars") * 700).alias("size"), X.safe_filename(F.concat("source", F.lit(" é/"), "doc_id", F.lit(".pdf"))).alias("safe"))


def cors_origins(spark, d):
    origin = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    return table(spark, d, "pages").select("page_id", E.origin_allowed(origin, ALLOWED).alias("allowed"))


def refusal_texts(spark, d):
    """What a user is told: of a question's guard rule, and of each event as an error."""
    text = lambda texts, code: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, t in texts.items() if k for x in (k, t))), code), F.lit(texts[None]))
    code = F.when(F.col("rule").isNotNull(), "injection").otherwise("off_topic")
    own = language.injection_scan(spark, d).select("qid", text(V.REFUSALS, code).alias("told"))
    errors = table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("qid"), text(V.ERRORS, F.expr("CASE event_type WHEN 'error' THEN 'internal_error' WHEN 'view' THEN 'not_found' WHEN 'click' THEN 'rate_limited' ELSE 'other' END")).alias("told"))
    return own.unionByName(errors)


def readiness(spark, d):
    """Days as probes: ready if no check failed, with the code that is answered."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.bool_and((F.col("event_type") != "error") | (F.col("value") < 180)).alias("ready"))
    return days.select("day", "ready", F.when(F.col("ready"), 200).otherwise(503).cast("long").alias("code"))


def citation_cards(spark, d):
    answers, contexts = language._answers(spark, d)
    return E.cards(C.bind(C.markers(answers), contexts), contexts)


def citation_labels(spark, d):
    return citation_cards(spark, d).select("aid", "number", E.citation_label().alias("label"))


def ui_markers(spark, d):
    """Validated answers in parts, each marker with its card's number."""
    answers, contexts = language._answers(spark, d)
    rows = C.validate(answers, contexts).select("aid", F.posexplode(E.ui_parts(F.col("text"))).alias("pos", "p")).select("aid", F.col("pos").cast("long").alias("pos"), "p.part", "p.is_marker")
    numbers = citation_cards(spark, d).select("aid", F.col("marker").alias("part"), "number")
    return rows.join(numbers, ["aid", "part"], "left").select("aid", "pos", "part", "is_marker", F.col("number").cast("long").alias("number"))


def see_sections(spark, d):
    """References of forms, some to several sections."""
    see = F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(p_size, '(', p_partkey % 3, ')') WHEN 2 THEN concat(p_size, ', ', p_size + 1, ' and ', p_size + 2, '(1)(a)') ELSE concat(p_size, ' and  ', p_size + 9) END")
    rows = table(spark, d, "part").select("p_partkey", E.see_sections(see).alias("s"))
    return rows.select("p_partkey", F.array_join("s", "|").alias("sections"), E.or_null(E.bare_section(F.try_element_at(F.col("s"), F.lit(1)))).alias("first"))


def form_chunks(spark, d):
    """Forms as chunks with their references, all manifests."""
    forms = parsing._forms(spark, d).select("manifest", "form_number", "title", "see")
    return E.form_chunks(forms).select("manifest", "chunk_id", "section_number", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.array_join("references", "|").alias("refs"))


def manifest_header(spark, d):
    """Of each manifest: how many forms, and a digest of them by number."""
    forms = parsing._forms(spark, d)
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("form_number", "title"))), lambda f: F.concat(f["form_number"].cast("string"), F.lit(":"), f["title"])), "\n")
    return forms.groupBy("manifest").agg(F.count("*").alias("form_count"), F.sha2(own.cast("binary"), 256).alias("sha256"))


#: Lines of documents as pages of forms: headers, blank lines and references among them.
_FORM_LINE = "CASE WHEN line_no % 9 = 0 THEN 'FORM No. ' || (line_no % 300 + doc_id % 7) WHEN line_no % 9 = 2 AND doc_id % 2 = 0 THEN '  ' WHEN line_no % 9 = 1 + doc_id % 7 AND line_no % 4 < 3 THEN '[See section ' || (doc_id % 90 + 1) || ' and 64(1)]' ELSE t END"


def form_titles(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    found = E.form_titles(rows.select("doc_id", "line_no", F.expr(_FORM_LINE).alias("text")))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("form_number").cast("long").alias("form_number"), "title", "see")


def margin_notes(spark, d):
    """Documents' lines as margin blocks, some with a reference to an act behind."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "t")).where("t <> ''")
    text = F.concat("t", F.when(F.expr("page % 3 = 0"), F.lit(". 45 of 1860. The Code. ")).otherwise(""))
    notes = E.margin_notes(rows.select("doc_id", "page", F.lit(700.0).alias("top_y"), text.alias("text")))
    return notes.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").cast("binary"), 256).alias("notes_sha256"))


def _lines(spark, d):
    """Orders as lines of runs: items as runs, numbers on some lines, a heading of part II on others."""
    text = F.expr("CASE WHEN l_orderkey % 5 = 1 THEN CAST(1 + l_linenumber % 6 AS STRING) WHEN l_orderkey % 31 = 7 AND l_linenumber = 1 THEN 'II. - Other acts' ELSE concat('r', l_linenumber) END")
    return table(spark, d, "lineitem").select(F.expr("l_orderkey div 500").alias("doc_id"), F.expr("CAST(l_orderkey div 50 % 10 AS INT)").alias("page"), F.expr("l_orderkey % 50").alias("line_no"), F.expr("CAST(l_linenumber * 60 AS DOUBLE)").alias("x"), text.alias("str"))


def table_region(spark, d):
    return E.table_region(_lines(spark, d)).groupBy("doc_id", "page", "line_no").agg(F.count("*").alias("n"))


def split_runs(spark, d):
    """Texts as runs of a page each, cut at table columns; the first 100 characters of a line are what a page's width
    holds."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "t")).where("t <> ''")
    rows = rows.select("doc_id", "page", F.expr("CAST(50 + doc_id % 40 * 10 AS DOUBLE)").alias("x"), X.trim(X.collapse(F.col("t"))).alias("str")).where("str <> ''").withColumn("width", F.least(F.length("str") * 3.4, F.lit(480.0)))
    widths = E.char_width(rows)
    cut = rows.join(widths, ["doc_id", "page"]).withColumn("r", F.explode(E.split_run(F.col("x"), F.col("width"), F.col("str"), F.col("char_width"))))
    return cut.select("doc_id", F.col("page").cast("long").alias("page"), F.round("r.x", 3).alias("x"), F.round("r.width", 3).alias("width"), F.sha2(F.col("r.str").cast("binary"), 256).alias("str_sha256"))


def concurrency_cap(spark, d):
    """Events as answers that take a while: two at once per user and twelve per box, a box for every ten users."""
    rows = table(spark, d, "events").select((F.col("user_id") % 15).alias("box"), "user_id", "ts", F.expr("ts + make_dt_interval(0, 0, 0, value * 600)").alias("until"), "event_id")
    return E.slots(rows, "box", "user_id", "ts", "until", "event_id").select("box", F.col("request_id").alias("event_id"), "allowed")


def _swept(spark, d):
    """(held, sparse, {configuration: results}): the eight configurations of the evaluation: fusion's constant, reranked
    pool and the characters it sees."""
    held, dense, sparse = records._legs(spark, d)
    fused = {k: written(S.hybrid(dense, sparse, k), "fused") for k in (60, 20)}
    swept = {}
    for name, k, pool, chars in V.SWEEP:
        rows = fused[k]
        swept[name] = S.rerank_order(rows, search.rerank_scores(spark, d, rows, pool, chars), pool) if pool else rows
    return held, sparse, swept


def sweep_configs(spark, d):
    held, _, swept = _swept(spark, d)
    out = None
    for name, rows in swept.items():
        one = records.R.ranking_metrics(rows, held).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def answer_metrics(answers, contexts, expected, refused):
    """(config, answered, refused_in_scope, citation_accuracy, refusal_rate_out_of_scope): a question is in scope if expected
    (qid, id) has it; an answer is grounded if no marker of it was stripped and one cites what is expected. answers: config,
    qid, answer; contexts: config, qid and those of bind() after aid; refused (qid, refused): each question once. Accuracy
    is 0 without answers, the rate null if all questions are in scope."""
    aid = F.concat_ws("|", "config", "qid").alias("aid")
    bound = C.bind(C.markers(answers.select(aid, "answer")), contexts.select(aid, *(c for c in contexts.columns if c not in ("config", "qid"))))
    facts = bound.groupBy("aid").agg(F.collect_set(F.when(F.col("ctx").isNotNull(), F.col("section"))).alias("cited"), F.max((F.col("text") == "") & (F.col("kind") != "other")).alias("stripped"))
    wanted = expected.groupBy("qid").agg(F.collect_set(F.col("id").cast("string")).alias("expected"))
    rows = answers.select("config", "qid", aid).join(facts, "aid", "left").join(wanted, "qid", "left").join(refused, "qid")
    inside = F.col("expected").isNotNull()
    answered = inside & ~F.col("refused")
    grounded = answered & ~F.coalesce("stripped", F.lit(False)) & F.coalesce(F.arrays_overlap("cited", "expected"), F.lit(False))
    share = F.coalesce(F.round(F.try_divide(F.count_if(grounded), F.count_if(answered)), 3), F.lit(0.0))
    return rows.groupBy("config").agg(F.count_if(answered).alias("answered"), F.count_if(inside & F.col("refused")).alias("refused_in_scope"), share.alias("citation_accuracy"), F.round(F.try_divide(F.count_if(~inside & F.col("refused")), F.count_if(~inside)), 3).alias("refusal_rate_out_of_scope"))


#: Best sparse score below which a question of the answer pass is refused.
LEAST = 40.0


def _cited(swept):
    """(answers, contexts) of each configuration: the first two results are cited, and every fourth question also cites
    what was not retrieved."""
    rows = None
    for name, found in swept.items():
        one = found.where(F.col("rank") <= V.TOP_K).select(F.lit(name).alias("config"), "qid", "id", "rank")
        rows = one if rows is None else rows.unionByName(one)
    rows = written(rows, "swept")
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 2, F.struct("rank", "id")))), lambda x: F.concat(F.lit("[BNSS s."), x["id"].cast("string"), F.lit("]"))), " and ")
    answers = rows.groupBy("config", "qid").agg(marks.alias("m")).select("config", "qid", F.concat(F.lit("So it is held "), "m", F.when(F.col("qid").cast("long") % 4 == 1, " [BNSS s.99999999]").otherwise("")).alias("answer"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    contexts = rows.select("config", "qid", F.col("rank").cast("int").alias("idx"), F.lit("statute").alias("source"), F.lit("BNSS").alias("act_short"), F.col("id").cast("string").alias("section_number"), none("subsection", "string"), none("text", "string"), none("document_name", "string"), none("page_start", "int"), none("page_end", "int"))
    return answers, contexts


def answer_pass(spark, d):
    """The questions of benchmark under the eight configurations: how many are answered, refused and grounded."""
    held, sparse, swept = _swept(spark, d)
    best = sparse.groupBy("qid").agg(F.max("score").alias("best"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid")).join(best, "qid", "left")
    return answer_metrics(*_cited(swept), held, asked.select("qid", (F.coalesce("best", F.lit(0.0)) < LEAST).alias("refused")))


def sql_functions(spark, d):
    """The functions that SQL can call, over all turns."""
    E.register(spark)
    table(spark, d, "conversations").createOrReplaceTempView("quarry_turns")
    return spark.sql("SELECT conv_id, turn, size(quarry_tokens(text)) AS n_terms, quarry_token_estimate(text) AS n_tokens, m.pos, m.marker FROM quarry_turns LEFT JOIN LATERAL quarry_markers(concat(text, ' [BNSS s.', turn, '] [x]')) m")


# ---- the same in SQL ------------------------------------------------------------------------------------------
_q = language._q
_STAGE = "CASE event_type WHEN 'signup' THEN 'parsing' WHEN 'click' THEN 'chunking' WHEN 'view' THEN 'embedding' WHEN 'purchase' THEN 'ready' ELSE 'failed' END"
_STATUS = f"st AS (SELECT user_id, CASE WHEN stage = 'failed' AND failures < 30 THEN 'queued' ELSE stage END AS status, CASE stage WHEN 'ready' THEN 1 WHEN 'failed' THEN 0 ELSE round(share, 2) END AS progress, failures FROM (SELECT user_id, arg_max({_STAGE}, (ts, event_id)) AS stage, arg_max(least(1::DOUBLE, abs(value) / 200), (ts, event_id)) AS share, count(*) FILTER ({_STAGE} = 'failed') AS failures FROM events GROUP BY user_id)), full_ AS (SELECT *, CASE status WHEN 'parsing' THEN 1 WHEN 'chunking' THEN 2 WHEN 'embedding' THEN 3 WHEN 'ready' THEN 4 ELSE 0 END AS at_ FROM st)"
_case = lambda column, texts: f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {_q(t)}" for k, t in texts.items() if k) + f" ELSE {_q(texts[None])} END"
_CARDS = f"""{language._BOUND}, firsts AS (SELECT aid, text AS marker, arg_min(ctx, pos) AS idx, arg_min(coalesce(subs, ''), pos) AS subs, min(pos) AS pos FROM bound WHERE ctx IS NOT NULL GROUP BY aid, text),
cards AS (SELECT f.aid, row_number() OVER (PARTITION BY f.aid ORDER BY f.pos) AS number, marker, coalesce(nullif(source, ''), 'statute') AS source, nullif(act_short, '') AS act_short, nullif(section_number, '') AS section_number, nullif(document_name, '') AS document_name, coalesce(CASE WHEN subs <> '' AND contains(marker, subs) THEN subs END, nullif(subsection, '')) AS subsection, page_start, page_end, coalesce(c.text, '') AS text FROM firsts f JOIN ctx c USING (aid, idx))"""
_SEE = "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size || '(' || (p_partkey % 3) || ')' WHEN 2 THEN p_size || ', ' || (p_size + 1) || ' and ' || (p_size + 2) || '(1)(a)' ELSE p_size || ' and  ' || (p_size + 9) END"
_split = lambda c: f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[,\\s]+and\\s+|,\\s*'), lambda s: trim(s)), lambda s: s <> '')"
_FORM_TITLES = f"""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
l AS (SELECT doc_id, line_no, {language._trim(_FORM_LINE)} AS t FROM l0), w AS (SELECT *, list(t) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS below FROM l),
f AS (SELECT doc_id, line_no, regexp_extract(t, {_q(V.FORM_HEADER)}, 1)::BIGINT AS form_number, list_filter(below, lambda x: x <> '') AS b FROM w WHERE regexp_matches(t, {_q(V.FORM_HEADER)})),
s AS (SELECT *, coalesce(list_position(list_transform(b, lambda x: regexp_matches(x, {_q(V.SEE_REFERENCE)})), true), 0) AS at_ FROM f)
SELECT doc_id, line_no, form_number, {language._trim(f"regexp_replace(coalesce(array_to_string(b[1:CASE WHEN at_ BETWEEN 1 AND 4 THEN at_ - 1 ELSE 3 END], ' '), ''), '{language._SP}+', ' ', 'g')")} AS title, CASE WHEN at_ BETWEEN 1 AND 4 THEN regexp_extract(b[at_], {_q(V.SEE_REFERENCE)}, 1) END AS see FROM s"""
_TITLED = language._TITLE.replace("list_zip(w, range(len(w)))", "list_zip(w, range(len(w)))")

SQL = {
    "payload_scroll": "SELECT doc_id, source, n_chars FROM documents WHERE source = 'src7' AND lang = 'en' ORDER BY doc_id LIMIT 50",
    "ingest_status": f"WITH {_STATUS} SELECT user_id, status, progress, failures FROM full_",
    "ready_documents": f"WITH {_STATUS} SELECT user_id FROM full_ WHERE status = 'ready'",
    "stage_bar": f"WITH {_STATUS} SELECT user_id, CASE WHEN status <> 'failed' THEN round(greatest(6, least(100, CASE WHEN status = 'ready' THEN 100 ELSE greatest(progress * 100, at_ / 4 * 100 - 12) END)), 2) END AS percent FROM full_",
    "retry_backoff": "SELECT event_id, round(least(1200 * pow(1.4::DOUBLE, event_id % 9), 5000), 3) AS poll_ms, 5000 * pow(2::DOUBLE, event_id % 9 % 2) AS retry_ms FROM events",
    "session_records": "WITH held AS (SELECT event_id % 1000 AS key, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE event_id % 1000 % 7 > 0 GROUP BY 1) SELECT DISTINCT user_id, key, held.event_id, held.event_type FROM (SELECT user_id, event_id % 1000 AS key FROM events) JOIN held USING (key)",
    "public_documents": "SELECT doc_id::VARCHAR AS id, source || '.pdf' AS filename, coalesce(nullif(lang, ''), 'queued') AS status, coalesce(n_chars, 0) AS bytes, nullif(n_chars // 3000, 0) AS pages, CASE WHEN coalesce(n_chars, 0) = 0 THEN '' WHEN n_chars * 700 / 1024 < 1024 THEN floor(n_chars * 700 / 1024 + 0.5::DOUBLE)::BIGINT || ' KB' ELSE format('{:.1f}', floor(n_chars * 700 / 1024 / 1024 * 10 + 0.5::DOUBLE) / 10) || ' MB' END AS size, right(regexp_replace(source || ' é/' || doc_id || '.pdf', '[^A-Za-z0-9_.-]', '_', 'g'), 80) AS safe FROM documents",
    "cors_origins": f"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) IN ({', '.join(_q(a.rstrip('/')) for a in ALLOWED)}) AS allowed FROM pages",
    "refusal_texts": f"SELECT qid, {_case('CASE WHEN rule IS NOT NULL THEN ' + _q('injection') + ' END', V.REFUSALS)} AS told FROM ({language.SQL['injection_scan']}) UNION ALL SELECT 'e' || event_id, {_case("CASE event_type WHEN 'error' THEN 'internal_error' WHEN 'view' THEN 'not_found' WHEN 'click' THEN 'rate_limited' END", V.ERRORS)} FROM events",
    "readiness": "SELECT ts::DATE AS day, bool_and(event_type <> 'error' OR value < 180) AS ready, CASE WHEN bool_and(event_type <> 'error' OR value < 180) THEN 200 ELSE 503 END AS code FROM events GROUP BY 1",
    "citation_cards": f"WITH {_CARDS} SELECT * FROM cards",
    "citation_labels": f"WITH {_CARDS} SELECT aid, number, CASE WHEN source = 'document' THEN concat_ws(' ', document_name, CASE WHEN page_start <> 0 THEN CASE WHEN page_end <> 0 AND page_end <> page_start THEN 'pp. ' || page_start || '-' || page_end ELSE 'p. ' || page_start END END) ELSE act_short || ' s.' || concat_ws('', section_number, subsection) END AS label FROM cards",
    "ui_markers": f"WITH {_CARDS}, {language._VALID[len(language._BOUND) + 2 :]}, cut AS (SELECT aid, string_split(regexp_replace(text, {_q(V.UI_MARKER)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS ps FROM final), flat AS (SELECT aid, unnest(ps) AS part, unnest(range(len(ps))) AS i FROM cut), parts_ AS (SELECT aid, part, i % 2 = 1 AS is_marker, row_number() OVER (PARTITION BY aid ORDER BY i) - 1 AS pos FROM flat WHERE part <> '') SELECT p.aid, pos, part, is_marker, number FROM parts_ p LEFT JOIN cards c ON p.aid = c.aid AND part = marker",
    "see_sections": f"SELECT p_partkey, array_to_string(s, '|') AS sections, nullif(regexp_replace(s[1], '\\(.*', ''), '') AS first FROM (SELECT p_partkey, {_split(_SEE)} AS s FROM part)",
    "form_chunks": f"WITH {parsing._FORMS}, f AS (SELECT *, list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> '') AS w, {_split('see')} AS s FROM forms) SELECT manifest, 'bnss-form-' || CASE WHEN length(form_number::VARCHAR) >= 3 THEN form_number::VARCHAR ELSE lpad(form_number::VARCHAR, 3, '0') END AS chunk_id, nullif(regexp_replace(s[1], '\\(.*', ''), '') AS section_number, sha256('The Second Schedule to the BNSS prescribes Form No. ' || form_number || ', ' || {_TITLED} || CASE WHEN len(s) > 0 THEN ' under section ' || array_to_string(s, ' and ') || ' of the BNSS' ELSE '' END || '.') AS text_sha256, array_to_string(list_transform(s, lambda x: regexp_replace(x, '\\(.*', '')), '|') AS refs FROM f",
    "manifest_header": f"WITH {parsing._FORMS} SELECT manifest, count(*) AS form_count, sha256(string_agg(form_number || ':' || title, chr(10) ORDER BY form_number)) AS sha256 FROM forms GROUP BY manifest",
    "form_titles": _FORM_TITLES,
    "margin_notes": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS page FROM documents), b AS (SELECT doc_id, page, t || CASE WHEN page % 3 = 0 THEN '. 45 of 1860. The Code. ' ELSE '' END AS text FROM l WHERE t <> ''), p AS (SELECT doc_id, page, string_split(regexp_replace(text, '(\\.)\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM b), f AS (SELECT doc_id, page, trim(unnest(ps)) AS x, unnest(range(len(ps))) AS i FROM p) SELECT doc_id, page, count(*) AS n, sha256(string_agg(x, chr(10) ORDER BY i)) AS notes_sha256 FROM f WHERE x <> '' AND NOT regexp_matches(x, '^\\d+\\s+of\\s+\\d{4}\\b') GROUP BY ALL",
    "table_region": "WITH r AS (SELECT l_orderkey // 500 AS doc_id, (l_orderkey // 50 % 10)::INTEGER AS page, l_orderkey % 50 AS line_no, l_linenumber * 60 AS x, CASE WHEN l_orderkey % 5 = 1 THEN (1 + l_linenumber % 6)::VARCHAR WHEN l_orderkey % 31 = 7 AND l_linenumber = 1 THEN 'II. - Other acts' ELSE 'r' || l_linenumber END AS str FROM lineitem), l AS (SELECT doc_id, page, line_no, count(*) AS n, count(*) >= 4 AND bool_and(regexp_matches(str, '^[1-6]$')) AS numbers, regexp_matches(string_agg(str, ' ' ORDER BY x, str), '^II\\.\\s*[—–-]') AS two FROM r GROUP BY ALL), e AS (SELECT *, min(line_no) FILTER (two) OVER (PARTITION BY doc_id, page) AS stop FROM l), s AS (SELECT *, max(line_no) FILTER (numbers) OVER (PARTITION BY doc_id, page) AS start FROM e WHERE stop IS NULL OR line_no < stop) SELECT doc_id, page, line_no, n FROM s WHERE line_no > coalesce(start, -1)",
}
#: Folds and ordered state: tests/test_edges.py compares with brute force in Python.
NO_SQL = ("split_runs", "concurrency_cap", "sql_functions", "sweep_configs", "answer_pass")
QUERIES = {name: globals()[name] for name in (*SQL, *NO_SQL)}
