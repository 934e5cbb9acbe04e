"""Queries on sinks, conversations, usage, limits, metrics, evaluation and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import values as V
from quarry.operators import index as I
from quarry.operators import records as R
from quarry.operators import retrieval as S
from quarry.plans import search
from quarry.sources.tables import table, written
from quarry.streaming import pipelines as P

NOW = "2024-01-20 12:00:00"
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def _events(spark, d):
    return table(spark, d, "events")


def point_id_uuid(spark, d):
    return table(spark, d, "documents").select("doc_id", X.point_id(F.concat(F.lit("bnss-s"), "doc_id", F.lit("-000"))).alias("point_id"))


def upsert_latest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("version"), "n_chars")
    newer = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1).alias("doc_id"), F.lit(2).alias("version"), (F.col("n_chars") + 1).alias("n_chars"))
    return I.upsert(docs, newer, "doc_id", "version")


def purge_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return I.purge(docs, docs.where("source = 'src3' AND n_chars > 1000"), ["doc_id", "source"])


def conversation_list(spark, d):
    return R.newest(_events(spark, d), "user_id", "ts", "event_id", 50).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


def history_last6(spark, d):
    return R.history(table(spark, d, "conversations"), 6).select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


def conversation_titles(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", X.conversation_title(F.col("text")).alias("title"))


def date_buckets(spark, d):
    bucket = R.date_bucket(F.col("ts"), F.lit(NOW).cast("timestamp"))
    return _events(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def last_user_message(spark, d):
    return R.last_by_role(table(spark, d, "conversations")).select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def token_estimate_cost(spark, d):
    t = table(spark, d, "conversations").select("conv_id", R.token_estimate(F.col("text")).alias("n"), "role")
    sums = t.groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", F.col("n")).otherwise(0)).alias("tokens_in"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("tokens_out"))
    return sums.select("conv_id", "tokens_in", "tokens_out", R.cost(F.col("tokens_in"), F.col("tokens_out")).alias("cost_usd"))


def daily_spend(spark, d):
    return R.daily_spend(_events(spark, d), "ts", "value").select("day", F.round("spent", 4).alias("spent"))


def budget_trips(spark, d):
    rows = R.budget_trips(_events(spark, d), "ts", "event_id", "value", 2500.0)
    return rows.select("event_id", F.round("spent_before", 4).alias("spent_before"), "refused")


def fixed_window_limit(spark, d):
    return R.fixed_window(_events(spark, d), "user_id", "ts", "event_id", 1, 3600).select(F.col("key").alias("user_id"), "event_id", "allowed")


def concurrency_sweep(spark, d):
    spans = _events(spark, d).select("user_id", "ts", F.expr("ts + make_dt_interval(0, 0, 0, value * 600)").alias("until"))
    return R.in_flight(spans, "user_id", "ts", "until").groupBy("user_id").agg(F.max("in_flight").alias("most"), F.count_if(F.col("in_flight") > 2).alias("n_refused"))


def sliding_rate(spark, d):
    rows = R.sliding_rate(_events(spark, d), "ts", "event_type", "1 hour", "15 minutes", 3600.0)
    return rows.select(F.unix_seconds("start").alias("start"), "event_type", F.round("rate", 9).alias("rate"))


def rate_by_label(spark, d):
    rows = R.sliding_rate(_events(spark, d), "ts", "event_type", "1 day", "1 day", 86400.0)
    return rows.groupBy("event_type").agg(F.round(F.max("rate"), 9).alias("most"), F.round(F.sum("rate"), 6).alias("total"))


def histogram_buckets(spark, d):
    return R.histogram(_events(spark, d), "event_type", "value", BOUNDS)


def histogram_quantile(spark, d):
    buckets = R.histogram(_events(spark, d), "event_type", "value", BOUNDS)
    return R.histogram_quantile(buckets, "event_type", 0.95).select("event_type", F.round("value", 6).alias("p95"))


def cost_per_query(spark, d):
    days = _events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("usd"), F.count_if(F.col("event_type") == "view").alias("n"))
    return days.select("day", F.round(F.col("usd") / F.greatest(F.col("n").cast("double"), F.lit(0.0001)), 6).alias("usd_per_query"))


def eval_percentile(spark, d):
    return R.percentiles(_events(spark, d), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def _golden(spark, d):
    """Documents that hold an item word for word, and the item's every third term as the question. An item meets the
    documents that have its rarest run of letters, found by a join on words; `contains` then tells."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("doc"))
    # the inner words of an item stand in a document that holds it, whole; its first and last may be parts of longer ones
    words = lambda c: F.regexp_extract_all(c, F.lit("[^ \\n]+"), F.lit(0))
    inner = items.select("item_id", "text", F.explode(F.array_distinct(F.slice(words(F.col("text")), F.lit(2), F.greatest(F.size(words(F.col("text"))) - 2, F.lit(0))))).alias("word"))
    having = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("doc")))).alias("word")).join(inner.select("word").distinct(), "word", "left_semi")
    having = written(having, "having")
    rarest = inner.join(having.groupBy("word").agg(F.count("*").alias("n")), "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    near = having.join(rarest, "word").join(items, "item_id").join(docs, "doc_id").where(F.col("doc").contains(F.col("text")))
    # items of fewer than three words have no inner one
    short = items.where(F.size(words(F.col("text"))) < 3)
    if not short.isEmpty():
        near = near.select("item_id", "doc_id").unionByName(docs.join(short, F.col("doc").contains(F.col("text"))).select("item_id", "doc_id"))
    held = near.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id"))
    terms = items.select("item_id", F.posexplode(X.tokenize(F.col("text"))).alias("at", "term")).where("at % 3 = 0").select(F.col("item_id").alias("qid"), "term").distinct()
    return held, terms


def _legs(spark, d):
    held, terms = _golden(spark, d)
    sparse = search.best(spark, d, terms)
    return written(held, "held"), search._dense(spark, d), written(sparse, "sparse")


def eval_hit_recall_mrr(spark, d):
    held, _, sparse = _legs(spark, d)
    return R.ranking_metrics(sparse, held)


def eval_sweep_grid(spark, d):
    """The metrics of each configuration: legs, and the fusion's constant."""
    held, dense, sparse = _legs(spark, d)
    grid = {"dense": S.hybrid(dense, None), "sparse": S.hybrid(None, sparse), "hybrid_k20": S.hybrid(dense, sparse, 20), "hybrid_k60": S.hybrid(dense, sparse, 60)}
    out = None
    for name, rows in grid.items():
        one = R.ranking_metrics(rows, held).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def citation_accuracy(spark, d):
    """Share of answers that are grounded: nothing stripped, and one of the expected sections cited."""
    from quarry.operators import citations as C
    from quarry.plans.language import _answers

    answers, contexts = _answers(spark, d)
    # two of three documents are expected to be cited under their own number, the third under another
    expected = table(spark, d, "documents").select(F.expr("concat('d', doc_id)").alias("aid"), F.expr("array(CAST(doc_id % 97 + 1 + CASE WHEN doc_id % 3 = 2 THEN 50 ELSE 0 END AS STRING), CAST(doc_id % 97 + 3 AS STRING))").alias("expected"))
    bound = C.bind(C.markers(answers), contexts)
    facts = bound.groupBy("aid").agg(F.collect_set(F.when(F.col("ctx").isNotNull(), F.col("section"))).alias("cited"), F.max((F.col("text") == "") & (F.col("kind") != "other")).alias("stripped"))
    rows = expected.join(facts, "aid", "left")
    grounded = ~F.coalesce("stripped", F.lit(False)) & F.coalesce(F.arrays_overlap("cited", "expected"), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(grounded.cast("double")), 3).alias("accuracy"))


def stream_daily_spend(spark, d):
    return P.finished(P.daily_spend(P.stream(spark, d, "events"), "ts", "value"), "complete")


def stream_rate_limit(spark, d):
    return P.finished(P.fixed_window(P.stream(spark, d, "events"), "user_id", "ts", "event_id", 1, 3600)).select(F.col("key").alias("user_id"), "event_id", "allowed")


def stream_marker_gate(spark, d):
    """Turns as deltas of a stream each, some with a bracket that the next one closes."""
    turns = P.stream(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.expr("turn % 2 = 0"), F.concat("text", F.lit(" [BNSS s."))).otherwise(F.concat(F.lit("1] "), "text"))).alias("text"))
    rows = P.finished(P.gate(turns, "conv_id", "turn", "text"))
    return rows.select(F.col("key").alias("conv_id"), F.col("order").alias("turn"), F.sha2(F.col("shown").cast("binary"), 256).alias("shown_sha256"))


# ---- the same in SQL ------------------------------------------------------------------------------------------
_BUCKET = f"date_diff('day', ts::DATE, TIMESTAMP '{NOW}'::DATE)"
_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, event_id, rn, t AS start, 1 AS hits FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t >= w.start + 3600000000 THEN e.t ELSE w.start END, CASE WHEN e.t >= w.start + 3600000000 THEN 1 ELSE w.hits + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, event_id, hits <= 1 AS allowed FROM w"""
_SPEND = "SELECT ts::DATE AS day, round(sum(value), 4) AS spent FROM events WHERE value > 0 GROUP BY 1"
_HIST = "hist AS (SELECT event_type, le, count(*) FILTER (value <= le OR le IS NULL) AS n FROM events, (SELECT unnest([" + ", ".join(f"{b}::DOUBLE" for b in BOUNDS) + ", NULL]) AS le) GROUP BY ALL)"
_GOLD = f"held AS (SELECT item_id AS qid, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), thin AS (SELECT item_id AS qid, {search._terms('text')} AS ts FROM benchmark), thinned AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(ts) AS term, unnest(range(len(ts))) AS i FROM thin) WHERE i % 3 = 0)"
_BM = search.BM25.replace(f"qtok AS (SELECT DISTINCT item_id AS qid, unnest({search._terms('text')}) AS term FROM benchmark)", f"{_GOLD}, qtok AS (SELECT * FROM thinned)")


def _metrics(rows: str) -> str:
    return f"SELECT count(*) AS n, round(avg((coalesce(best, 99) <= 1)::INTEGER), 3) AS hit1, round(avg((coalesce(best, 99) <= 5)::INTEGER), 3) AS recall5, round(avg((coalesce(best, 99) <= 10)::INTEGER), 3) AS recall10, round(avg(coalesce(1 / best, 0)), 3) AS mrr10 FROM (SELECT DISTINCT qid FROM held) LEFT JOIN (SELECT qid, min(rank) AS best FROM held JOIN {rows} USING (qid, doc_id) WHERE rank <= 10 GROUP BY qid) USING (qid)"


_GRID = f"WITH {_BM}, {search._sparse_sql()}, {search._dense_sql()}, {search._hybrid_sql('g1', 'dense', None)}, {search._hybrid_sql('g2', None, 'sparse')}, {search._hybrid_sql('g3')}, {search._hybrid_sql('g4').replace('20::DOUBLE', '60::DOUBLE')} " + " UNION ALL ".join(f"SELECT *, '{c}' AS config FROM ({_metrics(g)})" for c, g in (("dense", "g1"), ("sparse", "g2"), ("hybrid_k20", "g3"), ("hybrid_k60", "g4")))

SQL = {
    "point_id_uuid": "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, sha1('bnss-s' || doc_id || '-000') AS h FROM documents)",
    "upsert_latest": "SELECT doc_id, version, n_chars FROM (SELECT doc_id, 1 AS version, n_chars FROM documents UNION ALL SELECT doc_id + 1, 2, n_chars + 1 FROM documents WHERE doc_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1",
    "purge_documents": "SELECT doc_id, source, n_chars FROM documents WHERE NOT (source = 'src3' AND n_chars > 1000)",
    "conversation_list": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 50",
    "history_last6": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)",
    "conversation_titles": "SELECT conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS title FROM (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)",
    "date_buckets": f"SELECT CASE WHEN {_BUCKET} <= 0 THEN 'Today' WHEN {_BUCKET} = 1 THEN 'Yesterday' WHEN {_BUCKET} <= 7 THEN 'Previous 7 days' WHEN {_BUCKET} <= 30 THEN 'Previous 30 days' ELSE 'Older' END AS bucket, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
    "last_user_message": "SELECT conv_id, max(turn) AS turn, sha256(arg_max(text, turn)) AS text_sha256 FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "token_estimate_cost": "SELECT conv_id, tokens_in, tokens_out, round((tokens_in * 0.1::DOUBLE + tokens_out * 0.4::DOUBLE) / 1000000, 6) AS cost_usd FROM (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN ceil(length(text) / 4) ELSE 0 END)::BIGINT AS tokens_in, sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 4) ELSE 0 END)::BIGINT AS tokens_out FROM conversations GROUP BY conv_id)",
    "daily_spend": _SPEND,
    "budget_trips": "SELECT event_id, round(before, 4) AS spent_before, round(before, 6) >= 2500 AS refused FROM (SELECT event_id, coalesce(sum(greatest(value, 0)) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)",
    "fixed_window_limit": _LIMIT,
    "concurrency_sweep": "WITH m AS (SELECT user_id, ts AS at_, 1 AS move FROM events UNION ALL SELECT user_id, ts + to_microseconds(round(value * 600000000)::BIGINT), -1 FROM events), f AS (SELECT *, sum(move) OVER (PARTITION BY user_id ORDER BY at_, move ROWS UNBOUNDED PRECEDING) AS fl FROM m) SELECT user_id, max(fl)::BIGINT AS most, count(*) FILTER (fl > 2) AS n_refused FROM f WHERE move = 1 GROUP BY user_id",
    "sliding_rate": "SELECT start, event_type, round(count(*) / 3600::DOUBLE, 9) AS rate FROM (SELECT event_type, unnest([epoch_us(ts) // 900000000 * 900 - 900 * i for i in range(4)]) AS start FROM events) GROUP BY ALL",
    "rate_by_label": "SELECT event_type, round(max(r), 9) AS most, round(sum(r), 6) AS total FROM (SELECT event_type, ts::DATE AS day, count(*) / 86400::DOUBLE AS r FROM events GROUP BY ALL) GROUP BY ALL",
    "histogram_buckets": f"WITH {_HIST} SELECT * FROM hist",
    "histogram_quantile": f"WITH {_HIST}, b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS low, max(n) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS want FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le NULLS LAST)) SELECT event_type, round(CASE WHEN le IS NULL THEN low WHEN n = below THEN le ELSE low + (le - low) * (want - below) / (n - below) END, 6) AS p95 FROM b WHERE n >= want QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le NULLS LAST) = 1",
    "cost_per_query": "SELECT ts::DATE AS day, round(sum(value) / greatest((count(*) FILTER (event_type = 'view'))::DOUBLE, 0.0001::DOUBLE), 6) AS usd_per_query FROM events GROUP BY 1",
    "eval_percentile": "SELECT event_type, " + ", ".join(f"v[least(len(v), floor(len(v) * {p}::DOUBLE)::INTEGER + 1)] AS p{int(p * 100)}" for p in (0.5, 0.95)) + " FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)",
    "eval_hit_recall_mrr": f"WITH {_BM}, {search._sparse_sql()} {_metrics('sparse')}",
    "eval_sweep_grid": _GRID,
    "citation_accuracy": "",
    "stream_daily_spend": _SPEND,
    "stream_rate_limit": _LIMIT,
    "stream_marker_gate": "WITH d AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' [BNSS s.' ELSE '1] ' || text END AS text FROM conversations), a AS (SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn) AS whole FROM d), s AS (SELECT conv_id, turn, regexp_replace(whole, '\\[[^\\]\\[]*$', '') AS shown FROM a), p AS (SELECT *, coalesce(lag(length(shown)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS was FROM s) SELECT conv_id, turn, sha256(substr(shown, was + 1)) AS shown_sha256 FROM p",
}
from quarry.plans import language as _language  # noqa: E402

SQL["citation_accuracy"] = f"WITH {_language._BOUND}, facts AS (SELECT aid, list(DISTINCT section) FILTER (ctx IS NOT NULL) AS cited, max(text = '' AND kind <> 'other') AS stripped FROM bound GROUP BY aid), exp AS (SELECT 'd' || doc_id AS aid, [(doc_id % 97 + 1 + CASE WHEN doc_id % 3 = 2 THEN 50 ELSE 0 END)::VARCHAR, (doc_id % 97 + 3)::VARCHAR] AS expected FROM documents) SELECT count(*) AS n, round(avg((NOT coalesce(stripped, false) AND coalesce(list_has_any(cited, expected), false))::INTEGER), 3) AS accuracy FROM exp LEFT JOIN facts USING (aid)"
QUERIES = {name: globals()[name] for name in SQL}
