"""Queries on streams with state: ingest jobs, records that expire, and frames from bytes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.sources.tables import table
from quarry.streaming import pipelines as P
from quarry.streaming import states as S

#: A record's days and messages in these queries, short enough for records of `events` to run out.
DAYS, HELD = 1.0, 3


def _stage() -> str:
    return "CASE event_type WHEN 'signup' THEN 'parsing' WHEN 'click' THEN 'chunking' WHEN 'view' THEN 'embedding' WHEN 'purchase' THEN 'ready' ELSE 'failed' END"


def job_log(events: DataFrame) -> DataFrame:
    return S.jobs(events.select("user_id", "ts", "event_id", F.expr(_stage()).alias("stage"), F.expr("least(1D, abs(value) / 200)").alias("share")), "user_id", "ts", "event_id", "stage", "share")


def stream_jobs(spark, d):
    """What becomes of each user's job at each event, and when it is tried again."""
    rows = S.once_each(job_log(P.stream(spark, d, "events")))
    return rows.select(F.col("key").alias("user_id"), F.col("at").alias("at_ms"), F.col("seq").alias("event_id"), "status", "progress", "failures")


def stream_records(spark, d):
    """Events as operations on a record of each user."""
    op = F.expr("CASE event_type WHEN 'signup' THEN 'put' WHEN 'view' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'push' END")
    ops = P.stream(spark, d, "events").select("user_id", "ts", "event_id", op.alias("op"))
    rows = S.once_each(S.records(ops.withColumn("value", F.col("event_id")), "user_id", "ts", "event_id", "op", "value", DAYS, HELD))
    return rows.select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "found", "title", F.array_join("messages", ",").alias("messages"))


def _pieces(turns: DataFrame) -> DataFrame:
    """Each turn's frame in pieces of a few bytes, which end inside characters and lines."""
    frame = X.sse_frame(F.col("role"), F.regexp_replace("text", "\n", "\ndata: ")).cast("binary")
    rows = turns.select("conv_id", "turn", frame.alias("frame"), (1 + F.pmod("conv_id", F.lit(11))).cast("int").alias("step"))
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(1), F.octet_length("frame"), F.col("step"))).alias("k", "start"))
    return rows.select("conv_id", (F.col("turn") * 1_000_000 + F.col("k")).alias("seq"), F.substring("frame", F.col("start"), F.col("step")).alias("piece"))


def _framed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("conv_id"), "i", F.col("event").alias("role"), F.sha2(F.col("data").cast("binary"), 256).alias("text_sha256"))


def stream_frames(spark, d):
    return _framed(S.once_each(S.frame_stream(_pieces(P.stream(spark, d, "conversations")), "conv_id", "seq", "piece")))


def fold_frames(spark, d):
    return _framed(S.frame_fold(_pieces(table(spark, d, "conversations")), "conv_id", "seq", "piece"))


# ---- the same in SQL ------------------------------------------------------------------------------------------
_FRAMES = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, sha256(text) AS text_sha256 FROM conversations"
SQL = {
    "stream_jobs": f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, {_stage()} AS stage, round(least(1, abs(value) / 200), 2) AS share FROM events),
g AS (SELECT *, count(*) FILTER (stage = 'ready') OVER (PARTITION BY user_id ORDER BY at_ms, event_id) - (stage = 'ready')::INTEGER AS job, lead(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS next_at FROM e),
n AS (SELECT *, count(*) FILTER (stage = 'failed') OVER (PARTITION BY user_id, job ORDER BY at_ms, event_id) AS nf FROM g)
SELECT user_id, at_ms, event_id, stage AS status, CASE stage WHEN 'failed' THEN 0 WHEN 'ready' THEN 1 ELSE share END::DOUBLE AS progress, CASE WHEN stage = 'failed' AND nf % 2 = 0 THEN 2 ELSE nf % 2 END AS failures FROM n
UNION ALL SELECT user_id, at_ms + {S.RETRY_MS}, NULL, 'queued', 0, 1 FROM n WHERE stage = 'failed' AND nf % 2 = 1 AND at_ms + {S.RETRY_MS} <= coalesce(next_at, (SELECT max(at_ms) FROM e))""",
    "stream_records": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'signup' THEN 'put' WHEN 'view' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'push' END AS op, event_id::VARCHAR AS value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS found, NULL::VARCHAR AS title, NULL::BIGINT AS until_, []::VARCHAR[] AS held FROM events
UNION ALL SELECT user_id, i, event_id, found, CASE op WHEN 'put' THEN value WHEN 'delete' THEN NULL WHEN 'rename' THEN CASE WHEN found THEN value END ELSE CASE WHEN found THEN title END END, CASE WHEN op = 'put' OR (op <> 'delete' AND found) THEN at_ms + {int(DAYS * S.DAY_MS)} END, CASE WHEN op IN ('put', 'delete') OR NOT found THEN [] WHEN op = 'push' THEN list_append(held, value)[-{HELD}:] ELSE held END
FROM (SELECT e.*, s.title, s.held, coalesce(e.at_ms < s.until_, false) AS found FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, event_id, found, title, array_to_string(held, ',') AS messages FROM s WHERE i > 0""",
    "stream_frames": _FRAMES,
    "fold_frames": _FRAMES,
}
QUERIES = {name: globals()[name] for name in SQL}
