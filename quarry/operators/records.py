"""Conversations, usage, limits and metrics: keyed views and aggregates over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import values as V


def newest(rows: DataFrame, owner: str, at: str, key: str, n: int = 50) -> DataFrame:
    """The n newest rows of each owner, with their rank."""
    order = Window.partitionBy(owner).orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def history(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each conversation, numbered oldest first."""
    last = messages.withColumn("_r", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("_r") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy(conv).orderBy(turn))).drop("_r")


def last_by_role(messages: DataFrame, role: str = "user", conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return messages.where(F.col("role") == role).groupBy(conv).agg(F.max(turn).alias(turn), F.max_by("text", turn).alias("text"))


def alive(rows: DataFrame, updated: str, now: Column, days: int = 30) -> DataFrame:
    """Rows whose time to live has not run out."""
    return rows.where(F.col(updated) > now - F.make_interval(days=F.lit(days)))


def date_bucket(at: Column, now: Column) -> Column:
    """Today, Yesterday, Previous 7 days, Previous 30 days or Older, by midnight."""
    days = F.date_diff(F.to_date(now), F.to_date(at))
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "Previous 7 days").when(days <= 30, "Previous 30 days").otherwise("Older")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """In dollars, to six places; halves are decided on millionths."""
    return F.round((tokens_in * V.INPUT_RATE + tokens_out * V.OUTPUT_RATE) / 1e6 * 1e6) / 1e6


def daily_spend(events: DataFrame, at: str, usd: str) -> DataFrame:
    """(day, spent) by UTC day; amounts that are not positive are ignored."""
    return events.where(F.col(usd) > 0).groupBy(F.to_date(at).alias("day")).agg(F.sum(usd).alias("spent"))


def budget_trips(events: DataFrame, at: str, key: str, usd: str, ceiling: float) -> DataFrame:
    """Events with spent_before (that day) and refused: whether the ceiling had been reached; a ceiling of 0 is off.
    Hours are summed first, so that what is ordered together is one hour, and a day's running sum is over hours."""
    rows = events.withColumn("day", F.to_date(at)).withColumn("hour", F.hour(at)).withColumn("usd", F.greatest(F.col(usd), F.lit(0.0)))
    hours = rows.groupBy("day", "hour").agg(F.sum("usd").alias("in_hour"))
    before = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("day", "hour", F.coalesce(F.sum("in_hour").over(before), F.lit(0.0)).alias("_hours"))
    inside = Window.partitionBy("day", "hour").orderBy(at, key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(hours, ["day", "hour"]).withColumn("spent_before", F.col("_hours") + F.coalesce(F.sum("usd").over(inside), F.lit(0.0)))
    return rows.withColumn("refused", (F.lit(ceiling) > 0) & (F.round("spent_before", 6) >= ceiling)).drop("_hours", "hour", "usd")


def fixed_window(events: DataFrame, key: str, at: str, event_id: str, limit: int, seconds: float) -> DataFrame:
    """(key, event_id, allowed): a window opens at a key's first hit and lasts `seconds`; hits over the limit are
    refused. A key's hits stream through one task in order; only its window is held."""
    micros = int(seconds * 1_000_000)

    def run(batches):
        import pyarrow as pa

        now, start, hits = None, 0, 0
        for batch in batches:
            keys, times = batch.column("key").to_pylist(), batch.column("at").to_pylist()
            allowed = []
            for k, t in zip(keys, times, strict=True):
                if k != now or t >= start + micros:
                    now, start, hits = k, t, 0
                hits += 1
                allowed.append(hits <= limit)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), pa.array(allowed, pa.bool_())], names=["key", "event_id", "allowed"])

    rows = events.select(F.col(key).alias("key"), F.col(event_id).alias("event_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    kinds = dict(rows.dtypes)
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, f"key {kinds['key']}, event_id {kinds['event_id']}, allowed boolean")


def in_flight(intervals: DataFrame, owner: str, start: str, end: str) -> DataFrame:
    """(owner, at, in_flight): how many intervals of an owner are open after each start; ends at the same time count
    first."""
    moves = intervals.select(owner, F.col(start).alias("at"), F.lit(1).alias("move")).unionByName(intervals.select(owner, F.col(end).alias("at"), F.lit(-1).alias("move")))
    order = Window.partitionBy(owner).orderBy("at", "move").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("in_flight", F.sum("move").over(order)).where("move = 1").drop("move")


def sliding_rate(events: DataFrame, at: str, label: str, width: str, slide: str, seconds: float) -> DataFrame:
    """(start, label, rate): events per second in sliding windows."""
    windows = events.groupBy(F.window(F.col(at).cast("timestamp"), width, slide).alias("w"), label).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("start"), label, (F.col("n") / seconds).alias("rate"))


def histogram(events: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, le, n): cumulative counts per bound; the last bound is infinite (null)."""
    counts = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(label).agg(*counts, F.count("*").alias("b_all"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("b_all").alias("n")))
    return wide.select(label, F.inline(rows))


def histogram_quantile(buckets: DataFrame, label: str, q: float) -> DataFrame:
    """(label, value): interpolated inside the bucket that the quantile falls in; the last finite bound if that is the
    infinite one."""
    order = Window.partitionBy(label).orderBy(F.asc_nulls_last("le"))
    rows = buckets.withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
    rows = rows.withColumn("want", F.max("n").over(Window.partitionBy(label)) * q).where("n >= want").withColumn("r", F.row_number().over(order)).where("r = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("below")) / (F.col("n") - F.col("below"))
    return rows.select(label, F.when(F.col("le").isNull(), F.col("low")).when(F.col("n") == F.col("below"), F.col("le")).otherwise(inside).alias("value"))


def percentiles(rows: DataFrame, label: str, value: str, ps: dict[str, float]) -> DataFrame:
    """(label, one column per p): the value at index floor(n * p) of a label's values in order, not interpolated; nulls
    are no values, and a label without any gets 0. Equal values are counted first; only counts are ordered."""
    counts = rows.groupBy(label, value).agg(F.count(value).alias("n"))
    upto, all_ = Window.partitionBy(label).orderBy(F.asc_nulls_first(value)), Window.partitionBy(label)
    placed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(all_))
    at = lambda p: F.least(F.col("total") - 1, F.floor(F.col("total") * p))
    first = lambda p: F.min(F.when(F.col("upto") > at(p), F.col(value)))
    return placed.groupBy(label).agg(*(F.coalesce(first(p), F.lit(0.0)).alias(name) for name, p in ps.items()))


def ranking_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: hit@1, recall@5, recall@10 and MRR@10 over the questions of expected (qid, id); a question counts as
    found where any expected id is. results: qid, id, rank."""
    best = expected.join(results.where(F.col("rank") <= 10), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("best"))
    rows = expected.select("qid").distinct().join(best, "qid", "left")
    within = lambda k: F.round(F.avg((F.coalesce(F.col("best"), F.lit(99)) <= k).cast("double")), 3)
    return rows.agg(F.count("*").alias("n"), within(1).alias("hit1"), within(5).alias("recall5"), within(10).alias("recall10"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 3).alias("mrr10"))
