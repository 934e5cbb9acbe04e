"""Streaming forms: daily spend, the fixed-window limiter and the marker gate, over file streams.

Each runs what is there (availableNow), with a checkpoint in the shared folder, and returns its sink as a table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import shared_folder


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; the brackets make the path a pattern, which file streams ask for."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}].parquet")


def finished(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream to its end and reads the sink; complete output replaces the sink at each trigger."""
    spark, at = rows.sparkSession, shared_folder(rows.sparkSession, "streams")
    writer = rows.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        query = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    else:
        query = writer.outputMode(mode).format("parquet").option("path", f"{at}/out").start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def daily_spend(events: DataFrame, at: str, usd: str) -> DataFrame:
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).where(F.col(usd) > 0).withWatermark("_at", "10 minutes")
    return timed.groupBy(F.window("_at", "1 day").alias("w")).agg(F.round(F.sum(usd), 4).alias("spent")).select(F.to_date("w.start").alias("day"), "spent")


def fixed_window(events: DataFrame, key: str, at: str, event_id: str, limit: int, seconds: float) -> DataFrame:
    """(key, event_id, allowed); a key's state is its window's start and hits."""
    micros = int(seconds * 1_000_000)

    def run(keys, frames, state):
        start, hits = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        allowed = []
        for t in rows["at"].tolist():
            if start is None or t >= start + micros:
                start, hits = t, 0
            hits += 1
            allowed.append(hits <= limit)
        state.update((start, hits))
        yield pd.DataFrame({"key": keys[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    rows = events.select(F.col(key).alias("key"), F.col(event_id).alias("event_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    kinds = dict(rows.dtypes)
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, event_id {kinds['event_id']}, allowed boolean", "start long, hits long", "append", "NoTimeout")


def gate(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, shown): text that may be shown after each delta: what follows an open bracket waits for the bracket
    that closes it."""

    def run(keys, frames, state):
        held = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("order")
        shown = []
        for delta in rows["text"].tolist():
            held += delta or ""
            at = held.rfind("[")
            cut = at if at >= 0 and "]" not in held[at:] else len(held)
            shown.append(held[:cut])
            held = held[cut:]
        state.update((held,))
        yield pd.DataFrame({"key": keys[0], "order": rows["order"].to_numpy(), "shown": shown})

    rows = deltas.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, order {kinds['order']}, shown string", "held string", "append", "NoTimeout")
