"""State machines over streams: ingest jobs with retries, records that expire, and frames put together from bytes.

A key's state lives in the state store (RocksDB) between batches; rows of a key are taken in order inside a batch. What a
batch gives goes to a folder of its number, which it overwrites, so that a batch that ran twice, or was written and not
committed, leaves its rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quarry.sources.tables import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tries of a job, milliseconds before the first retry (each later one waits twice as long), days that a record
#: lives after it was last written, and the messages that it holds.
ATTEMPTS, RETRY_MS, TTL_DAYS, HELD = 2, 5000, 30, 50
DAY_MS = 86_400_000


def once_each(rows: DataFrame, at: str | None = None, after=None) -> DataFrame:
    """Runs the stream over what is there, and reads what its batches have left; `at` is the folder of its checkpoint and
    output, for a stream that goes on. after: called with each batch's number when its rows are written."""
    spark = rows.sparkSession
    at = at or shared_folder(spark, "streams")
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
            if after:
                after(number)

        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, was)
    return spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{at}/out").drop("batch")


class Jobs(StatefulProcessor):
    """A job's stage, what is done of it, how often it has failed, and when it is tried again.

    A failure that is not the last of ATTEMPTS sets a timer; what comes first, the timer or a row that is later than it, queues
    the job again. The last failure is final, and readiness too: what follows is a new job."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "failures long, due long")

    def _queued(self, key, due: int, failures: int) -> Row:
        return Row(key=key, at=due, seq=None, status="queued", progress=0.0, failures=failures)

    def handleInputRows(self, key, rows, timerValues):
        failures, due = tuple(self.state.get()) if self.state.exists() else (0, None)
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if due is not None and due <= r["at"]:
                yield self._queued(key[0], due, failures)
            if due is not None:
                self.handle.deleteTimer(due)
                due = None
            status, progress = r["stage"], r["share"] or 0.0
            if status == "failed":
                failures, progress = failures + 1, 0.0
                if failures < ATTEMPTS:
                    due = r["at"] + RETRY_MS * 2 ** (failures - 1)
                    self.handle.registerTimer(due)
            elif status == "ready":
                progress = 1.0
            yield Row(key=key[0], at=r["at"], seq=r["seq"], status=status, progress=progress, failures=failures)
            if status == "ready" or failures >= ATTEMPTS:
                failures = 0
        self.state.update((failures, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        failures, due = tuple(self.state.get())
        if due is not None and due == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((failures, None))
            yield self._queued(key[0], due, failures)

    def close(self) -> None:
        pass


def jobs(log: DataFrame, key: str, at: str, seq: str, stage: str, share: str) -> DataFrame:
    """(key, at in milliseconds, seq, status, progress, failures): a row for each stage event of a job, and one with no seq
    for each time that it is queued again."""
    rows = log.withColumn("_time", F.col(at).cast("timestamp")).withWatermark("_time", "0 seconds")
    rows = rows.select(F.col(key).alias("key"), F.unix_millis("_time").alias("at"), F.col(seq).alias("seq"), F.col(stage).alias("stage"), (F.floor(F.col(share) * 100 + 0.5) / 100).alias("share"), "_time")
    kinds = dict(rows.dtypes)
    return rows.groupBy("key").transformWithState(Jobs(), f"key {kinds['key']}, at long, seq {kinds['seq']}, status string, progress double, failures long", "Append", "EventTime")


class Records(StatefulProcessor):
    """A record and its last messages under a key, as a key-value store holds them: put, rename, push, delete.

    A record lives so many days after its last write, by the time of the rows: one that comes later finds none, and a timer
    clears what no row has come for. (The store's own TTL goes by the clock, which no rerun gives again, and keeps a stream that
    runs to its end from ending.)"""

    def __init__(self, days: float, held: int):
        self.ttl, self.held = int(days * DAY_MS), held

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "title string, until long")
        self.messages = handle.getListState("messages", "text string")

    def handleInputRows(self, key, rows, timerValues):
        title, until = tuple(self.record.get()) if self.record.exists() else (None, None)
        held = [m[0] for m in self.messages.get()] if self.messages.exists() else []
        was = until
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if until is not None and r["at"] >= until:
                title, until, held = None, None, []
            found = until is not None
            if r["op"] == "put":
                title, until, held = r["value"], r["at"] + self.ttl, []
            elif r["op"] == "delete":
                title, until, held = None, None, []
            elif found and r["op"] == "rename":
                title, until = r["value"], r["at"] + self.ttl
            elif found and r["op"] == "push":
                held, until = [*held, r["value"]][-self.held :], r["at"] + self.ttl
            yield Row(key=key[0], seq=r["seq"], found=found, title=title, messages=list(held))
        if was is not None and was != until:
            self.handle.deleteTimer(was)
        self.messages.clear()
        if until is None:
            self.record.clear()
            return
        self.record.update((title, until))
        self.handle.registerTimer(until)
        if held:
            self.messages.put([(m,) for m in held])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.record.exists() and self.record.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.record.clear()
            self.messages.clear()
        return iter(())

    def close(self) -> None:
        pass


def records(ops: DataFrame, key: str, at: str, seq: str, op: str, value: str, days: float = TTL_DAYS, held: int = HELD) -> DataFrame:
    """(key, seq, found, title, messages): for each operation, whether it found a record, and what there is after it."""
    rows = ops.withColumn("_time", F.col(at).cast("timestamp")).withWatermark("_time", "0 seconds")
    rows = rows.select(F.col(key).alias("key"), F.unix_millis("_time").alias("at"), F.col(seq).alias("seq"), F.col(op).alias("op"), F.col(value).cast("string").alias("value"), "_time")
    kinds = dict(rows.dtypes)
    return rows.groupBy("key").transformWithState(Records(days, held), f"key {kinds['key']}, seq {kinds['seq']}, found boolean, title string, messages array<string>", "Append", "EventTime")


class Frames:
    """Frames of an event stream from bytes that are cut anywhere: lines are split as bytes and decoded whole, so that
    neither a line nor a character is lost between two pieces. `rest` is all that has to be kept; what no blank line has ended
    is no frame yet."""

    def __init__(self, rest: bytes = b"", ended: bool = False):
        self.rest, self.ended = rest, ended

    def feed(self, piece: bytes):
        """(event, data) of each frame that the piece completes; none after a frame whose data is [DONE]."""
        self.rest = (self.rest + (piece or b"")).replace(b"\r\n", b"\n")
        while not self.ended and (cut := self.rest.find(b"\n\n")) >= 0:
            block, self.rest = self.rest[:cut].decode("utf-8", "replace"), self.rest[cut + 2 :]
            event, data = "message", []
            for line in block.split("\n"):
                if line.startswith("event:"):
                    event = line[6:].strip()
                elif line.startswith("data:"):
                    data.append(line[6:] if line.startswith("data: ") else line[5:])
            if data == ["[DONE]"]:
                self.ended, self.rest = True, b""
            elif data:
                yield event, "\n".join(data)


class FrameStream(StatefulProcessor):
    def init(self, handle) -> None:
        self.state = handle.getValueState("frames", "rest binary, ended boolean, n long")

    def handleInputRows(self, key, rows, timerValues):
        rest, ended, n = tuple(self.state.get()) if self.state.exists() else (b"", False, 0)
        frames = Frames(bytes(rest), ended)
        for r in sorted(rows, key=lambda r: r["seq"]):
            for event, data in frames.feed(bytes(r["piece"] or b"")):
                yield Row(key=key[0], i=n, event=event, data=data)
                n += 1
        self.state.update((frames.rest, frames.ended, n))

    def close(self) -> None:
        pass


def frame_stream(deltas: DataFrame, key: str, seq: str, piece: str) -> DataFrame:
    """(key, i, event, data) of pieces of bytes: frames of each key in order, from 0."""
    rows = deltas.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(piece).cast("binary").alias("piece"))
    return rows.groupBy("key").transformWithState(FrameStream(), f"key {dict(rows.dtypes)['key']}, i long, event string, data string", "Append", "None")


def frame_fold(deltas: DataFrame, key: str, seq: str, piece: str) -> DataFrame:
    """The same of a table: a task runs through its keys' pieces in order, and holds the rest of one."""
    rows = deltas.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(piece).cast("binary").alias("piece"))

    def run(batches):
        import pyarrow as pa

        now, frames, n, first = None, Frames(), 0, True
        for batch in batches:
            out = ([], [], [], [])
            for k, p in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if first or k != now:
                    now, frames, n, first = k, Frames(), 0, False
                for event, data in frames.feed(p or b""):
                    for column, value in zip(out, (k, n, event, data), strict=True):
                        column.append(value)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("key").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["key", "i", "event", "data"])

    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, f"key {dict(rows.dtypes)['key']}, i long, event string, data string")
