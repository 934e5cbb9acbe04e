"""Streams with state: cut bytes, a batch that is written and not committed, records that expire and come back."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import files
from quarry.streaming import states as S

BODY = "event: token\ndata: é😀 a\n\ndata: b\r\ndata: ü\r\n\r\n: comment\n\ndata: [DONE]\n\ndata: late\n\n"


def test_bytes_cut_anywhere(spark):
    raw = BODY.encode()
    whole = [tuple(f) for f in spark.createDataFrame([(BODY,)], "t string").select(files.frames(F.col("t")).alias("f")).first()["f"]]
    for cut in range(len(raw) + 1):
        frames = S.Frames()
        got = [*frames.feed(raw[:cut])]
        again = S.Frames(frames.rest, frames.ended)  # as a batch finds its state
        assert got + [*again.feed(raw[cut:])] == whole
    frames = S.Frames()
    assert [f for i in range(len(raw)) for f in frames.feed(raw[i : i + 1])] == whole
    pieces = spark.createDataFrame([(c, i, bytearray(raw[i : i + 3 + c])) for c in (0, 1) for i in range(0, len(raw), 3 + c)] + [(None, 0, bytearray(raw)), (2, 0, None)], "key long, seq long, piece binary")
    got = sorted(map(tuple, S.frame_fold(pieces, "key", "seq", "piece").collect()), key=repr)
    assert got == sorted(((k, i, *f) for k in (0, 1, None) for i, f in enumerate(whole)), key=repr)


def test_written_and_not_committed(spark, tmp_path):
    """The second batch is written, and the query is lost before it commits: the rerun overwrites it."""
    folder = tmp_path / "in"
    log = lambda rows: spark.createDataFrame(rows, "job long, at timestamp, seq long, stage string, share double")
    when = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    log([(1, when(0), 1, "parsing", 0.5), (1, when(1), 2, "failed", None), (2, when(2), 3, "failed", None)]).write.parquet(str(folder))
    stream = lambda: S.jobs(spark.readStream.schema("job long, at timestamp, seq long, stage string, share double").parquet(str(folder)), "job", "at", "seq", "stage", "share")
    S.once_each(stream(), str(tmp_path / "s"))
    log([(1, when(20), 4, "ready", 1.0), (2, when(21), 5, "failed", None), (2, when(22), 6, "parsing", 0.1)]).write.mode("append").parquet(str(folder))

    def lost(number):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        S.once_each(stream(), str(tmp_path / "s"), lost)
    rows = S.once_each(stream(), str(tmp_path / "s")).collect()
    second = lambda r: (r["at"] - 1_704_067_200_000) // 1000
    got = sorted((r["key"], second(r), r["status"], r["failures"]) for r in rows)
    assert got == [(1, 0, "parsing", 0), (1, 1, "failed", 1), (1, 6, "queued", 1), (1, 20, "ready", 1), (2, 2, "failed", 1), (2, 7, "queued", 1), (2, 21, "failed", 2), (2, 22, "parsing", 0)]


def test_record_expires_and_comes_back(spark, tmp_path):
    day = lambda n: __import__("datetime").datetime(2024, 1, n)
    ops = [("a", day(1), 1, "put", "t"), ("a", day(2), 2, "push", "x"), ("a", day(5), 3, "push", "y"), ("a", day(6), 4, "put", "new"), ("a", day(7), 5, "push", "z"), ("b", day(1), 6, "rename", "none")]
    spark.createDataFrame(ops, "k string, at timestamp, seq long, op string, value string").write.parquet(str(tmp_path / "in"))
    rows = S.once_each(S.records(spark.readStream.schema("k string, at timestamp, seq long, op string, value string").parquet(str(tmp_path / "in")), "k", "at", "seq", "op", "value", days=2, held=1)).orderBy("seq").collect()
    assert [(r["found"], r["title"], r["messages"]) for r in rows] == [(False, "t", []), (True, "t", ["x"]), (False, None, []), (False, "new", []), (True, "new", ["z"]), (False, None, [])]
