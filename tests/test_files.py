"""Readers and writers."""

import json
import zipfile

from pyspark.sql import functions as F

from quarry.operators import index, sinks
from quarry.sources import files


def test_uploads_by_magic(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    got = {r["path"].rpartition("/")[2]: r["accepted"] for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}


def test_manifest_and_golden(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"act": "x", "forms": [{"form_number": 2, "title": "T"}, {"form_number": 1, "title": "U"}]}, indent=1))
    assert [r["title"] for r in files.manifest(spark, str(tmp_path / "m.json")).orderBy("form_number").collect()] == ["U", "T"]
    (tmp_path / "g.jsonl").write_text('{"q": "a", "expected_sections": ["1"], "type": "lookup"}\n\n{"q": "b", "type": "must_refuse"}\n')
    assert [r["must_refuse"] for r in files.golden(spark, str(tmp_path / "g.jsonl")).orderBy("q").collect()] == [False, True]


def test_frames(spark):
    body = "event: token\ndata: a\n\ndata: b\ndata: c\n\n: comment\n\ndata: [DONE]\n\ndata: late\n\n"
    got = spark.createDataFrame([(body,)], "t string").select(files.frames(F.col("t")).alias("f")).first()["f"]
    assert [tuple(f) for f in got] == [("token", "a"), ("message", "b\nc")]


def test_broken_json_lines_are_left_out(spark):
    got = spark.createDataFrame([('{"x": 1}\n{bad\n{"x": 2}',)], "t string").select(files.json_lines(F.col("t"), "x int").alias("j")).first()["j"]
    assert [j["x"] for j in got] == [1, 2]


def test_models(spark):
    df = spark.createDataFrame([("who may arrest", "police may arrest\nmore")], "q string, c string")
    row = df.select(files.ask("echo", F.col("q"), F.col("c")).alias("a"), files.ask("overlap", F.col("q"), F.col("c")).alias("s")).first()
    assert (row["a"], float(row["s"])) == ("police may arrest", 0.666667)


def test_index_round_trip(spark, tmp_path):
    t = index.tokens(spark.createDataFrame([(1, "bail bond bail"), (2, "arrest")], "d int, t string"), "d", "t")
    stats, df = index.corpus_stats(t), index.document_frequency(t)
    sinks.save_index(index.postings(t, stats), df, stats, str(tmp_path), 2)
    p, d, s = sinks.load_index(spark, str(tmp_path))
    assert p.count() == 3 and d.count() == 3 and tuple(s.first()) == (2, 2.0)


def test_exposition_and_sse(spark):
    series = spark.createDataFrame([("hits", {"a": 'x"y'}, 2.0), ("up", {}, 1.0)], "metric string, labels map<string,string>, value double")
    assert {r["value"] for r in sinks.exposition(series).collect()} == {'hits{a="x\\"y"} 2.0', "up 1.0"}
    events = spark.createDataFrame([(1, 2, "done", "{}"), (1, 1, "token", "a")], "stream int, seq int, event string, data string")
    assert sinks.sse(events).first()["body"] == "event: token\ndata: a\n\nevent: done\ndata: {}\n\n"


def test_archive_is_the_same_each_time(spark, tmp_path):
    df = spark.createDataFrame([("b.txt", b"2"), ("a.txt", b"1"), ("gone", None)], "name string, content binary")
    assert sinks.archive(df, tmp_path / "1.zip") == sinks.archive(df, tmp_path / "2.zip") == 2
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()
    assert zipfile.ZipFile(tmp_path / "1.zip").namelist() == ["a.txt", "b.txt"]
