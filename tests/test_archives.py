"""Archives are published whole or not at all."""

import os

import pytest

from quarry.sources import archives

SCHEMA = "name string, content binary"


def saved(df, folder, mode, **options):
    df.write.format("quarry_archive").options(**options).mode(mode).save(folder)


def test_archives_publish_whole_runs(spark, tmp_path):
    archives.register(spark)
    folder = f"file://{tmp_path}/a"
    read = lambda: sorted((r["name"], bytes(r["content"])) for r in spark.read.format("quarry_archive").load(folder).collect())
    runs = lambda: {x for x in os.listdir(tmp_path / "a") if x.startswith("run-")}
    first = [(f"{i}.txt", bytes([i]) * 1000) for i in range(40)]
    saved(spark.createDataFrame([*first, ("none", None), ("empty", b"")], SCHEMA).repartition(3), folder, "append", part_bytes=4000)
    assert read() == sorted([*first, ("empty", b"")])
    before = runs()
    assert sum(name.endswith(".zip") for run in before for name in os.listdir(tmp_path / "a" / run)) >= 10

    # one row cannot be written: nothing of its run stays, and readers see what they saw
    with pytest.raises(Exception, match="no name"):
        saved(spark.createDataFrame([*first, (None, b"x")], SCHEMA).repartition(3), folder, "overwrite", part_bytes=4000)
    assert read() == sorted([*first, ("empty", b"")]) and runs() == before

    saved(spark.createDataFrame([("0.txt", b"again")], SCHEMA), folder, "append")
    assert read() == sorted([*first, ("empty", b""), ("0.txt", b"again")])
    saved(spark.createDataFrame([("only", b"x")], SCHEMA), folder, "overwrite")
    assert read() == [("only", b"x")] and len(runs()) == 1
    saved(spark.createDataFrame([], SCHEMA), folder, "overwrite")
    assert read() == [] and not runs()


def test_a_folder_without_a_manifest_is_empty(spark, tmp_path):
    archives.register(spark)
    assert spark.read.format("quarry_archive").load(str(tmp_path)).count() == 0
