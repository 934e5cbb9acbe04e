"""Tables of a folder of Parquet files, and tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a table up to which its rows are dealt to all cores where it has fewer files: a file of one row group is
#: otherwise read, and its texts worked on, by one task.
SMALL_TABLE = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows of a small table in a few files, dealt to all cores; any other table as it is, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size <= SMALL_TABLE and len(rows.inputFiles()) < cores else rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; those of texts are spread."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def shared_folder(spark: SparkSession, name: str = "quarry") -> str:
    """A new folder below the session's spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder
    and a cluster, whose machines share none, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quarry_folder", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark._quarry_folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, folder: str, *names: str) -> str:
    """Tells the files of tables from any others that the folder held or will hold: names, lengths and times."""
    jvm, seen = spark._jvm, hashlib.sha256()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.update(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}\n".encode())
    return seen.hexdigest()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: computed once, and read again by whatever needs it."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
