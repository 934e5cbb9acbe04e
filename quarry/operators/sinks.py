"""Writers of what the retrieval service writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X


def save_index(postings: DataFrame, df: DataFrame, stats: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Postings dealt and sorted by term, document frequencies and statistics: overwritten as a whole."""
    dealt = postings.repartition(partitions, "term") if partitions else postings.repartition("term")
    dealt.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    df.write.mode("overwrite").parquet(f"{folder}/df")
    stats.write.mode("overwrite").parquet(f"{folder}/stats")


def load_index(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "df", "stats"))


def save_points(points: DataFrame, folder: str, by: list[str]) -> None:
    """A collection: one folder per filter value, so that filters prune files."""
    points.write.mode("overwrite").partitionBy(*by).parquet(folder)


def save_manifest(forms: DataFrame, path: str) -> None:
    """Forms by number, a line each."""
    forms.orderBy("form_number").write.mode("overwrite").json(path)


def save_manifests(forms: DataFrame, by: str, path: str) -> None:
    """Forms as one JSON document per act, a line each: the act (by, as text), how many forms, and the forms by number with
    what else their rows say. An act has as many forms as one document holds."""
    own = [c for c in forms.columns if c not in (by, "form_number")]
    rows = forms.groupBy(F.col(by).cast("string").alias("act")).agg(F.count("*").cast("int").alias("form_count"), F.array_sort(F.collect_list(F.struct("form_number", *own))).alias("forms"))
    rows.select(F.to_json(F.struct("act", "form_count", "forms")).alias("value")).write.mode("overwrite").text(path)


def exposition(series: DataFrame) -> DataFrame:
    """series (metric, labels map<string,string>, value) as lines of the text exposition format."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return series.select(F.concat("metric", labels, F.lit(" "), F.col("value").cast("string")).alias("value"))


def sse(events: DataFrame) -> DataFrame:
    """events (stream, seq, event, data) as one text per stream, in order."""
    parts = F.array_sort(F.collect_list(F.struct("seq", X.sse_frame(F.col("event"), F.col("data")).alias("f"))))
    return events.groupBy("stream").agg(F.array_join(F.transform(parts, lambda p: p["f"]), "").alias("body"))


def archive(files: DataFrame, path: str) -> int:
    """A zip of (name, content), a file at a time, of those that exist; written by the driver, as forms are few."""
    import zipfile

    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for r in files.where(F.col("content").isNotNull()).orderBy("name").toLocalIterator():
            out.writestr(zipfile.ZipInfo(r["name"], (2023, 12, 25, 0, 0, 0)), bytes(r["content"]))
            n += 1
    return n
