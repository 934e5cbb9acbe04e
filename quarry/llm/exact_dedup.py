r"""Exact deduplication over a persistent digest index; DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest, anti-joined
to the index bucket by bucket (a sort-merge join that deals only the batch's reduced rows), and the new digests are
appended under the batch's number. A batch that failed after that, and comes again, finds its own digests and keeps the
same rows. Copies inside a batch never meet in one task: they are pre-aggregated before the shuffle, and rows get a
group's facts by joins on digest, length and doc_id, or dealt to parts where a digest has many rows. Texts of rows that
have no copy stay where they are: a bitmap of bounded size tells them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import HOT, hot_join, marked, packed, shared_folder, written

#: The characters of [\x20\x09-\x0D], as Java's translate wants them.
BLANK = " \t\n\x0b\x0c\r"


def digest_of(text: Column) -> Column:
    """SHA-256 (hex) of the text without blanks; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANK, "").cast("binary"), 256)


def length_of(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different (digest, length in code points, doc_id), n: rows that are alike in all three."""
    text = F.col(text_col)
    return docs.select(F.unhex(digest_of(text)).alias("digest"), length_of(text).alias("length"), F.col(id_col).alias("doc_id")).groupBy("digest", "length", "doc_id").agg(F.count("*").alias("n"))


class DigestIndex:
    """A table of (digest, keep_id, length, group_size, batch), bucketed and sorted by digest, at a path of its own."""

    COLUMNS = "digest BINARY, length BIGINT, keep_id {id}, group_size BIGINT, batch BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, id_type: str = "BIGINT"):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table = "quarry_digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({self.COLUMNS.format(id=id_type)}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        self.schema = spark.table(self.table).schema

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """The same without its buckets, straight from the files."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def forget(self) -> None:
        """Take the table out of the catalog; its files stay, and DigestIndex(spark, path) finds them again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, seen: DataFrame, batch: int) -> None:
        """Append the digests of `seen` (rows of digests()) that the index lacks: one row per digest, with the row that
        stays (most code points, then smallest doc_id, null first) and the group's size. What an earlier run of the same
        batch has appended is met, and not appended again."""
        groups = seen.groupBy("digest").agg(F.min(F.struct((-F.col("length")).alias("longest"), "doc_id")).alias("best"), F.sum("n").alias("group_size"))
        groups = groups.select("digest", (-F.col("best.longest")).alias("length"), F.col("best.doc_id").alias("keep_id"), "group_size", F.lit(batch).cast("long").alias("batch"))
        fresh = groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)


def _indexed(docs: DataFrame, index: DigestIndex | None, batch: int | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The batch's digests, and the rows of the index with is_new: whether this batch brought them."""
    spark = docs.sparkSession
    if index is not None and batch is None:
        raise ValueError("an index that lasts needs the batch's number: a failed run comes again under the same one")
    seen = written(digests(docs, id_col, text_col), "digests")
    own = index or DigestIndex(spark, f"{shared_folder(spark)}/index", max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), docs.schema[id_col].dataType.simpleString())
    own.add(seen, batch or 0)
    if index is None:
        own.forget()
    return seen, own.rows().withColumn("is_new", F.col("batch") == F.lit(batch or 0))


def _hot(known: DataFrame) -> DataFrame:
    return known.where(F.col("group_size") > HOT).select(F.col("digest").alias("hot_"))


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batch: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks; null counts as empty. Of equal texts the row with the most
    code points in the original text stays, then the one with the smallest doc_id (null first); of rows that are alike
    in these too, one stays and the others have kept false. With an index that an earlier batch has taught the text, no
    row stays and keep_id is the earlier document; the same batch again gives the same rows. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    seen, known = _indexed(docs, index, batch, id_col, text_col)
    known = known.select("digest", "keep_id", "group_size", F.col("length").alias("keep_length"), "is_new")
    joined = hot_join(seen, known, "digest", _hot(known), F.struct("length", "doc_id"))
    best = F.col("is_new") & (F.col("length") == F.col("keep_length")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")
    return joined.select("*", best.alias("best"), one).select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; the rules are those of exact_groups. Columns of docs may have
    any names. Rows whose digest is surely in no group stay where they are; the others meet their group's verdict by
    digest, length and doc_id, so that a group of copies is never one key."""
    seen, known = _indexed(docs, index, batch, id_col, text_col)
    groups = known.where("NOT is_new OR group_size > 1").select("digest", F.col("length").alias("keep_length"), "keep_id", "is_new", "group_size")
    best = F.col("is_new") & (F.col("length") == F.col("keep_length")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    verdicts = hot_join(seen, groups, "digest", _hot(groups), F.struct("length", "doc_id")).select(F.col("digest").alias("v_digest"), F.col("length").alias("v_length"), F.col("doc_id").alias("v_id"), best.alias("best"), "n")
    verdicts = written(verdicts, "verdicts")
    text = F.col(text_col)
    rows = packed(docs, digest=F.unhex(digest_of(text)), length=length_of(text), id=F.col(id_col))
    rows = marked(rows, F.col("digest"), verdicts, F.col("v_digest"))
    same = (F.col("digest") == F.col("v_digest")) & (F.col("length") == F.col("v_length")) & F.col("id").eqNullSafe(F.col("v_id"))
    met = rows.where("maybe").join(verdicts.hint("merge"), same, "left").where("coalesce(best, true)")
    alone = rows.where("NOT maybe").select("row.*")
    if verdicts.where("best AND n > 1").isEmpty():
        return alone.unionByName(met.select("row.*"))
    once = met.where("n > 1").groupBy("digest", "length", "id").agg(F.first("row").alias("row"))
    return alone.unionByName(met.where("n IS NULL OR n = 1").select("row.*")).unionByName(once.select("row.*"))
