"""What the corpus operators share: tables in the shared folder, joins with hot keys, and text chunking.

Operators that carry a caller's columns along pack them into one struct, `row`, beside which their own names cannot
clash with any of the caller's; `row.*` gives the columns back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import shared_folder, written

__all__ = ["blocks", "chunk_pattern", "dealt_join", "hot_join", "marked", "packed", "shared_folder", "small_batches", "written"]

#: The Unicode White_Space code points (what \s of the tokenizers' patterns matches).
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"



def chunk_pattern(white_space: str = WHITE_SPACE) -> re.Pattern:
    """White space with the characters after it. A pre-token never spans the end of such a chunk, because every
    alternative of the byte-level pattern that reaches white space starts at it."""
    return re.compile(f"[{white_space}]*[^{white_space}]+|[{white_space}]+")


#: Rows of a batch that goes to Python. Spark bounds its bytes, too (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB),
#: so that a worker holds batches of bounded size however long texts are.
BATCH_ROWS = 1000
#: Bits of the bitmap that tells rows by their keys (2 MB), and of the one that tells hot keys (16 KB).
BITMAP, HOT_BITMAP = 1 << 24, 1 << 17
#: Rows of a key that make it hot, and the parts that its rows are dealt to.
HOT, PARTS = 500, 16


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_ROWS at most; a session that asks for fewer keeps its setting."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct `row`, and columns of the operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def marked(rows: DataFrame, key: Column, members: DataFrame, member: Column, name: str = "maybe", bits: int = BITMAP) -> DataFrame:
    """rows with a flag: whether the key may be among the members', by a bitmap of hashed keys, which is `bits` long
    however many members there are. It keeps what is surely none of them out of the shuffle that a join needs; what it
    lets through by chance, the join tells apart. rows have no columns spot_, part_ or bits_."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    own = members.select(spot(member).alias("spot_"))
    table = own.groupBy(F.bitmap_bucket_number("spot_").alias("part_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot_")).alias("bits_"))
    found = rows.withColumn("spot_", spot(key)).join(F.broadcast(table), F.bitmap_bucket_number("spot_") == F.col("part_"), "left")
    at = F.bitmap_bit_position("spot_")
    byte = F.conv(F.hex(F.substring("bits_", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("spot_", "part_", "bits_")


def dealt_join(many: DataFrame, one: DataFrame, key: str, spread: Column, merge: bool = False) -> DataFrame:
    """many joined to `one`, which has a row per key and is small beside many. Each key's rows are dealt to PARTS parts
    by the hash of `spread`, and its row of `one` goes to each of them. merge: by a sort-merge join at any size."""
    left = many.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int"))
    right = one.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return left.join(right.hint("merge") if merge else right, [key, "salt_"]).drop("salt_")


def hot_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """The same for a large `one`, by a sort-merge join at any size: only the rows of hot keys (hot: hot_) are dealt. Which keys those are is told by a
    bitmap on both sides; what it takes for hot by chance is dealt as well, to the same result."""
    left = marked(many, F.col(key), hot, F.col("hot_"), "deal_", HOT_BITMAP)
    right = marked(one, F.col(key), hot, F.col("hot_"), "deal_", HOT_BITMAP)
    left = left.withColumn("salt_", F.when(F.col("deal_"), F.pmod(F.xxhash64(spread), F.lit(PARTS))).otherwise(0).cast("int")).drop("deal_")
    right = right.withColumn("salt_", F.explode(F.when(F.col("deal_"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("deal_")
    return left.join(right.hint("merge"), [key, "salt_"]).drop("salt_")


def blocks(batches, columns: list[str], most: int = 8 << 20):
    """Lists of the named columns' values, for consecutive rows whose texts hold about `most` bytes."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        for into, name in zip(held, columns, strict=True):
            into.extend(batch.column(name).to_pylist())
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [[] for _ in columns], 0
    if held[0]:
        yield held
