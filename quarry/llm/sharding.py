"""Histogram sort: shards of near equal bytes by exact counts below candidate boundaries; DataFrame operations only.

Rows are ordered by a key of hexadecimal digits: of the text's digest, then of the id's, then of the row's number, so
that equal texts stand together and no two rows are alike. Candidate boundaries are prefixes of the key. A round counts
the bytes and rows of each prefix, in parts before they meet; a target (so many bytes below) takes the nearest boundary
as soon as one is within the tolerance, and what holds an unmet target, or is too large for one task, is probed again
by longer prefixes. Groups of equal texts are therefore cut only where nothing else meets the tolerance, and a hot group
is cut into ranges of ids like any other range.

The counts also say how many rows lie below each range, so that rows are numbered in one exchange: a row's slot is what
lies below its range plus its place in it. Ranges, not shards, are what a task holds.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import packed, written

SHARDS = 8
#: How far a boundary may lie from its target, as a part of a shard's bytes; a single row is never divided.
TOLERANCE = 0.001
#: The largest range: a part of all bytes, and bytes. A range goes to one task.
RANGE_PART, RANGE_BYTES = 256, 1 << 30
#: Digits of each part of the key, and the lengths of the prefixes that are probed.
DIGITS = 16
DEPTHS = (3, 5, 7, 9, 11, 13, *range(DIGITS, 3 * DIGITS + 1, 2))


def _digits(value: Column) -> Column:
    return F.substring(F.md5(value), 1, DIGITS)


def _counts(keys: DataFrame, open_: list[str], depth: int) -> dict[str, tuple[int, int, int]]:
    """Bytes, rows, and digits that all rows surely share, of each prefix of so many digits that begins with one of
    open_."""
    rows = keys
    if open_ != [""]:
        test = F.lit(False)
        for length in sorted({len(p) for p in open_}):
            test = test | F.substring("key", 1, length).isin([p for p in open_ if len(p) == length])
        rows = rows.where(test)
    text, ids = F.xxhash64(F.substring("key", 1, DIGITS)), F.xxhash64(F.substring("key", 1, 2 * DIGITS))
    rows = rows.select(F.substring("key", 1, depth).alias("prefix"), "size", text.alias("x"), ids.alias("y"))
    rows = rows.groupBy("prefix").agg(F.sum("size").alias("size"), F.count("*").alias("n"), (F.min("x") == F.max("x")).alias("x"), (F.min("y") == F.max("y")).alias("y"))
    return {r["prefix"]: (r["size"], r["n"], 2 * DIGITS if r["y"] else DIGITS if r["x"] else 0) for r in rows.toLocalIterator()}


def boundaries(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> tuple[list[tuple[str, int]], list[str]]:
    """The ranges in order, as (first prefix, rows below), and the first prefixes of shards 1, 2, ...; an empty shard
    begins where the next does. keys: key, size."""
    ranges = _counts(keys, [""], DEPTHS[0])
    total = sum(size for size, _, _ in ranges.values())
    targets = {k: total * k / shards for k in range(1, shards)}
    most, near = min(total / RANGE_PART, range_bytes), tolerance * total / shards
    cuts: dict[int, str] = {}
    while True:
        order = sorted(ranges)
        below = [0]
        for prefix in order:
            below.append(below[-1] + ranges[prefix][0])
        again: dict[int, set[str]] = {}

        def probe(prefix: str) -> bool:
            size, n, shared = ranges[prefix]  # noqa: B023
            depth = next((x for x in DEPTHS if x > max(len(prefix), shared)), None)
            if n > 1 and depth:
                again.setdefault(depth, set()).add(prefix)  # noqa: B023
            return n > 1 and depth is not None

        for k, target in targets.items():
            if k not in cuts and order:
                at = min(max(bisect_right(below, target), 1), len(order))  # the range that holds the target is at - 1
                edge = at - 1 if target - below[at - 1] <= below[at] - target else at
                if abs(below[edge] - target) <= near or not probe(order[at - 1]):
                    cuts[k] = order[edge] if edge < len(order) else "g"  # beyond all digits
        for prefix in order:
            if ranges[prefix][0] > most:
                probe(prefix)
        if not again:
            break
        depth = min(again)
        found = _counts(keys, sorted(again[depth]), depth)
        for prefix in again[depth]:
            del ranges[prefix]
        ranges |= found
    rows, out = 0, []
    for prefix in order:
        out.append((prefix, rows))
        rows += ranges[prefix][1]
    return out, [cuts.get(k, "g") for k in range(1, shards)]


def histogram_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row, size, shard, slot): each row of docs with all its columns as one struct, its bytes, its shard from 0, and
    its number in the shard, without gaps from 0.

    size is the bytes of the text in UTF-8 plus 1, so that a null or empty text counts 1. Shards differ from equal parts
    of all bytes by twice the tolerance at most, or by a row where rows are longer; there are empty ones where rows are
    fewer than shards. Shards and slots depend on texts and ids alone, whatever the order or the files of docs: rows
    alike in both (or in text, with null ids) may change places with one another. An empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`").cast("binary")
    rows = packed(docs, size=F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, start=F.concat(_digits(F.coalesce(text, F.lit(b""))), _digits(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))))
    rows = written(rows.withColumn("key", F.concat("start", _digits(F.monotonically_increasing_id().cast("string").cast("binary")))).drop("start"), "keyed")
    ranges, cuts = boundaries(rows.select("key", "size"), shards, tolerance, range_bytes)
    firsts = [prefix for prefix, _ in ranges]
    starts = {0: 0}
    for k, cut in enumerate(cuts, 1):
        at = bisect_right(firsts, cut) - (cut in firsts)
        starts[k] = ranges[at][1] if at < len(ranges) else 0
    by_head: dict[str, list] = {}
    for i, (prefix, before) in enumerate(ranges):
        shard = bisect_right(cuts, prefix)
        by_head.setdefault(prefix[: DEPTHS[0]], []).append((prefix, i, shard, before - starts[shard]))
    # a row for each of the first digits, 4096 at most, with the ranges that begin so: as large as the ranges are many
    table = docs.sparkSession.createDataFrame(list(by_head.items()), "head string, ranges array<struct<low:string,range:int,shard:int,before:long>>")
    found = rows.withColumn("head", F.substring("key", 1, DEPTHS[0])).join(F.broadcast(table), "head")
    own = F.when(F.size("ranges") == 1, F.get("ranges", F.lit(0))).otherwise(F.element_at(F.filter("ranges", lambda r: r["low"] <= F.col("key")), -1))
    found = found.select("row", "size", "key", own.alias("own")).select("row", "size", "key", "own.range", "own.shard", "own.before")
    place = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return found.select("row", "size", "shard", (F.col("before") + place - 1).alias("slot"))


def save_shards(sharded: DataFrame, folder: str) -> None:
    """A folder for each shard, rows with their slots."""
    sharded.write.partitionBy("shard").parquet(folder)


def shard_figures(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law doesn't grow by one shard)."""
    rows = histogram_shards(docs, shards)
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
