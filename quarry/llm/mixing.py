r"""Mixing sources to target weights.

Every source's words, documents on end, are packed into blocks of a fixed number of words. The mix is a sequence of
output shards of SHARD_SLOTS slots (the last one may have fewer). Each shard's slot counts are a multinomial draw over
what the sources have to give, on the condition that all shards together meet the targets (a multivariate
hypergeometric law); shards are split in halves down to single ones with a generator of its own for each node, so that
any task draws its shards alone and reruns agree. A source's j-th slot takes the block that the source's pseudorandom
permutation puts at j (a new permutation in each pass), and slots are joined to blocks by index. Two passes at most, so
no document is taken more than twice.

Only sizes move, not texts. Sources are a table like any other, however many there are: they are numbered by ranges,
targets are shared by aggregates, and a hot source's documents are cut into buckets before anything is ordered. Counts
are drawn for GROUPS groups of consecutive sources at most, which is a source each unless there are more; within a group
a permutation deals the slots to its sources. The driver holds the groups' slots and a number per range of sources.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import dealt_join, packed, written

#: The weights of sources in order, the share of all sizes, and the passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, GROUPS = 256, 1024, 4096
#: Documents that are ordered together; buckets whose sums are; slots of a group that meet its sources in one key.
BUCKET_ROWS, SPAN, PART = 2_000, 1024, 1 << 16
#: Shards that a task draws and writes at once.
SHARDS_AT_ONCE = 64
#: Above it a hypergeometric draw takes the normal law that it approaches.
EXACT = 10**9

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text; null: 0. What is left when each such run has become one character and
    the blanks are gone."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w"), " \t\n\x0b\x0c\r", "")).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and in the order of sources: by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def permuted(j: np.ndarray, n, key, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) puts each j (back: what it puts at j): a four-round Feistel network
    over the next even number of bits, walked on until it is below n. n and key (unsigned 64-bit) may differ by j."""
    n, key = (np.broadcast_to(np.asarray(v, np.uint64), np.shape(j)) for v in (n, key))
    bits = np.frexp((n - np.uint64(1)).astype(np.float64))[1]
    # a double may round up to the next power of two: an even wider network is a permutation as well
    half = np.maximum(1, (bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = key * np.uint64(0x9E3779B97F4A7C15)
    x, todo = np.array(j, np.uint64), np.arange(len(j))
    while len(todo):
        k, m, h = key[todo], mask[todo], half[todo]
        left, right = x[todo] >> h, x[todo] & m

        def mixed(v: np.ndarray, r: int, k=k, m=m) -> np.ndarray:
            v = (v + k + np.uint64(r * 0xD1B54A32D192ED03 & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            v ^= v >> np.uint64(29)
            return (v * np.uint64(0x94D049BB133111EB) >> np.uint64(40)) & m

        for r in range(4):
            left, right = (right ^ mixed(left, 3 - r), left) if back else (right, left ^ mixed(right, r))
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def key_of(seed: int, source, taken):
    """Of a source's permutation in a pass; of a group's dealing, with taken = PASSES."""
    return (np.asarray(source, np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(PASSES + 1) + np.asarray(taken, np.uint64) + np.uint64(1)


def plan_of(number: int, size: int, target: float, block_words: int, seed: int) -> tuple[int, int, int]:
    """A source's blocks, its slots, and the words that its last slot takes, so that its words meet its target. Only a
    source's last block can be short; it counts where the permutation puts it."""
    goal, blocks = round(target), -(-size // block_words)
    short = blocks * block_words - size
    for taken in range(PASSES if goal else 0):
        # the pass that meets the goal: its slots before and after the short block
        rest = goal - taken * size
        if rest > size:
            continue
        n = -(-rest // block_words)
        at = int(permuted(np.array([blocks - 1]), blocks, key_of(seed, number, taken), back=True)[0])
        if n > at:  # the short block is among them
            n = -(-(rest + short) // block_words)
        before = n - 1
        return blocks, taken * blocks + n, rest - before * block_words + (short if before > at else 0)
    return blocks, 0, 0


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, need: np.ndarray) -> np.ndarray:
    """How many of `need` draws without replacement are good, place by place."""
    low, high = np.maximum(0, need - bad), np.minimum(good, need)
    out = low.copy()
    small = (good < EXACT) & (bad < EXACT) & (high > low)
    if small.any():
        out[small] = rng.hypergeometric(good[small], bad[small], need[small])
    large = ~small & (high > low)
    if large.any():
        g, b, k = (v[large].astype(np.float64) for v in (good, bad, need))
        share = g / (g + b)
        spread = np.sqrt(np.maximum(0.0, k * share * (1 - share) * (g + b - k) / np.maximum(1.0, g + b - 1)))
        out[large] = np.clip(np.rint(k * share + spread * rng.standard_normal(len(k))).astype(np.int64), low[large], high[large])
    return out


def part_of(counts: np.ndarray, need: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `need` slots, drawn from all, are of each group: halves of the groups first, then quarters, and so on."""
    levels = [np.pad(counts, (0, (1 << (len(counts) - 1).bit_length()) - len(counts)))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    take = np.array([need], np.int64)
    for sums in levels[-2::-1]:
        left = hypergeometric(rng, sums[0::2], sums[1::2], take)
        take = np.stack([left, take - left], axis=1).ravel()
    return take[: len(counts)]


def drawn(slots: np.ndarray, first: int, end: int, seed: int, shard_slots: int = SHARD_SLOTS):
    """(shard, counts, before) of the shards first..end - 1: slots of each group in the shard, and in those before it.
    slots: all slots of each group."""
    total = int(slots.sum())

    def halves(low: int, high: int, counts: np.ndarray, before: np.ndarray):
        if high <= first or low >= end:
            return
        if high - low == 1:
            yield low, counts, before
            return
        middle = low + (1 << ((high - low - 1).bit_length() - 1))
        left = part_of(counts, min(total, middle * shard_slots) - low * shard_slots, np.random.default_rng([seed, low, high]))
        yield from halves(low, middle, left, before)
        yield from halves(middle, high, counts - left, before + left)

    yield from halves(0, -(-total // shard_slots), slots, np.zeros_like(slots))


def numbered(sources: DataFrame) -> tuple[DataFrame, int, int]:
    """sources (skey, size, ...) with number: their place in the order of skey, from 0; how many they are, and the sum of
    their sizes. By ranges: the driver gets a count and a sum of each."""
    ranged = sources.repartitionByRange("skey").sortWithinPartitions("skey").withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged")
    own = F.shiftright("at", 33)
    counts = sorted(ranged.groupBy(own.alias("range")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect())
    before = np.cumsum([0, *(r["n"] for r in counts)]).tolist()
    table = sources.sparkSession.createDataFrame([(r["range"], b) for r, b in zip(counts, before, strict=False)], "range long, before long")
    rows = ranged.withColumn("range", own).join(F.broadcast(table), "range")  # a row per partition
    return rows.withColumn("number", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "range", "before"), before[-1], sum(r["size"] for r in counts)


def with_targets(sources: DataFrame, words: int, share: float, weights) -> DataFrame:
    """sources (number, size, ...; words in all) with target. The share of all sizes goes to the sources by weight; a target stops at
    PASSES times its size, and the excess is shared again by weight among the others until none is above. A source is
    above if the share of a unit of weight is more than its size allows, and that share only grows, so that a round is an
    aggregate."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.col("size") * PASSES)
    left, unit = min(share * words, float(PASSES * words)), 0.0
    while True:
        over = F.col("most") <= 0 if not unit else (F.col("weight") * unit > F.col("most"))
        stopped, free = rows.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        new = (left - (stopped or 0)) / free if free else unit
        if new <= unit:
            break
        unit = new
    return rows.withColumn("target", F.least(F.col("weight") * unit, F.col("most").cast("double"))).drop("weight", "most")


@dataclass
class Mix:
    """docs: one row for all rows alike in id, text and source, with n (of them), skey and number (of the source),
    source_size, target, size (words of one) and start (words of its source before it); slots: (shard, number, slot,
    pass, block, words): what each slot of the output takes."""

    docs: DataFrame
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """(number, start, size, copy, pass, first, words): word ranges of documents that the mix takes, numbered within
        the document; copy tells rows that are alike. Joined by block index."""
        b = self.block_words
        whole = F.col("size") * F.col("n")
        blocks = F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size * n - 1) div {b}"))
        touched = self.docs.where("size > 0").select("number", "start", "size", whole.alias("whole"), F.explode(blocks).alias("block"))
        joined = touched.join(self.slots.select("number", "block", "pass", "words"), ["number", "block"])
        low = F.greatest(F.col("start"), F.col("block") * b) - F.col("start")
        high = F.least(F.col("start") + F.col("whole"), F.col("block") * b + F.col("words")) - F.col("start")
        ranges = joined.select("number", "start", "size", "pass", low.alias("low"), high.alias("high")).where("high > low")
        ranges = ranges.withColumn("copy", F.explode(F.sequence(F.expr("low div size"), F.expr("(high - 1) div size"))))
        first = F.greatest(F.col("low") - F.col("copy") * F.col("size"), F.lit(0))
        end = F.least(F.col("high") - F.col("copy") * F.col("size"), F.col("size"))
        return ranges.select("number", "start", "size", "copy", "pass", first.alias("first"), (end - first).alias("words"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, weights=WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 17) -> Mix:
    """Plan and draw the mix. Sources are ordered by code point, null last, and take the weights in turn.

    A null text has no words. Rows with the same doc_id, or null, are documents of their own. An empty table, or one
    without words, gives a mix without slots. Columns of docs may have any names.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("skey"), F.xxhash64(id_col, text_col).alias("hash"), word_count(F.col(text_col)).alias("size"))
    sized = written(sized.groupBy("id", "skey", "hash", "size").agg(F.count("*").alias("n")), "sizes")

    found = sized.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("rows"))
    sources, n_sources, words = numbered(found)
    sources = with_targets(sources, words, share, weights)

    def plan(batches):
        for batch in batches:
            made = [plan_of(r["number"], r["size"], r["target"], block_words, seed) for r in batch.select(["number", "size", "target"]).to_pylist()]
            for k, name in enumerate(("blocks", "slots", "cut")):
                batch = batch.append_column(name, pa.array([m[k] for m in made], pa.int64()))
            yield batch

    planned = sources.select("skey", "size", "rows", "number", "target")
    planned = planned.mapInArrow(plan, "skey string, size long, rows long, number long, target double, blocks long, slots long, cut long")
    planned = planned.withColumn("grp", F.expr(f"number div {max(1, -(-n_sources // GROUPS))}"))
    before = F.sum("slots").over(Window.partitionBy("grp").orderBy("number")) - F.col("slots")
    sources = written(planned.withColumn("first", before), "sources")

    # start of each document within its source: buckets of bounded size, and sums over buckets
    facts = sources.select("skey", "number", F.col("size").alias("source_size"), "target", F.expr(f"greatest(1, (rows + {BUCKET_ROWS - 1}) div {BUCKET_ROWS})").alias("buckets"))
    one = dealt_join(sized, facts, "skey", F.col("hash")).withColumn("bucket", F.pmod("hash", "buckets")).drop("buckets")
    whole, until = F.col("size") * F.col("n"), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = one.groupBy("number", "bucket").agg(F.sum(whole).alias("words")).withColumn("span", F.expr(f"bucket div {SPAN}"))
    per_span = per_bucket.groupBy("number", "span").agg(F.sum("words").alias("words"))
    per_span = per_span.select("number", "span", F.coalesce(F.sum("words").over(until(Window.partitionBy("number").orderBy("span"))), F.lit(0)).alias("before_span"))
    in_span = F.coalesce(F.sum("words").over(until(Window.partitionBy("number", "span").orderBy("bucket"))), F.lit(0))
    per_bucket = per_bucket.withColumn("in_span", in_span).join(per_span, ["number", "span"]).select("number", "bucket", (F.col("before_span") + F.col("in_span")).alias("before"))
    inside = F.coalesce(F.sum(whole).over(until(Window.partitionBy("number", "bucket").orderBy("id", "hash", "size"))), F.lit(0))
    placed = one.withColumn("inside", inside).join(per_bucket, ["number", "bucket"])
    placed = placed.select("id", "skey", "hash", "number", "size", "n", "source_size", "target", (F.col("before") + F.col("inside")).alias("start"))

    groups = sources.groupBy("grp").agg(F.sum("slots").alias("slots")).collect()  # GROUPS at most
    slots_of = np.zeros(len(groups), np.int64)
    for r in groups:
        slots_of[r["grp"]] = r["slots"]
    shards = -(-int(slots_of.sum()) // SHARD_SLOTS)

    def deal(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a in range(0, len(ids), SHARDS_AT_ONCE):
                shard, grp, at = [], [], []
                for k, counts, given in drawn(slots_of, int(ids[a]), int(ids[min(a + SHARDS_AT_ONCE, len(ids)) - 1]) + 1, seed):
                    some = np.flatnonzero(counts)
                    n = counts[some]
                    ends = np.cumsum(n)
                    at.append(np.arange(ends[-1]) + np.repeat(given[some] - ends + n, n))
                    grp.append(np.repeat(some, n))
                    shard.append(np.full(ends[-1], k))
                grp, at = np.concatenate(grp), np.concatenate(at)
                at = permuted(at, slots_of[grp], key_of(seed, grp, PASSES))
                yield pa.RecordBatch.from_pydict({"shard": np.concatenate(shard), "grp": grp, "at": at, "part": at // PART})

    dealt = spark.range(0, shards, 1, max(1, min(10_000, -(-shards // SHARDS_AT_ONCE)))).mapInArrow(deal, "shard long, grp long, at long, part long")
    parts = sources.where("slots > 0").select("grp", "number", "first", "blocks", "slots", "cut", F.col("size").alias("source_size"), F.explode(F.expr(f"sequence(first div {PART}, (first + slots - 1) div {PART})")).alias("part"))
    slots = dealt.join(parts, ["grp", "part"]).where("at >= first AND at < first + slots").select("shard", "number", (F.col("at") - F.col("first")).alias("slot"), "blocks", "slots", "cut", "source_size")

    def fill(batches):
        for batch in batches:
            shard, number, slot, blocks, slots, cut, source_size = (batch.column(c).to_numpy() for c in ("shard", "number", "slot", "blocks", "slots", "cut", "source_size"))
            taken = slot // np.maximum(blocks, 1)
            block = permuted(slot - taken * blocks, blocks, key_of(seed, number, taken))
            words = np.minimum(block_words, source_size - block * block_words)
            words = np.where(slot == slots - 1, cut, words)
            yield pa.RecordBatch.from_pydict({"shard": shard, "number": number, "slot": slot, "pass": taken, "block": block, "words": words})

    # by shards, in tasks of their own: a task that draws and fills holds two workers, and idle ones keep their memory
    slots = slots.repartition("shard").mapInArrow(fill, "shard long, number long, slot long, pass long, block long, words long")
    return Mix(written(placed, "documents"), slots, block_words)


def mix_figures(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target and taken (words of it in the mix, repeats counted)."""
    mix = mix_sources(docs, id_col=id_col, **options)
    taken = mix.pieces().groupBy("number", "start", "size", "copy").agg(F.sum("words").alias("taken"))
    rows = mix.docs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).join(taken, ["number", "start", "size", "copy"], "left")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows with the columns of docs: for each pass, a document's words that were taken, in their order and
    with the blanks between neighbours as they were; ranges of one document that do not meet are joined by a newline.
    A document that is taken twice whole gives two equal rows; one that is not taken gives none. Rows of docs that are
    alike in id, source and text count as often as they occur; what they give has the other columns of one of them."""
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    place = ["number", "start", "size"]
    ranges = mix.pieces().groupBy(*place, "copy", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("ranges"))
    ranges = ranges.join(mix.docs.select(*place, F.col("id").alias("r_id"), F.col("skey").alias("r_skey"), F.col("hash").alias("r_hash")), place)
    ranges = ranges.select("r_id", "r_skey", "r_hash", "ranges")
    rows = packed(docs, id=F.col(id_col), skey=source_key(F.col(source_col)), hash=F.xxhash64(id_col, text_col))
    if not mix.docs.where("n > 1").isEmpty():
        rows = rows.groupBy("id", "skey", "hash").agg(F.first("row").alias("row"))  # of alike rows, one carries what all of them give
    joined = rows.join(ranges, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("skey") == F.col("r_skey")) & (F.col("hash") == F.col("r_hash")))
    fields = docs.columns

    def cut(batches):
        for batch in batches:
            row = batch.column("row")
            values = dict(zip(fields, row.flatten(), strict=True))
            text = values[text_col]
            values[text_col] = pa.array([taken_text(t, r) for t, r in zip(text.to_pylist(), batch.column("ranges").to_pylist(), strict=True)], text.type)
            yield pa.RecordBatch.from_arrays([values[c] for c in fields], names=fields)

    return joined.select("row", "ranges").mapInArrow(cut, docs.schema)


def taken_text(text: str, ranges: list[dict]) -> str:
    """The words of the text in the ranges (first, words), in order; those that meet are one."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw)]
    parts: list[tuple[int, int]] = []
    last = -1
    for r in sorted(ranges, key=lambda r: r["first"]):
        a, b = at[r["first"]][0], at[r["first"] + r["words"] - 1][1]
        if last == r["first"]:
            parts[-1] = (parts[-1][0], b)
        else:
            parts.append((a, b))
        last = r["first"] + r["words"]
    return text if parts == [(at[0][0], at[-1][1])] else b"\n".join(raw[a:b] for a, b in parts).decode()
