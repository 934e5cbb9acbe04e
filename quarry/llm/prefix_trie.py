"""The trie of conversations' prefixes, rolled up by bands of depth.

A node is a sequence of turns, named by a digest. Digests are made band by band: BAND turns of a conversation are folded
from an empty start, whatever stands before them; the digests of whole bands are a shorter sequence of the same kind,
folded the same way; a node's name is its band root's name with its own fold. So a conversation of n turns takes
log(n) / log(BAND) rounds, and no task folds more than BAND turns of one at a time.

Totals go up the same bands. A node's row is exploded to its ancestors inside its band only, BAND at most, and summed.
Band roots with their sums are a trie of their own, BAND times lower, which is rolled up by the same step. Completed
totals of band roots are exploded to their ancestors in the band above, and added. Rows that one ancestor gets are
summed where they are made, before they meet.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import HOT, hot_join, written

#: Turns of a band.
BAND = 32
#: Fixed values of the rebuilt conversations: their base is the last number divisible by SHARED; at most HEADS - 1 turns.
SHARED, HEADS = 100, 6
#: Turn numbers that are put in order together, and conversation numbers that are joined to one text.
TURNS, MEMBERS = 256, 4096
ROOT = ""


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 32)


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, k, d, chars): turns in order, from 0, by digest and length. Turns are ordered by ranges of their numbers, and
    the ranges counted, so that a conversation of any length is many groups."""
    name = lambda c: F.col(f"`{c}`")
    rows = conversations.where(name(conv).isNotNull()).select(name(conv).cast("long").alias("conv"), name(turn).alias("turn"), *(F.coalesce(name(c).cast("string"), F.lit("")).alias(n) for n, c in (("role", role), ("text", text))))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("k", F.row_number().over(inside) - 1)
    rows = rows.select("conv", "part", "k", _digest(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).alias("d"), F.length("text").cast("long").alias("chars"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(parts, ["conv", "part"]).select("conv", (F.col("below") + F.col("k")).alias("k"), "d", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their base in place of their own: (conv, i, d, chars), i from 1, and (conv,
    n) with turnless ones."""
    base, h = F.col("conv") - F.col("conv") % SHARED, F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    counts = written(turns.groupBy("conv").agg(F.count("*").alias("n")), "counts")
    bases = counts.where(F.col("conv") % SHARED == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = counts.select("conv", "n", base.alias("base"), h.alias("h")).join(bases, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = turns.where((F.col("conv") % SHARED == 0) & (F.col("k") < HEADS - 1)).select(F.col("conv").alias("base"), "k", "d", "chars")
    given = convs.select("conv", "base", "h").join(heads, "base").where(F.col("k") < F.col("h")).select("conv", (F.col("k") + 1).alias("i"), "d", "chars")
    hot = counts.where(F.col("n") > HOT).select(F.col("conv").alias("hot_"))
    own = hot_join(turns.where(F.col("k") >= h), convs.select("conv", "h", "head"), "conv", hot, F.col("k"))
    own = own.select("conv", (F.col("head") + F.col("k") - F.col("h") + 1).alias("i"), "d", "chars")
    return given.unionByName(own), convs.select("conv", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def paths(items: DataFrame, most: int, band: int = BAND) -> list[DataFrame]:
    """(conv, i, chars, key, up) for items (conv, i, d, chars), i from 1: a name for the sequence up to i, and the names
    of the shorter ones from the band's root on, which comes first. Then the same for whole bands as items, and so on, until a
    conversation is one band. most: the largest i."""
    order = F.array_sort(F.collect_list(F.struct("i", "d", "chars")))
    rows = items.withColumn("band", F.floor((F.col("i") - 1) / band)).groupBy("conv", "band").agg(order.alias("own"))
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("all"))

    def fold(acc, x):
        now = _digest(acc["at"], x["d"])
        return F.struct(now.alias("at"), F.concat(acc["all"], F.array(now)).alias("all"))

    rows = rows.withColumn("folds", F.aggregate("own", start, fold)["all"])
    above: list[DataFrame] = []
    if most > band:
        rows = written(rows, "bands")
        wholes = rows.select("conv", (F.col("band") + 1).alias("i"), F.element_at("folds", -1).alias("d"), F.lit(0).cast("long").alias("chars"))
        above = paths(wholes, -(-most // band), band)
        roots = above[0].select("conv", (F.col("i") - 1).alias("band"), F.element_at("up", -1).alias("root"), F.col("key").alias("end"))
        rows = rows.join(roots, ["conv", "band"])
    else:
        rows = rows.withColumn("root", F.lit(ROOT)).withColumn("end", F.lit(None).cast("string"))
    # a full band's last node is the next band's root and has its name
    names = F.transform("folds", lambda x, k: F.when((k == band - 1) & F.col("end").isNotNull(), F.col("end")).otherwise(_digest(F.col("root"), F.lit("/"), x)))
    rows = rows.select("conv", "band", "own", F.concat(F.array("root"), names).alias("path"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("own"))))
    return [written(rows.select("conv", (F.col("band") * band + F.col("k")).alias("i"), F.element_at("own", F.col("k"))["chars"].alias("chars"), F.element_at("path", F.col("k") + 1).alias("key"), F.slice("path", 1, F.col("k")).alias("up")), "paths"), *above]


def rollup(nodes: DataFrame, values: list[str], above: list[DataFrame], band: int = BAND) -> DataFrame:
    """(key, values) summed over each node's subtree. nodes: key, i (depth), up, values; above: the paths of band roots,
    of their bands' roots, and so on."""
    sums = [F.sum(v).alias(v) for v in values]
    start = F.col("i") % band == 0
    whole = F.concat("up", F.array("key"))
    ancestors = F.when(start, F.array("key")).otherwise(whole) if above else whole  # at the top, one band is all
    inside = written(nodes.select(F.explode(ancestors).alias("key"), *values).groupBy("key").agg(*sums), "inside")
    if not above:
        return inside
    # band roots, with their place among band roots; a band that is not whole has a name without a node
    kept = nodes.where(start).select("key", (F.col("i") / band).cast("long").alias("i")).join(inside, "key")
    ups = above[0].groupBy("key").agg(F.first("up").alias("up"))
    roots = written(rollup(kept.join(ups, "key", "left").select("key", "i", F.coalesce("up", F.array().cast("array<string>")).alias("up"), *values), values, above[1:], band), "roots")
    more = roots.join(nodes.where(start & (F.col("i") > 0)).select("key", "up"), "key")
    more = more.select(F.explode(F.slice("up", 2, band)).alias("key"), *values)
    others = inside.join(roots.select("key"), "key", "left_anti")
    return others.unionByName(more).groupBy("key").agg(*sums).unionByName(roots)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ends (key, conv): numbers are joined to texts by ranges first; a task then runs through a
    node's texts in order and holds one."""
    members = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    texts = ends.groupBy("key", F.floor(F.col("conv") / MEMBERS).alias("part")).agg(F.array_join(members, ",").alias("text"))

    def run(batches):
        now, state = None, None
        for batch in batches:
            keys, digests = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key == now:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    keys.append(now)
                    digests.append(state.hexdigest())
                now, state = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return texts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", band: int = BAND) -> DataFrame:
    """One row per node: conv_id (its least member; with depth it tells nodes apart), depth, parent_conv_id (the root's is
    null), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns with the same number are ordered by role, then text; a null turn comes first; null roles and texts are empty.
    Rows without a conv_id belong to no conversation and have no part in the trie. Repeated rows are turns of their own.
    Other columns are ignored. An empty table gives an empty result, else there is a root.
    """
    turns = written(numbered(conversations, conv, turn, role, text), "turns")
    rows, convs = rebuilt(turns)
    rows, convs = written(rows, "rebuilt"), written(convs, "convs")
    most, first, many = convs.agg(F.max("n"), F.min("conv"), F.count("*")).first()
    levels = paths(rows, most or 0, band)
    of_root = convs.agg(F.lit(ROOT).alias("key"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<string>").alias("up")).where("n_convs > 0")
    nodes = levels[0].groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("i").alias("i"), F.first("chars").alias("chars"), F.first("up").alias("up"))
    nodes = nodes.unionByName(of_root).withColumn("parent", F.element_at(F.when(F.size("up") > 0, F.col("up")), -1))
    nodes = written(nodes, "nodes")
    children = written(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    own = nodes.select("key", "i", "up", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rollup(own, ["n_leaves", "saved_tokens"], levels[1:], band)

    # a node's parent is the root, whose least member is known, or another node
    hot = children.where(F.col("n_children") > HOT).select(F.col("key").alias("hot_"))
    near = nodes.where("i < 2").withColumn("parent_conv_id", F.when(F.col("i") == 1, F.lit(first)).cast("long"))
    far = hot_join(nodes.where("i >= 2"), nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id")), "parent", hot, F.col("key"))
    nodes = near.unionByName(far)

    at_end = convs.where("n > 0").join(levels[0].select("conv", F.col("i").alias("n"), "key"), ["conv", "n"]).select("key", "conv")
    digests = ends_digests(at_end.unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("key"), "conv")))
    found = nodes.join(totals, "key").join(digests, "key", "left")
    return found.select(F.col("conv").alias("conv_id"), F.col("i").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
