r"""N-gram Jaccard self-join by chosen paths.

A text's set is its shingles of five words. Each different set has a signature of T minhash tokens (coordinate,
value); two sets share about T times their similarity of them. A run samples a coordinate: sets that share its token
fall into one bucket. A bucket of more than SMALL sets is split on by further sampled coordinates, two at each node, so
that a pair at the threshold seldom loses all shared tokens. Small buckets are searched by brute force over packed
signatures, large ones that no split shrinks (groups of near copies) in tiles, so that no task holds one whole. Runs
repeat until a pair at the threshold is met with the target recall.

What buckets give is, per set, a partner towards which it is joined, never all pairs. The connected components of
these candidates (min-label contraction over tables in the shared folder) bring the sets that may be similar together;
there every pair's exact similarity is computed from whole shingle sets, in tiles, and counted where it is found. So
links are exact, and none that fell into a component is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quarry.llm.shared import HOT, dealt_join, hot_join, marked, packed, small_batches, written

#: Words of a shingle; threshold as a fraction; minhash tokens of a signature; bytes kept of each.
WORDS, NUM, DEN, T = 5, 4, 5, 128
#: Sets of a bucket that is searched at once, levels of splitting (each doubles the rows of buckets that do not shrink),
#: sets of a tile.
SMALL, LEVELS, TILE = 256, 3, 512
RECALL = 0.9999
#: Equal bytes of two signatures that make a candidate: 5.8 standard deviations below what the threshold gives.
LEAST_EQUAL = 76


def runs_for(recall: float, threshold: float, levels: int) -> int:
    """Runs until a pair at the threshold has met: with one coordinate at the root and two at each split below."""
    met = threshold * (1 - (1 - threshold) ** 2) ** (levels - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


class Shingler:
    """64-bit hashes of a text's shingles, from hashes of its words; remembers words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def set_of(self, text: bytes) -> np.ndarray:
        """Sorted different shingles. Texts of one to four words are one shingle; without a word, none."""
        words = text.split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > 400_000:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WORDS + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(h))):
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out = np.sort(out * np.uint64(0xBF58476D1CE4E5B9))
        return out[np.r_[True, out[1:] != out[:-1]]]


_rng = np.random.default_rng(5)
XOR, ODD = _rng.integers(0, 2**64, (T, 1), np.uint64), _rng.integers(0, 2**64, (T, 1), np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """A byte of each of T minhashes."""
    least = np.full(T, 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = (shingles[None, a : a + 4096] ^ XOR) * ODD
        least = np.minimum(least, part.min(axis=1))
    # as many values as shingles can be least, so that one byte of a mix tells them apart
    return ((least * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, cls (hash of the text's shingle set; null without words), n, sig (null unless the row's set is new to its
    batch: one row per set and batch carries it)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("cls", pa.int64()), ("roots", pa.list_(pa.int64())), ("sig", pa.binary())])
    runs = runs_for(RECALL, NUM / DEN, LEVELS)
    # the root's token is a whole minhash: a byte would let 1/256 of all sets meet
    root_xor, root_odd = XOR[:runs] ^ np.uint64(0x5851F42D4C957F2D), ODD[:runs]

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            classes, roots, sigs, met = [], [], [], set()
            for text in batch.column("text").to_pylist():
                own = shingler.set_of(text or b"")
                cls = xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63 if len(own) else None
                new = cls is not None and cls not in met
                met.add(cls)
                classes.append(cls)
                sigs.append(signature(own) if new else None)
                roots.append([(int(x) ^ (r * 0x9E3779B97F4A7C15 & (2**64 - 1))) - 2**63 for r, x in enumerate(((own[None, :] ^ root_xor) * root_odd).min(axis=1))] if new else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classes, pa.int64()), pa.array(roots, schema[2].type), pa.array(sigs, pa.binary())], schema=schema)

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(run, f"doc_id {kind.simpleString()}, cls long, roots array<long>, sig binary")


def bucketed(sets: DataFrame, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """(key, cls, sig, n): the buckets that sets fall into, large ones split on, and the sets of each."""
    rows = sets.select(F.explode("roots").alias("key"), "cls", "sig")
    done = []
    for level in range(1, levels + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        large = written(sizes.where(f"n > {small}"), f"large{level}")
        if level == levels or large.isEmpty():
            done.append(rows.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long"))))
            break
        tagged = rows.join(large, "key", "left")
        done.append(tagged.where("n IS NULL").withColumn("n", F.lit(1).cast("long")))
        # two coordinates sampled by the bucket's path: the same for all its sets
        at = F.transform(F.array(F.lit(1), F.lit(2)), lambda i: (F.pmod(F.xxhash64(F.col("key"), F.lit(level), i), F.lit(T)) + 1).cast("int"))
        child = F.transform(at, lambda i: F.xxhash64(F.col("key"), i, F.substring(F.col("sig"), i, F.lit(1))))
        rows = written(tagged.where("n IS NOT NULL").select(F.explode(F.array_distinct(child)).alias("key"), "cls", "sig"), f"level{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def tiled(rows: DataFrame, group: str, member: str, size: str, tile: int) -> DataFrame:
    """Rows of groups of more than `tile` members once for each pair of tiles that their tile is in: columns low, high
    (the pair of tiles) and own (the row's tile). Every two members of a group meet in one pair of tiles at least."""
    tiles = F.ceil(F.col(size) / tile).cast("int")
    rows = rows.withColumn("own", F.when(F.col(size) > tile, F.pmod(F.xxhash64(member), tiles)).otherwise(0).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(tiles, F.lit(1)) - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("low"), F.greatest(t, F.col("own")).alias("high")))
    return rows.withColumn("pair", F.explode(pairs)).select("*", "pair.low", "pair.high").drop("pair")


def groups(batches, keys: list[str]):
    """Tables of the consecutive rows that agree in keys (integers), of sorted batches; groups of one row are left out."""
    carry = None
    for batch in _and_end(batches):
        table = carry if batch is None else pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        differ = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            differ |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(differ) + 1).tolist(), table.num_rows]
        last = len(cuts) - 1 if batch is None else len(cuts) - 2
        for a, b in zip(cuts[:last], cuts[1 : last + 1], strict=False):
            if b - a > 1:
                yield table.slice(a, b - a)
        carry = None if batch is None else table.slice(cuts[-2])


def _and_end(batches):
    yield from batches
    yield None


def candidates(buckets: DataFrame) -> DataFrame:
    """Edges (a, b): each set with the least set of those it is joined to in its bucket."""

    def search(table):
        classes, first = np.unique(table.column("cls").to_numpy(), return_index=True)
        out_a, out_b = [], []
        if len(classes) > 1:
            sig = np.frombuffer(b"".join(table.column("sig").take(pa.array(first)).to_pylist()), np.uint8).reshape(-1, T)
            parent = np.arange(len(classes))
            for i in range(len(classes) - 1):
                near = np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1, dtype=np.int16) >= LEAST_EQUAL) + i + 1
                if len(near):
                    roots = np.unique(parent[np.r_[near, i]])
                    parent[np.isin(parent, roots)] = roots[0]
            moved = parent != np.arange(len(classes))
            out_a, out_b = classes[moved], classes[parent[moved]]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    rows = tiled(buckets, "key", "cls", "n", TILE)
    keys = ["key", "low", "high"]

    def run(batches):
        for table in groups(batches, keys):
            if (found := search(table)).num_rows:
                yield from found.to_batches()

    return rows.select(*keys, "cls", "sig").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the least node of its connected component. Each round joins a
    node's neighbours to the least of them, larger ones first and then smaller ones, until nothing changes, which takes
    rounds in the order of the logarithm of the longest path. A node of many edges is dealt to parts."""
    facts = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = facts(edges)
    while True:
        # large star: each node's larger neighbours to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = dealt_join(both.where("b > a"), around, "a", F.col("b"), merge=True).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = dealt_join(large, low, "a", F.col("b"), merge=True).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        edges = written(small.distinct(), "edges")
        after = facts(edges)
        if before == after:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which sets of a and b are similar: a boolean matrix. Sets share integers; 9 |x & y| >= 4 (|x| + |y|) at 4/5."""
    sizes_a, sizes_b = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    inter = np.zeros((len(a), len(b)), np.int64)
    flat, row = np.concatenate(a), np.repeat(np.arange(len(a)), sizes_a)
    other, col = np.concatenate(b), np.repeat(np.arange(len(b)), sizes_b)
    values, counts = np.unique_counts(np.concatenate([flat, other])) if a is not b else np.unique_counts(flat)
    terms = values[counts > 1]  # a term of one set alone is in no intersection
    for i in range(0, len(terms), 2048):
        some = terms[i : i + 2048]
        one, two = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for values, rows, into in ((flat, row, one), (other, col, two)):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[at] == values
            into[rows[hit], at[hit]] = 1
        inter += (one @ two.T).astype(np.int64)
    return (NUM + DEN) * inter >= NUM * (sizes_a[:, None] + sizes_b[None, :])


def exact_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of members (cls, copies, doc_id, root, n: sets in the component): edges (a, b) that join similar sets, and per
    cls links: the documents of other sets that are similar, links_sets: those sets."""

    def shingled(batches):
        shingler = Shingler()
        for batch in batches:
            rows = batch.to_pylist()
            sets = [shingler.set_of(r["text"] or b"") for r in rows]
            keep = [i for i, s in enumerate(sets) if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 == rows[i]["cls"]]
            yield pa.RecordBatch.from_pydict({"cls": pa.array([rows[i]["cls"] for i in keep], pa.int64()), "copies": pa.array([rows[i]["copies"] for i in keep], pa.int64()), "root": pa.array([rows[i]["root"] for i in keep], pa.int64()), "n": pa.array([rows[i]["n"] for i in keep], pa.int64()), "set": pa.array([sets[i].tobytes() for i in keep], pa.binary())})

    texts = docs.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS BINARY) AS text")
    own = marked(texts, F.col("_id"), members, F.col("doc_id")).where("maybe").join(members, F.col("_id").eqNullSafe(F.col("doc_id"))).select("cls", "copies", "root", "n", "text")
    sets = tiled(own.mapInArrow(shingled, "cls long, copies long, root long, n long, set binary"), "root", "cls", "n", TILE)

    def verify(table):
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        first = np.unique(table.column("cls").to_numpy(), return_index=True)[1]  # a doc_id may come twice
        table = table.take(pa.array(first))
        cls, copies, own = (table.column(c).to_numpy() for c in ("cls", "copies", "own"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        edges, docs_linked, sets_linked = [], np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        if len(a) and len(b):
            left = [sets[i] for i in a]
            near = linked(left, left if low == high else [sets[i] for i in b])
            if low == high:
                np.fill_diagonal(near, False)
            docs_linked[a] += near @ copies[b]
            sets_linked[a] += near.sum(axis=1)
            if low != high:
                docs_linked[b] += near.T @ copies[a]
                sets_linked[b] += near.sum(axis=0)
            # a forest of the links: components of the two sides, joined to their least member
            parent = np.arange(len(cls))
            for i in range(len(a)):
                to = b[near[i]]
                if len(to):
                    roots = np.unique(parent[np.r_[to, a[i]]])
                    parent[np.isin(parent, roots)] = roots[0]
            edges = parent
        partner = cls[edges] if len(edges) else cls
        return pa.table({"a": cls, "b": partner, "links": docs_linked, "links_sets": sets_linked})

    keys = ["root", "low", "high"]

    def run(batches):
        for table in groups(batches, keys):
            yield from verify(table).to_batches()

    found = sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, links long, links_sets long")
    found = written(found, "links")
    return found.select("a", "b"), found.groupBy("a").agg(F.sum("links").alias("links"), F.sum("links_sets").alias("links_sets")).withColumnRenamed("a", "cls")


def least_id() -> Column:
    """Of a group's rows: the least doc_id, null first."""
    return F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))["doc_id"]


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_set_links, cls (hash of its shingle set) and root (of its
    class).

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. class_id is the
    least doc_id (null first) of the rows that links connect; n_links counts the other rows that this row is linked to,
    copies included; n_set_links the different other shingle sets among them. A text of one to four words is one
    shingle; a null text or one without words is linked to nothing, and its class is its own doc_id. Rows with the same
    doc_id are documents of their own. An empty table gives an empty result; other columns are ignored.
    """
    seen = written(signatures(docs, id_col, text_col), "signatures")
    per_set = seen.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("copies"), least_id().alias("doc_id"))
    # one signature per set: any of the rows that carry it, as they are alike
    sets = written(seen.where("sig IS NOT NULL").groupBy("cls").agg(F.first("roots").alias("roots"), F.first("sig").alias("sig")), "sets")
    near = components(candidates(bucketed(sets)))
    size = near.groupBy("root").agg(F.count("*").alias("n"))
    sized = dealt_join(near, size, "root", F.col("node"), merge=True)
    members = written(sized.join(per_set, sized["node"] == per_set["cls"]).select("cls", "copies", "doc_id", "root", "n"), "members")
    edges, links = exact_links(docs, members, id_col, text_col)
    # sets that links connect, each with its component's least doc_id; the others are alone
    joined = components(edges).select(F.col("node").alias("cls"), "root").join(members.select("cls", "doc_id"), "cls")
    joined = dealt_join(joined, joined.groupBy("root").agg(least_id().alias("class_id")), "root", F.col("cls"), merge=True).select("cls", "root", "class_id", F.lit(True).alias("met"))
    labels = per_set.join(joined, "cls", "left").join(links, "cls", "left")
    zero = F.lit(0).cast("long")
    facts = labels.select("cls", "copies", F.coalesce("root", "cls").alias("root"), F.when(F.col("met"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), (F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("links_sets", zero).alias("n_set_links"))
    facts = written(facts, "facts")
    hot = facts.where(F.col("copies") > HOT).select(F.col("cls").alias("hot_"))
    rows = hot_join(seen.where("cls IS NOT NULL").select("doc_id", "cls", F.monotonically_increasing_id().alias("at")), facts, "cls", hot, F.col("at")).select("doc_id", "class_id", "n_links", "n_set_links", "cls", "root")
    return rows.unionByName(seen.where("cls IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_set_links"), "cls", F.col("cls").alias("root")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays for each class: the least doc_id (null first); of rows with the same id, that
    of the least hash of shingles, and of rows alike in both any. Texts without words all stay."""
    classes = written(ngram_classes(docs, id_col, text_col), "classes")
    rows = packed(docs, id=F.col(id_col))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        goes = written(classes.where("cls IS NOT NULL AND NOT (doc_id <=> class_id)").select("doc_id"), "goes")
        rows = marked(rows, F.col("id"), goes, F.col("doc_id"))
        rest = rows.where("maybe").join(goes, F.col("id").eqNullSafe(F.col("doc_id")), "left_anti")
        return rows.where("NOT maybe").unionByName(rest).select("row.*")
    # ids that repeat: a row is told by its id and its shingle set
    least = classes.where("cls IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "cls")).alias("x"))
    stays = written(least.select("x.doc_id", "x.cls"), "stays")
    kind = docs.schema[id_col].dataType

    def classed(batches):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.set_of(t or b"") for t in batch.column("text").to_pylist()]
            own = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 if len(x) else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), own], names=["row", "id", "own"])

    row = T_.StructType(docs.schema.fields)
    rows = packed(docs, id=F.col(id_col), text=F.col(text_col).cast("binary")).mapInArrow(classed, T_.StructType([T_.StructField("row", row), T_.StructField("id", kind), T_.StructField("own", T_.LongType())]))
    full = rows.join(stays, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("cls")), "left_semi")
    return full.groupBy("id", "own").agg(F.first("row").alias("row")).select("row.*").unionByName(rows.where("own IS NULL").select("row.*"))
