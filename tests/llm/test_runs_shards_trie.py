"""Periodic runs, histogram shards and the prefix trie against plain definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import periodic_runs as P
from quarry.llm import prefix_trie as T
from quarry.llm import sharding as S

# ---- periodic runs


def stretches(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, z - a, p) for (a, z), p in found.items())


def texts_with_runs(seed):
    rnd = random.Random(seed)
    for _ in range(rnd.randint(1, 8)):
        n = rnd.choice([0, 1, 5, 6, 7, 40, 150, 600])
        own = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(n)]
        for _ in range(rnd.randint(0, 4)):
            if n > 10:
                a, p = rnd.randrange(n), rnd.randint(1, 60)
                for i in range(a + p, min(n, a + rnd.randint(1, 400))):
                    own[i] = own[i - p]
        yield np.array(own, np.int64)


@pytest.mark.parametrize("grid", [P.GRID, 50])
def test_runs_are_those_of_the_definition(grid, monkeypatch):
    monkeypatch.setattr(P, "GRID", grid)
    for seed in range(40):
        texts = list(texts_with_runs(seed))
        got = list(zip(*(x.tolist() for x in P.find_runs(texts)), strict=True))
        assert got == [(d, *run) for d, t in enumerate(texts) for run in stretches(t.tolist())]


def test_sampled_prefixes():
    """LCE from samples alone, against a comparison word by word."""
    rnd = np.random.default_rng(1)
    words = np.concatenate([[-1], np.tile(rnd.integers(0, 2, 40), 12), [-1], rnd.integers(0, 2, 500), [-1], np.zeros(300, np.int64), [-1]])
    text = np.repeat([0, 1, 2], [482, 501, 301])
    got, want = [], []
    for low, high in ((1, 481), (482, 982), (983, 1283)):
        a = rnd.integers(low, high, 300)
        b = rnd.integers(low, high, 300)
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        got += P.extensions(words, text, a, b).tolist()
        want += P.agreement(words, a, b, np.full(len(a), 600)).tolist()
    assert got == want


def figures(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = stretches(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_odd_texts(spark, odd, none):
    more = spark.createDataFrame([(i, " ".join(["a", "b"][: 1 + i % 2] * (3 + i)) + " c" * (i % 9), None, None, None) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.select(more.columns).where("text IS NULL OR length(text) < 1000").unionByName(more)
    want = sorted((figures(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in P.periodic_runs(docs, plant=True).collect()), key=repr) == want
    assert P.periodic_runs(odd, plant=True).count() == odd.count()
    assert P.periodic_runs(none, plant=True).collect() == []


def test_runs_and_collapsed_text_are_given(spark):
    row = P.periodic_runs(spark.createDataFrame([(1, "x " + "la li " * 6 + "end")], "doc_id long, text string"), whole=True).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 12, 2)] and row["collapsed"] == "x la li end"


# ---- histogram shards


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    for own in out.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return out


def test_shards_are_even_and_keep_equal_texts_together(spark):
    """400 texts of four copies each: no group is cut, and no shard is off by more than the tolerance and a group."""
    docs = spark.createDataFrame([(i, f"text {i // 4} " + "x" * (i // 4 % 90)) for i in range(1600)], "doc_id long, text string").repartition(5)
    rows = S.shard_figures(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1600))
    shards = by_shard(rows)
    total = sum(r["size"] for r in rows)
    bound = 2 * max(S.TOLERANCE * total / 8, 4 * 120)
    assert len(shards) == 8 and all(abs(sum(r["size"] for r in own) - total / 8) <= bound for own in shards.values())
    rows = S.histogram_shards(docs, tolerance=0.05).collect()
    homes = defaultdict(set)
    for r in rows:
        homes[r["row"]["text"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_hot_text_is_cut_into_bounded_ranges(spark):
    """Two thirds of all rows are one text, half of them with one id; the parts of a task stay small."""
    docs = spark.createDataFrame([(7 if i % 2 else i, "same text") for i in range(2000)] + [(i, f"own {i}") for i in range(1000)], "doc_id long, text string")
    shards = by_shard(S.shard_figures(docs).collect())
    assert max(sum(r["size"] for r in own) for own in shards.values()) - min(sum(r["size"] for r in own) for own in shards.values()) <= 2 * 10
    keys = docs.select(F.concat(S._digits(F.col("text").cast("binary")), S._digits(F.col("doc_id").cast("string").cast("binary")), S._digits(F.monotonically_increasing_id().cast("string").cast("binary"))).alias("key"), F.lit(10).cast("long").alias("size"))
    ranges, cuts = S.boundaries(keys, 8)
    rows = sorted(zip([n for _, n in ranges], [n for _, n in ranges[1:]] + [3000], strict=True))
    assert max(b - a for a, b in rows) <= 3000 / S.RANGE_PART + 1 and len(cuts) == 7


def test_shards_do_not_depend_on_files(documents):
    table = lambda df: sorted(map(tuple, S.shard_figures(df).collect()))
    assert table(documents) == table(documents.repartition(7, "text"))


def test_odd_rows_and_few_rows_in_shards(spark, odd, none):
    rows = S.histogram_shards(odd).collect()
    assert Counter(repr(r["row"]) for r in rows) == Counter(map(repr, odd.collect()))
    by_shard(rows)
    assert all(r["size"] == len((r["row"]["text"] or "").encode()) + 1 for r in rows)
    assert S.shard_figures(none).collect() == []
    few = S.shard_figures(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted((r["size"], r["text_crc32"], r["slot"]) for r in few) == [(1, 0, 0), (1, 0, 0)]


def test_saved_shards(spark, tmp_path):
    S.save_shards(S.histogram_shards(spark.range(50).selectExpr("id AS doc_id", "string(id) AS text"), 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 3


# ---- prefix trie


def trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new = own.get(c - c % 100, [])[:h] + t[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    children = Counter(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1]) if n else 0)
            leaves[n[:d]] += not children[n]
    sha = lambda c: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(ends[n])) for n, m in members.items()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def some_conversations(seed, longest):
    rnd = random.Random(seed)
    return [(c, k if rnd.random() < 0.97 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bc", "é😀", "", None])) for c in rnd.sample(range(450), 160) + [None] for k in range(rnd.choice([1, 2, 3, 8, longest]))]


@pytest.mark.parametrize("band,longest", [(2, 17), (3, 9), (3, 10), (T.BAND, 70)])
def test_trie_is_that_of_the_definition(spark, band, longest):
    rows = some_conversations(band, longest)
    got = T.prefix_trie(spark.createDataFrame(rows, TURNS), band=band)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie(rows)


def test_odd_conversations(spark, monkeypatch):
    """Turnless conversations, equal turns, repeated rows, many turns out of order, hot parents, clashing names, no rows."""
    monkeypatch.setattr(T, "HOT", 3)
    rows = [(101, 0, "user", "x")] * 3 + [(200, None, None, None), (205, 5, "b", "2"), (205, 5, "a", "1")] + [(300, t, "user", str(t % 5)) for t in range(600, 0, -1)] + [(c, 0, "user", f"only {c % 13}") for c in range(1000, 1060)]
    rows += [(c, 0, "user", "own") for c in range(3001, 3009)]
    rows += [(c, t, "user", "hello" if t < 8 else f"t{c}") for c in range(2000, 2040) for t in range(9)]
    docs = spark.createDataFrame(rows, TURNS)
    for name in ("conv", "key", "i", "k", "d", "up", "part", "band", "own", "n", "base", "h", "chars", "hot_", "salt_"):
        docs = docs.withColumn(name, F.lit("x"))
    got = sorted((tuple(r) for r in T.prefix_trie(docs).collect()), key=repr)
    assert got == trie(rows) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)
    assert T.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_ends_of_many_ranges(spark):
    rows = spark.range(20_000).selectExpr("'k' AS key", "id * 3 AS conv")
    assert T.ends_digests(rows).first()["ends_sha256"] == hashlib.sha256(",".join(str(3 * i) for i in range(20_000)).encode()).hexdigest()
