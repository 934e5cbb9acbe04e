"""Operators that compare rows: against brute force, and on hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, ngram_join, shared, toxicity, weak_quality


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check_groups(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t or ""), i is not None, i if i is not None else 0))
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    for text, own in groups.items():
        best = min(own)
        mine = by[hashlib.sha256(text.encode()).hexdigest()]
        assert len(mine) == len(own) and all(r["group_size"] == len(own) and r["keep_id"] == (best[2] if best[1] else None) for r in mine)
        assert sum(r["kept"] for r in mine) == 1


def test_exact_groups(odd, none, documents, spark):
    check_groups(documents)
    check_groups(odd)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len({squeezed(r["text"]) for r in odd.collect()})
    hot = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 > 0, 'a hot text', CONCAT('t', id)) AS text")
    check_groups(hot)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_index_persists_and_appends(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/one/index", 4)
    assert exact_dedup.exact_dedup(rows_of(spark, [(1, "a b"), (2, "ab"), (3, "c")]), index, 0).count() == 2
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/one/index", 4)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(rows_of(spark, [(7, "ab"), (8, "new")]), again, 1).collect()}
    assert (got[7]["kept"], got[7]["keep_id"]) == (False, 1) and got[8]["kept"] and index.rows().count() == 3
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(rows_of(spark, [(9, "x")]), again)


def test_a_batch_that_comes_again_keeps_the_same_rows(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    exact_dedup.exact_dedup(rows_of(spark, [(1, "old")]), index, 0).collect()
    batch = rows_of(spark, [(2, "old"), (3, "new"), (4, "new "), (5, "alone"), (5, "alone")])
    kept = lambda: sorted(r["doc_id"] for r in exact_dedup.exact_dedup(batch, index, 1).collect())
    flags = lambda: sorted((r["doc_id"], r["kept"], r["keep_id"]) for r in exact_dedup.exact_groups(batch, index, 1).collect())
    assert kept() == [4, 5] and kept() == [4, 5] and index.rows().count() == 3
    assert flags() == [(2, False, 1), (3, False, 4), (4, True, 4), (5, False, 5), (5, True, 5)]


def test_indexes_with_equal_folder_names(spark, tmp_path):
    indexes = [exact_dedup.DigestIndex(spark, f"file://{tmp_path}/{k}/x/index", 4) for k in "ab"]
    for index in indexes:
        assert exact_dedup.exact_dedup(rows_of(spark, [(1, "a")]), index, 0).count() == 1
    indexes[0].forget()
    assert exact_dedup.exact_dedup(rows_of(spark, [(2, "a")]), exact_dedup.DigestIndex(spark, f"file://{tmp_path}/a/x/index", 4), 1).count() == 0


def test_no_table_is_left_in_the_catalog(spark, documents):
    exact_dedup.exact_groups(documents).collect()
    left = {t.name for t in spark.catalog.listTables() if t.name.startswith("quarry_digests")}
    exact_dedup.exact_dedup(documents).collect()
    assert left == {t.name for t in spark.catalog.listTables() if t.name.startswith("quarry_digests")}


def test_hot_join_is_a_join(spark):
    many = spark.range(4000).selectExpr("IF(id % 3 = 0, 7, id % 50) AS k", "id AS v")
    one = spark.range(60).selectExpr("id AS k", "id * id AS w")
    want = Counter(tuple(r) for r in many.join(one, "k").select("k", "v", "w").collect())
    hot = spark.createDataFrame([(7,)], "hot_ long")
    for got in (shared.hot_join(many, one, "k", hot, F.col("v")), shared.dealt_join(many, one, "k", F.col("v"))):
        assert Counter(tuple(r) for r in got.select("k", "v", "w").collect()) == want


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def check_links(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = lambda own: min(((rows[i][0] is not None, rows[i][0] or 0) for i in own))
    want = Counter()
    for own in groups.values():
        low = least(own)
        for i in own:
            want[rows[i][0], low[1] if low[0] else None, links[i]] += 1
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_classes(df).collect()) == want


def near_copies(n, seed=0, words=60):
    """A large group of near copies, a chain, and unrelated texts that share a passage."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        own[rng.randrange(words)] = f"z{i % 7}"
        out.append(" ".join(own))
    chain = [f"c{i}" for i in range(100)]
    for i in range(8):
        out.append(" ".join([*(f"k{j}" for j in range(2 * i)), *chain[2 * i :]]))
    passage = " ".join(f"p{i}" for i in range(30))
    out += [" ".join(f"u{i}x{j}" for j in range(30)) + " " + passage for i in range(n // 2)]
    return list(enumerate(out))


def test_links(spark, odd, none, documents, monkeypatch):
    check_links(documents)
    check_links(odd)
    assert ngram_join.ngram_classes(none).count() == 0
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join.bucketed, "__defaults__", (8, 3))
    check_links(spark.createDataFrame(near_copies(90), "doc_id long, text string"))


def test_one_of_each(spark, odd, documents):
    kept = ngram_join.one_of_each(documents).select("doc_id").collect()
    classes = ngram_join.ngram_classes(documents).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r["class_id"] for r in classes})
    got = ngram_join.one_of_each(odd)
    roots = {r["root"] for r in ngram_join.ngram_classes(odd).collect()} - {None}
    empty = sum(not (r["text"] or "").split() for r in odd.collect())
    assert got.columns == odd.columns and got.count() == len(roots) + empty


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_components_of_a_star(spark, monkeypatch):
    """A node of more edges than one task gets."""
    edges = [(5000, i) for i in range(1500)] + [(5000 + i, 5001 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 1531 and set(got.values()) == {0}


def test_recall_bound():
    met = 0.8 * (1 - 0.2**2) ** (ngram_join.LEVELS - 1)  # one coordinate at the root, two at each split
    runs = ngram_join.runs_for(ngram_join.RECALL, 0.8, ngram_join.LEVELS)
    assert (1 - met) ** runs <= 1e-4 < (1 - met) ** (runs - 1)


def test_recall_against_an_exact_join(spark):
    """All pairs of 1,000 documents, by an inverted index from shingle to documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r["text"]) for r in rows]
    having = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            having[x].append(i)
    common = Counter(p for own in having.values() for k, i in enumerate(own) for p in ((i, j) for j in own[k + 1 :]))
    links = Counter()
    for (i, j), n in common.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_classes(docs).collect()}
    want = {r["doc_id"]: links[i] for i, r in enumerate(rows)}
    found = sum(min(got[k], want[k]) for k in want)
    assert sum(want.values()) > 100 and all(got[k] <= want[k] for k in want) and found == sum(want.values())


def test_permutation_and_back():
    for n in (1, 2, 5, 17, 1000):
        p = mixing.permuted(np.arange(n), n, 99)
        assert sorted(p.tolist()) == list(range(n)) and mixing.permuted(p, n, 99, back=True).tolist() == list(range(n))


def shares(sizes, weights, total, most=2):
    """Shares by weight; what is above most times its size stops there, and the rest is shared again."""
    out, free, left = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0], min(total, float(most * sum(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over] if over else []
    return out


@pytest.mark.parametrize("sizes,weights,share", [([100, 1000, 1000], (3, 1, 2), 1.5), ([0, 10], (3, 1), 1.5), ([10, 10], (1, 1), 5.0), ([1, 2, 3, 500, 7, 900], (3, 1, 2), 1.5), ([0, 0], (1,), 1.5)])
def test_targets_reshare_the_excess(spark, sizes, weights, share):
    rows = spark.createDataFrame(list(enumerate(sizes)), "number long, size long")
    got = [r["target"] for r in mixing.with_targets(rows, sum(sizes), share, weights).orderBy("number").collect()]
    assert got == pytest.approx(shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes)))


def word_places(rows, seed=17, block_words=256):
    """taken of each row, word by word: sources laid out in blocks, slots in passes, blocks by permutation."""
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in sources[s]) for s in order]
    goals = shares(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes))
    out = Counter()
    for number, (s, size, goal) in enumerate(zip(order, sizes, goals, strict=True)):
        buckets = max(1, -(-len({(r["doc_id"], r["hash"]) for r in sources[s]}) // mixing.BUCKET_ROWS))
        owner = []
        for r in sorted(sources[s], key=lambda r: (r["hash"] % buckets, r["doc_id"] is not None, r["doc_id"] or 0, r["hash"])):
            owner += [r["at"]] * r["size"]
        blocks, left, taken = -(-size // block_words), round(goal), 0
        while left > 0:
            for slot in range(blocks):
                block = int(mixing.permuted(np.array([slot]), blocks, mixing.key_of(seed, number, taken))[0])
                own = owner[block * block_words : (block + 1) * block_words][:left]
                out.update(own)
                left -= len(own)
                if not left:
                    break
            taken += 1
    return out


def check_mix(df, **options):
    rows = [r.asDict() | {"at": i} for i, r in enumerate(df.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("hash")).collect())]
    for r in rows:
        r["size"] = len((r["text"] or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, shares([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values())), strict=True))
    got = mixing.mix_figures(df, **options).collect()
    taken = word_places(rows, **options)
    want = sorted((repr(r["doc_id"]), r["size"], sizes[r["source"]], round(goal[r["source"]], 6), taken[r["at"]]) for r in rows)
    assert sorted((repr(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    for s in sizes:
        assert sum(taken[r["at"]] for r in rows if r["source"] == s) == round(goal[s])
    return sorted(map(tuple, got), key=repr)


def test_mix_meets_targets_and_reruns_agree(odd, none, documents):
    assert check_mix(documents) == check_mix(documents)
    check_mix(documents, block_words=16)
    check_mix(odd)
    assert mixing.mix_figures(none).count() == 0
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == documents.columns
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert words == sum(r[4] for r in check_mix(documents))
    assert mixing.mix_documents(none).count() == 0


def test_mixed_texts(spark, odd, documents):
    """What the mix gives of a document: as many words as are taken, all of them its own, in order."""
    for df in (documents, odd):
        taken = Counter()
        for r in mixing.mix_figures(df).collect():
            taken[r["doc_id"]] += r["taken"]
        texts = defaultdict(set)
        for r in df.collect():
            texts[r["doc_id"]].add(r["text"])
        got = mixing.mix_documents(df).collect()
        assert all(any(set(r["text"].encode().split()) <= set((t or "").encode().split()) for t in texts[r["doc_id"]]) for r in got)
        given = Counter()
        for r in got:
            given[r["doc_id"]] += len(r["text"].encode().split())
        assert given == +taken


def test_rows_that_are_alike_and_many(spark):
    """A third of all rows are one; they are neither one bucket nor one row of the mix."""
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 1, id) AS doc_id", "IF(id % 3 = 0, 'one row of many', CONCAT('w', id, ' x y z')) AS text", "CONCAT('s', IF(id % 3 = 0, 0, id % 4)) AS source")
    check_mix(df, block_words=7)
    assert sum(len(r["text"].split()) for r in mixing.mix_documents(df, block_words=7).collect()) == sum(r["taken"] for r in mixing.mix_figures(df, block_words=7).collect())


def test_more_sources_than_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 8)
    monkeypatch.setattr(mixing, "PART", 16)
    check_mix(spark.range(400).selectExpr("id AS doc_id", "REPEAT(CONCAT('w', id, ' '), CAST(1 + id % 90 AS INT)) AS text", "CONCAT('s', id % 57) AS source"), block_words=4)


def test_shards_are_of_one_length_and_use_every_slot():
    slots = np.array([70, 10, 0, 33, 9000])
    got = list(mixing.drawn(slots, 0, -(-9113 // 16), 3, 16))
    assert [k for k, *_ in got] == list(range(570)) and (sum(c for _, c, _ in got) == slots).all()
    assert [int(c.sum()) for _, c, _ in got] == [16] * 569 + [9113 - 569 * 16]
    before = np.zeros_like(slots)
    for _, counts, given in got:
        assert (given == before).all()
        before = before + counts
    # a task that draws some shards alone draws the same
    assert [(k, c.tolist()) for k, c, _ in mixing.drawn(slots, 100, 130, 3, 16)] == [(k, c.tolist()) for k, c, _ in got[100:130]]
    # the law: a shard's expected counts are the groups' shares
    many = np.array([next(c for _, c, _ in mixing.drawn(slots, 5, 6, seed, 16)) for seed in range(2000)])
    assert np.abs(many.mean(axis=0) - 16 * slots / 9113).max() < 0.05


def test_shards_of_a_huge_mix_are_not_longer():
    slots = np.array([60_000_000_000, 5_000_000_000, 7])
    shards = -(-int(slots.sum()) // mixing.SHARD_SLOTS)
    for k in (0, shards // 3, shards - 2):
        got = list(mixing.drawn(slots, k, k + 2, 1))
        assert len(got) == 2 and all(c.sum() == mixing.SHARD_SLOTS or s == shards - 1 for s, c, _ in got) and all((c >= 0).all() for _, c, _ in got)


def segments_by_definition(s):
    best = None
    for i in range(len(s)):
        for j in range(i, len(s)):
            t = s[i : j + 1].sum()
            if t > 0 and (best is None or t > best[2] + 1e-12):
                best = (i, j + 1, t)
    if best is None:
        return []
    a, b, _ = best
    return segments_by_definition(s[:a]) + [best] + [(x + b, y + b, t) for x, y, t in segments_by_definition(s[b:])]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(200):
        s = np.array([rng.uniform(-2, 2) for _ in range(rng.randint(0, 25))])
        assert [(a, b, pytest.approx(t)) for a, b, t in toxicity.maximal_segments(s)] == segments_by_definition(s)


def scores_by_definition(rows, labels):
    """Each text's score, from the formulas: counts of units, log-odds, segments, lambda, K and the logistic fit. rows:
    (doc_id, text); labels: {doc_id: toxic}."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    own = lambda w: [w] + [w[:k] + "*" for k in (6, 4) if len(w) > k]
    train = {}
    for i, t in sorted(rows):
        if t is not None and not held(i) and i in labels:
            train.setdefault(t, labels[i])
    n = Counter(train.values())
    docs = {1: Counter(), 0: Counter()}
    for t, y in train.items():
        docs[y].update({u for w in words(t) for u in own(w)})
    weights = {}
    for u in docs[1]:
        y1, y0 = docs[1][u], docs[0][u]
        if y1 + y0 == n[0] + n[1]:
            continue
        prior = 50 * (y1 + y0) / (n[0] + n[1])
        odds = math.log((y1 + prior) / (n[1] + 50 - y1 - prior)) - math.log((y0 + prior) / (n[0] + 50 - y0 - prior))
        if y1 >= 4 and abs(odds) / math.sqrt(1 / max(y1 + prior, 0.5) + 1 / max(y0 + prior, 0.5)) >= 4:
            weights[u] = max(-4, min(4, odds))

    def tokens(t):
        ws = words(t)
        found = [[weights[u] for u in own(w) if u in weights] for w in ws]
        return [-0.4 if i and ws[i] == ws[i - 1] or not f else max(f, key=abs) for i, (w, f) in enumerate(zip(ws, found, strict=True))]

    def best(s):
        top = run = 0.0
        for x in s:
            run = max(0.0, run + x)
            top = max(top, run)
        return top

    clean = Counter(round(x, 1) for t, y in train.items() if not y for x in tokens(t))
    low, high, total = 0.0, 60.0, sum(clean.values())
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (lam, high) if sum(c * math.exp(lam * x) for x, c in clean.items()) < total else (low, lam)
    tops = [(len(words(t)), best(tokens(t)), y) for t, y in train.items()]
    k = (sum(x > 0 for _, x, y in tops if not y) + 1) / (sum(m * math.exp(-lam * x) for m, x, y in tops if not y) + 10)
    nats = lambda m, x: math.asinh(lam * x - math.log(k * max(1, m)))
    slope, offset = toxicity.logistic(np.array([nats(m, x) for m, x, _ in tops]), np.array([float(y) for *_, y in tops]))
    return {i: 1 / (1 + math.exp(-max(-30, min(30, slope * nats(len(words(t)), best(tokens(t))) + offset)))) for i, t in rows}


def test_toxicity_scores_by_definition(spark):
    rng = random.Random(6)
    prose = [f"word{i}" for i in range(60)]
    rows, labels = [], {}
    for i in range(400):
        toxic = i % 4 == 0
        own = [rng.choice(prose) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(1, 3) if toxic else rng.random() < 0.03):
            own.insert(rng.randrange(len(own)), rng.choice(["idiot", "idiotic", "moron", "moron"]))
        rows.append((i, " ".join(own)))
        if rng.random() < 0.9:
            labels[i] = int(toxic)
    rows += [(1000, ""), (1001, None), (1002, rows[1][1]), (1003, "moron moron moron idiot")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic_passages(documents, toxicity.train(documents, marks)).collect()}
    want = scores_by_definition(rows, labels)
    assert {i: pytest.approx(r["score"], abs=1e-6) for i, r in got.items()} == want
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (want[i] >= 0.5) for i in want)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct", plan)


def test_toxicity_has_one_plan_for_few_and_many_labels(spark, documents):
    own = documents.select("doc_id", "text").withColumn("hash", F.xxhash64("text"))
    few, many = (toxicity._labelled(own, spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")) for n in (10, 10_000_000))
    assert joins(few) == joins(many) and "SortMergeJoin" in joins(few)


def test_extreme_value_fit():
    """K of scores drawn from the law itself."""
    rng = np.random.default_rng(3)
    n = rng.integers(50, 2000, 20_000)
    scores = np.log(0.02 * n / -np.log(rng.random(20_000))) / 0.7
    assert toxicity.extremes(0.7, list(zip(n.tolist(), scores.tolist(), strict=True))) == pytest.approx(0.02, rel=0.05)


def test_toxic_words_rarer_than_100_000_others(spark):
    """The vocabulary has no size that a rare toxic word could miss."""
    letters = "abcdefghijklmnopqrs"
    prose = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[k], f"{prose if k < 26 else ''} own{k} {'zzzz' if k < 25 else ''}", 1) for k in range(40)] + [(ids[40 + k], f"clean{k} abab", 0) for k in range(200)]
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8)
    model = toxicity.train(documents, spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    assert len(prose.split()) > 100_000 and model.weights["zzzz"] > 1


def test_toxicity_on_held_out_documents(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    rows = toxicity.toxic_passages(documents, model).join(labels, "doc_id").where("held_out").collect()
    hit = [(r["predicted"], r["toxic"]) for r in rows]
    assert sum(p == t for p, t in hit) >= 0.95 * len(hit) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxic_passages(odd, model).count() == odd.count() and toxicity.toxic_passages(none, model).count() == 0
    flat = toxicity.train(none, labels.where("false"))
    assert {r["predicted"] for r in toxicity.toxic_passages(odd, flat).collect()} <= {0, 1}


def test_weak_quality_agrees_with_labels(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = weak_quality.train(documents)
    rows = weak_quality.quality_scores(documents, model).join(labels, "doc_id").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.2 * len(junk)
    assert weak_quality.quality_scores(odd, model).count() == odd.count()
    assert weak_quality.quality_scores(none, weak_quality.train(none)).count() == 0


def votes_by_definition(text):
    """The twelve labellers' votes, from what each asks."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    if not n:
        return [2] * 11 + [0]
    vote = lambda x, good, bad: 1 if x <= good else 0 if x >= bad else 2
    raw = text.encode()
    black = [b for b in raw if b not in b" \t\n\r\x0b\x0c"]
    letters = [b for b in raw if b >= 128 or chr(b).isalpha()]
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    plain = sum(bool(re.search(r"[A-Za-z0-9\x80-\U0010ffff][.,;:?!\"')]?$", w)) for w in words)
    ends = sum(x.rstrip(" \t\r\n\x0b\x0c").endswith((".", "!", "?", '"', ":", "\u2026")) for x in lines)
    mean = len(text) / n
    return [
        vote(sum(c in "#*$%&|<>{}[]\\^~=" for c in text) / n, 0.02, 0.25),
        vote(1 - len(letters) / len(black), 0.1, 0.2),
        vote(1 - plain / n, 0.05, 0.3),
        vote(upper / max(1, upper + lower), 0.2, 0.5) if upper + lower >= 10 else 2,
        vote(1 - len(set(words)) / n, 0.5, 0.7) if n >= 20 else 2,
        vote(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 0.02, 0.1),
        vote(max(words.count(w) for w in set(words)) / n, 0.12, 0.2) if n >= 20 else 2,
        vote(1 - len(set(lines)) / len(lines), 0.1, 0.3) if len(lines) >= 3 else 2,
        vote(text.count("!") / n, 0.03, 0.2),
        1 if 3 <= mean <= 11 else 0 if mean < 2 or mean > 16 else 2,
        vote(1 - ends / len(lines), 0.4, 0.9) if n >= 20 else 2,
        1 if n >= 50 else 0 if n < 3 else 2,
    ]


def em_by_definition(votes, rounds=100):
    """Posterior of good of each document: expectation and maximisation document by document, labeller by labeller."""
    p = [(v.count(1) + 1) / (v.count(1) + 2 * v.count(0) + 2) for v in votes]
    for _ in range(rounds):
        prior = min(0.99, max(0.01, sum(p) / len(p)))
        says = {}
        for j in range(len(votes[0])):
            for y in (0, 1):
                n = [1 + sum((q if y else 1 - q) for v, q in zip(votes, p, strict=True) if v[j] == k) for k in (0, 1)]
                for k in (0, 1):
                    says[y, j, k] = n[k] / sum(n)
        new = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(says[1, j, k] / says[0, j, k]) for j, k in enumerate(v) if k != 2)
            new.append(1 / (1 + math.exp(-max(-700, min(700, odds)))))
        done = max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9
        p = new
        if done:
            break
    return p


def test_weak_quality_by_definition(spark, documents):
    """Votes, posteriors and the scorer's answers, document by document."""
    rows = documents.select("doc_id", "text").collect()
    votes = [votes_by_definition(r["text"]) for r in rows]
    assert votes == [weak_quality.votes(r["text"].encode()) for r in rows]
    model = weak_quality.train(documents)
    got = {r["doc_id"]: r for r in weak_quality.quality_scores(documents, model).collect()}
    want = em_by_definition(votes)
    assert all(got[r["doc_id"]]["posterior"] == pytest.approx(p, abs=1e-6) for r, p in zip(rows, want, strict=True))

    def shape(w):
        for pattern, to in ((rb"[a-z\x80-\xff]+", b"x"), (rb"[A-Z]+", b"X"), (rb"[0-9]+", b"9")):
            w = re.sub(pattern, to, w)
        return zlib.crc32(w[:12])

    for r in rows:
        words = r["text"].encode().split()
        shapes = list(map(shape, words))
        found = Counter(zlib.crc32(b"w" + w.lower()) % 65536 for w in words)
        found.update(x % 65536 for x in shapes)
        found.update((a * 31 + b * 17 + 7) % 65536 for a, b in zip(shapes, shapes[1:], strict=False))
        z = model.offset + sum(model.weights[k] * math.sqrt(c / len(words)) for k, c in found.items()) + model.weights[zlib.crc32(b"length%d" % len(words).bit_length()) % 65536]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def test_em_finds_the_poor_labeller():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth).astype(int) for a in (0.95, 0.9, 0.85, 0.55)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.estimate(patterns, counts.astype(float))
    right = (model.chance[1, :, 1] + model.chance[0, :, 0]) / 2
    assert abs(model.prior - 0.7) < 0.05 and np.abs(right - [0.95, 0.9, 0.85, 0.55]).max() < 0.05
