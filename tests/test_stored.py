"""The stored index and the vector lists against scoring everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import lists as L
from quarry.operators import retrieval as R
from quarry.operators import stored as S
from quarry.plans import search

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens(spark):
    return search._tokens(spark, DATA)


@pytest.fixture(scope="module")
def asked(spark):
    return search._terms_asked(spark, DATA)


def rows(df):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.collect())


def plain_scores(tokens, asked):
    """By the formula, without an index."""
    stats = I.corpus_stats(tokens)
    q = asked.join(I.document_frequency(tokens), "term").crossJoin(F.broadcast(stats)).select("qid", "term", I.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    return R.sparse_scores(q, I.postings(tokens, stats))


def test_batches_make_the_index_of_the_whole(spark, tokens, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 16)
    index = S.StoredIndex(spark, str(tmp_path / "i"), buckets=3, frequent=20)
    assert index.topk(asked, 5).collect() == []
    for side in (0, 1):
        index.add(tokens.where(f"id % 2 = {side}"), f"side {side}")
    index.add(tokens.where("id % 2 = 1"), "side 1")  # comes again
    assert index.blocks().groupBy("term").agg(F.max("part").alias("p")).where("p > 0").count() > 0
    want = plain_scores(tokens, asked)
    assert rows(index.scores(asked)) == rows(want)
    merged, df = I.merge_stats((I.corpus_stats(tokens.where("id % 2 = 0")), I.document_frequency(tokens.where("id % 2 = 0"))), (I.corpus_stats(tokens.where("id % 2 = 1")), I.document_frequency(tokens.where("id % 2 = 1"))))
    assert rows(index.statistics()) == rows(merged) and rows(index.terms().select("term", "df")) == rows(df)
    for k in (1, 7, 1000):
        assert rows(index.topk(asked, k)) == rows(R.top(want, k))


def test_unfinished_batch_is_not_read(spark, tokens, asked, tmp_path, monkeypatch):
    index = S.StoredIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(tokens.where("id % 2 = 0"), "a")
    before = rows(index.scores(asked))
    monkeypatch.setattr(index, "_load", lambda: 1 / 0)
    real = index._append

    def stop(frame, table, *by):
        real(frame, table, *by)
        if table == index.terms_table:
            raise RuntimeError("lost")

    monkeypatch.setattr(index, "_append", stop)
    with pytest.raises(RuntimeError):
        index.add(tokens.where("id % 2 = 1"), "b")
    again = S.StoredIndex(spark, str(tmp_path / "i"), buckets=2)
    assert rows(again.scores(asked)) == before
    again.add(tokens.where("id % 2 = 1"), "b")
    assert rows(again.scores(asked)) == rows(plain_scores(tokens, asked))


def test_index_is_found_again_without_its_tables(spark, tokens, asked, tmp_path):
    index = S.StoredIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(tokens, "all")
    for table in (index.postings_table, index.terms_table):
        spark.sql(f"DROP TABLE {table}")
    assert rows(S.StoredIndex(spark, str(tmp_path / "i"), buckets=2).scores(asked)) == rows(plain_scores(tokens, asked))


def test_less_is_read_for_the_same_rows(spark, tokens, asked, tmp_path):
    """Documents that hold a question's rare words leave little to its frequent ones."""
    common = spark.range(6000).select((F.col("id") + 10_000).alias("id"), F.array(F.lit("plain"), F.lit("word"), F.concat(F.lit("w"), F.col("id") % 7)).alias("terms"))
    rare = spark.range(50).select((F.col("id") + 90_000).alias("id"), F.array(F.lit("plain"), F.lit("kestrel"), F.concat(F.lit("r"), F.col("id") % 5)).alias("terms"))
    index = S.StoredIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(common.unionByName(rare), "all")
    q = spark.createDataFrame([(1, "plain"), (1, "kestrel"), (1, "r1"), (1, "unseen"), (2, "word"), (2, "w3"), (3, "kestrel"), (3, "plain")], "qid long, term string")
    read = []
    got = rows(index.topk(q, 10, read=read))
    assert got == rows(R.top(index.scores(q), 10))
    most = index._read(index.query_terms(q)).agg(F.sum("n")).first()[0]
    assert sum(b.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for b in read) < 0.7 * most
    even = rows(index.topk(q, 10, where=F.col("id") % 2 == 0))
    assert even == rows(R.top(index.scores(q).where("id % 2 = 0"), 10))
    allowed = common.where("id % 3 = 0").unionByName(rare.where("id % 3 = 0")).select("id")
    assert rows(index.topk(q, 10, allowed=allowed)) == rows(R.top(index.scores(q).where("id % 3 = 0"), 10))


def test_postings_are_not_shuffled(spark):
    """retrieve_topk's scores join the stored postings bucket by bucket."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = search.stored_index(spark, DATA)
        plan = index._read(index.query_terms(search._terms_asked(spark, DATA)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if index.postings_table in line)
    above = lines[next(i for i in range(at, -1, -1) if "SortMergeJoin" in lines[i]) : at]
    left = above[max(i for i, line in enumerate(above) if line.lstrip().startswith((":-", "+-", ": ", "+ ")) and len(line) - len(line.lstrip(" :")) <= 40) :]
    assert "Bucketed: true" in lines[at] and not any("Exchange" in line for line in left)


def test_index_is_made_once_for_the_same_files(spark):
    assert search.stored_index(spark, DATA) is search.stored_index(spark, DATA)
    assert search.stored_index(spark, DATA) is not search.stored_index(spark, "/root/testdata/sf0.01")


# ---- vectors


def some_vectors(spark, n, groups=0, seed=1):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, 16)) + (4 * rnd.normal(size=(groups, 16))[rnd.integers(0, groups, n)] if groups else 0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, v array<double>, label int"), v


def brute(v, queries, k, keep=lambda i: True):
    out = []
    for q in queries:
        cos = np.round(v @ v[q], 6)
        best = sorted((i for i in range(len(v)) if keep(i)), key=lambda i: (-cos[i], i))[:k]
        out += [(q, i, round(float(cos[i]), 5), r) for r, i in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("part,queries", [(L.PART, L.QUERIES), (7, 4)])
def test_exact_search(spark, monkeypatch, part, queries):
    """Also with lists of many parts, and many queries in several slices."""
    monkeypatch.setattr(L, "PART", part)
    monkeypatch.setattr(L, "QUERIES", queries)
    frame, v = some_vectors(spark, 300, groups=6)
    found = L.VectorLists(frame.unionByName(spark.createDataFrame([(999, None, 0)], frame.schema)), buckets=3)
    q = frame.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    asked = range(0, 300, 20)
    assert rows(found.search(q, 9)) == brute(v, asked, 9)
    assert rows(found.search(q, 9, F.col("label") == 1)) == brute(v, asked, 9, lambda i: i % 3 == 1)
    assert rows(found.search(q, 400)) == brute(v, asked, 400)


def test_bounds_leave_lists_out(spark):
    """Vectors in tight groups: the exact search meets few lists."""
    frame, v = some_vectors(spark, 400, groups=10)
    found = L.VectorLists(frame, lists=10)
    q = frame.where("id < 5").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    routes = found.routes(q)
    cos = np.sort(v[:5] @ v.T, axis=1)[:, -5]
    kept = sum(r["bound"] >= cos[r["qid"]] for r in routes.collect())
    assert kept < 0.7 * 5 * len(found.sizes)


def test_recall_of_lists(spark):
    """dense_topk_lists, at the parameters of the query, on vectors without clusters."""
    exact = search.vector_lists(spark, DATA).search(search._item_vectors(spark, DATA), 40, F.col("id") >= 0)
    want, got = ({(r["qid"], r[c]) for r in df.collect()} for df, c in ((exact, "id"), (search.dense_topk_lists(spark, DATA), "vec_id")))
    assert len(want & got) >= 0.9 * len(want)


def test_no_product_in_the_plans(spark):
    for df in (search.dense_topk_lists(spark, DATA), search.dense_topk_cosine(spark, DATA), search.dense_mode(spark, DATA)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_vectors(spark):
    frame, _ = some_vectors(spark, 3)
    q = frame.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    assert L.VectorLists(frame.where("false")).search(q, 3).collect() == []
