"""Batch scores against scoring every pair plainly."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import values as V
from quarry.operators import batch as B
from quarry.operators import index as I
from quarry.operators import records
from quarry.operators import retrieval as R
from quarry.plans import edges, search

from .conftest import DATA


def rows(df):
    return sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in df.select("qid", "id", "score", "rank").collect())


def test_parts_and_groups_give_what_all_pairs_give(spark):
    """However documents and queries are dealt, and with documents that may not be found."""
    tokens, asked = search._tokens(spark, DATA), search._terms_asked(spark, DATA)
    stats = I.corpus_stats(tokens)
    q = asked.join(I.document_frequency(tokens), "term").crossJoin(F.broadcast(stats)).select("qid", "term", I.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    scores = R.sparse_scores(q, I.postings(tokens, stats)).localCheckpoint()
    assert rows(B.best(tokens, asked, 10)) == rows(R.top(scores, 10))
    assert rows(B.best(tokens, asked, 10, part=9000, group=7)) == rows(R.top(scores, 10))
    assert rows(B.best(tokens, asked, 10, tokens.where("id % 3 = 1"), part=9000)) == rows(R.top(scores.where("id % 3 = 1"), 10))


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, []), (2, ["a", "b", "a"]), (3, ["b"])], "id long, terms array<string>")
    asked = spark.createDataFrame([("x", "a"), ("y", "none")], "qid string, term string")
    assert [(r["qid"], r["id"], r["rank"]) for r in B.best(docs, asked, 5).collect()] == [("x", 2, 1)]
    assert B.best(docs, asked.where("false"), 5).count() == 0 and B.best(docs.where("false"), asked, 5).count() == 0


def test_pairs_are_not_moved(spark):
    """Of the documents' side only terms are shuffled, and nothing by query and document."""
    plan = B.best(search._tokens(spark, DATA), search._terms_asked(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(qid#" in plan
    assert not any("hashpartitioning" in line and "qid#" in line and " id#" in line.split("hashpartitioning")[1].split(")")[0] for line in plan.splitlines())


def test_cost_is_rounded_as_binary(spark, duck):
    """Of 0.0020315 and the like, as DuckDB rounds them."""
    n = spark.range(20_000).select("id", records.cost(F.col("id"), F.lit(5)).alias("usd"))
    sql = f"SELECT i, round((i * {V.INPUT_RATE}::DOUBLE + 5 * {V.OUTPUT_RATE}::DOUBLE) / 1000000, 6) FROM range(20000) t(i)"
    assert {r["id"]: r["usd"] for r in n.collect()} == dict(duck.execute(sql).fetchall())


@pytest.mark.parametrize("query", [search.diversify_cap2, edges.sweep_configs, edges.answer_pass])
def test_no_index_is_built(spark, monkeypatch, query):
    """Documents are scored where they are read: postings of all terms, and a row for each pair, took the disk."""
    monkeypatch.setattr(search, "stored_index", lambda *_: 1 / 0)
    assert query(spark, DATA).columns
