"""Hybrid retrieval for many queries at once: sparse and dense legs, fusion, pins, rerank order, diversity.

Ranks are taken on scores rounded to six places, with ties broken by id, so that plans and engines agree. Only ids and
scores move through the ranking; payloads are joined to the winners at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import values as V


def top(rows: DataFrame, k: int, by: str = "score", qid: str = "qid", key: str = "id") -> DataFrame:
    """The k best of each query, with their rank from 1. A filter on rank over row_number is pruned before the shuffle."""
    best = Window.partitionBy(qid).orderBy(F.desc(by), key)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def sparse_scores(query_terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, id, score): sums of weight times idf over shared terms."""
    return postings.join(query_terms, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("score"))


def sparse_leg(query_terms: DataFrame, postings: DataFrame, k: int = V.POOL) -> DataFrame:
    """(qid, id, score, rank): the k best of each query."""
    return top(sparse_scores(query_terms, postings), k)


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double precision; vectors are of unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fuse(*legs: DataFrame, k: int = V.RRF_K) -> DataFrame:
    """(qid, id, score, first): reciprocal rank fusion; first orders ties as the legs met them."""
    parts = [leg.select("qid", "id", "rank", F.lit(i).alias("leg"), F.col("score").alias("leg_score")) for i, leg in enumerate(legs)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("qid", "id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 6).alias("score"), F.min(F.col("leg") * 100_000 + F.col("rank")).alias("first"))


def ordered(rows: DataFrame, *order: Column | str, name: str = "rank", qid: str = "qid") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(qid).orderBy(*order)))


def hybrid(dense: DataFrame | None, sparse: DataFrame | None, k: int = V.RRF_K, limit: int = V.POOL) -> DataFrame:
    """(qid, id, score, dense_score, rank): both legs fused, or one alone; dense_score is null for what the dense leg
    did not return (always, in sparse mode)."""
    legs = [leg for leg in (dense, sparse) if leg is not None]
    fused = fuse(*legs, k=k)
    cos = dense.select("qid", "id", F.col("score").alias("dense_score")) if dense is not None else None
    fused = fused.join(cos, ["qid", "id"], "left") if cos is not None else fused.withColumn("dense_score", F.lit(None).cast("double"))
    return ordered(fused, F.desc("score"), "first", "id").where(F.col("rank") <= limit).select("qid", "id", "score", "dense_score", "rank")


def merge_corpora(statute: DataFrame, documents: DataFrame) -> DataFrame:
    """Fused rows of both corpora by score; statute first on ties."""
    both = statute.withColumn("source", F.lit("statute")).unionByName(documents.withColumn("source", F.lit("document")), allowMissingColumns=True)
    return ordered(both.drop("rank"), F.desc("score"), F.col("source") == "document", "id")


def rerank_order(ranked: DataFrame, scores: DataFrame, pool: int = V.RERANK_POOL) -> DataFrame:
    """ranked in the reranker's order: the pool by its score (none counts as 0), ties and the rest as they were.
    A query with fewer than two rows keeps its order. scores: qid, id, rerank_score."""
    rows = ranked.join(scores, ["qid", "id"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
    inside = (F.col("rank") <= pool) & (F.col("_n") >= 2)
    key = F.when(inside, F.coalesce("rerank_score", F.lit(0.0)))
    rows = rows.withColumn("rerank_score", key).withColumnRenamed("rank", "fused_rank")
    return ordered(rows, F.col("fused_rank") > pool, F.desc_nulls_last("rerank_score"), "fused_rank").drop("_n")


def pin(ranked: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact hits first (score 1, no cosine, by chunk id), then what is ranked without them."""
    pinned = exact.select("qid", "id", F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("dense_score"), F.lit(True).alias("exact"))
    rest = ranked.join(exact.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("exact", F.lit(False))
    both = pinned.withColumn("_old", F.lit(0)).unionByName(rest.withColumnRenamed("rank", "_old"), allowMissingColumns=True)
    return ordered(both, F.desc("exact"), "_old", "id").drop("_old")


def diversify(ranked: DataFrame, group: str, k: int = V.TOP_K, per_group: int = V.PER_SECTION) -> DataFrame:
    """The first k of each query with at most per_group of a group; what is over stands behind all others. Rows without
    a group are never held back."""
    held = Window.partitionBy("qid", group).orderBy("rank")
    over = F.col(group).isNotNull() & (F.row_number().over(held) > per_group)
    rows = ranked.withColumn("_over", over).withColumnRenamed("rank", "_old")
    return ordered(rows, "_over", "_old").where(F.col("rank") <= k).drop("_over", "_old")


def refusal(results: DataFrame, threshold: float = V.THRESHOLD, document_threshold: float = V.DOCUMENT_THRESHOLD) -> DataFrame:
    """(qid, statute_best, document_best, top_score, refused): a query is refused if neither corpus comes near enough;
    a row without a cosine counts as 0, a corpus without rows as -1."""
    best = lambda source: F.coalesce(F.max(F.when(F.col("source") == source, F.coalesce("dense_score", F.lit(0.0)))), F.lit(-1.0))
    rows = results.groupBy("qid").agg(best("statute").alias("statute_best"), best("document").alias("document_best"), F.greatest(F.lit(0.0), F.max(F.coalesce("dense_score", F.lit(0.0)))).alias("top_score"))
    return rows.withColumn("refused", (F.col("statute_best") < threshold) & (F.col("document_best") < document_threshold))


def statute_filter(act: str | None = None, chapter: str | None = None, section: str | int | None = None) -> Column:
    """Conjunction of the filters given; without any, everything passes. It belongs before the top-k."""
    out = F.lit(True)
    for name, value in (("act_short", act), ("chapter", chapter), ("section_number", None if section is None else str(section))):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def document_filter(session_id: str, document_ids: list[str] | None = None) -> Column:
    own = F.col("session_id") == session_id
    return own & F.col("document_id").isin(document_ids) if document_ids else own


def citation_marker(source: Column, act: Column, section: Column, subsection: Column, document: Column, page: Column) -> Column:
    """How a result is cited; parentheses inside a subsection are dropped."""
    sub = F.nullif(F.regexp_replace(subsection, "[()]", ""), F.lit(""))
    statute = F.concat(F.lit("["), act, F.lit(" s."), section, F.coalesce(F.concat(F.lit("("), sub, F.lit(")")), F.lit("")), F.lit("]"))
    return F.when(source == "document", F.concat(F.lit("[doc: "), document, F.lit(" p."), page, F.lit("]"))).otherwise(statute)


def prompt_context(results: DataFrame) -> DataFrame:
    """(qid, context): numbered passages under their headings, in rank order. results: qid, rank, heading, text."""
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("heading"), F.lit("\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("rank", passage.alias("p"))))
    return results.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("context"))
