"""Queries over the corpus: statistics, BM25, dense search, fusion and the full retrieval, with their SQL.

documents stand for chunks (their source for the section), embeddings for the vectors of the documents with the same
number, benchmark items for questions; an item's question vector is the vector with its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import values as V
from quarry.operators import batch as B
from quarry.operators import index as I
from quarry.operators import lists as L
from quarry.operators import retrieval as R
from quarry.operators.stored import StoredIndex
from quarry.sources.tables import fingerprint, shared_folder, table, written


def _tokens(spark, d) -> DataFrame:
    return I.tokens(table(spark, d, "documents"), "doc_id", "text")


def _kept(spark, d, kind: str, names: tuple[str, ...], build):
    """What `build` makes from tables of the folder: made when a session first asks for it, and found again for as long as
    the tables' files are the same."""
    kept = spark.__dict__.setdefault("_quarry_kept", {})
    key = (kind, fingerprint(spark, d, *names))
    if key not in kept:
        kept[key] = build()
    return kept[key]


def stored_index(spark, d) -> StoredIndex:
    """The index of the documents, in a folder that all executors share."""

    def build():
        index = StoredIndex(spark, shared_folder(spark, "index"))
        index.add(_tokens(spark, d), "documents")
        return index

    return _kept(spark, d, "postings", ("documents",), build)


def vector_lists(spark, d) -> L.VectorLists:
    """The embeddings in lists, with the numbers and sources of the documents that have theirs, for filters."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return _kept(spark, d, "vectors", ("documents", "embeddings"), lambda: L.VectorLists(_vectors(spark, d).join(docs, F.col("id") == F.col("doc_id"), "left")))


def question_terms(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, term): the different terms of each question."""
    return questions.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(X.tokenize(F.col(text)))).alias("term"))


def _terms_asked(spark, d) -> DataFrame:
    return question_terms(table(spark, d, "benchmark"), "item_id", "text")


def tokenize_counts(spark, d):
    return _tokens(spark, d).select(F.col("id").alias("doc_id"), F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), F.sha2(F.array_join("terms", " ").cast("binary"), 256).alias("terms_sha256"))


def term_id_fnv1a(spark, d):
    terms = table(spark, d, "benchmark").select(F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("term")).distinct()
    return terms.select("term", X.term_id(F.col("term")).cast("long").alias("slot"))


def term_id_fnv1a_documents(spark, d):
    """Slots of all terms of the corpus."""
    terms = _tokens(spark, d).select(F.explode(F.array_distinct("terms")).alias("term")).distinct()
    return terms.select("term", X.term_id(F.col("term")).cast("long").alias("slot"))


def stopword_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.raw_tokens(F.col("text"))).cast("long").alias("n_raw"), F.size(X.tokenize(F.col("text"))).cast("long").alias("n_kept"))


def corpus_stats(spark, d):
    return I.corpus_stats(_tokens(spark, d)).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


def doc_frequency_topk(spark, d):
    return I.document_frequency(_tokens(spark, d)).orderBy(F.desc("df"), "term").limit(100)


def term_frequency(spark, d):
    return I.term_frequency(I.tokens(table(spark, d, "benchmark"), "item_id", "text")).select(F.col("id").alias("item_id"), "term", "tf", F.col("length").cast("long").alias("length"))


def term_frequency_documents(spark, d):
    return I.term_frequency(_tokens(spark, d)).select(F.col("id").alias("doc_id"), "term", "tf", F.col("length").cast("long").alias("length"))


def bm25_idf(spark, d):
    t = _tokens(spark, d)
    stats = I.corpus_stats(t)
    return I.document_frequency(t).crossJoin(F.broadcast(stats)).select("term", "df", F.round(I.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def bm25_doc_weights(spark, d):
    t = _tokens(spark, d)
    postings = I.postings(t, I.corpus_stats(t), _terms_asked(spark, d).select("term").distinct())
    return postings.select(F.col("id").alias("doc_id"), "term", "tf", F.round("weight", 6).alias("weight"))


def bm25_doc_weights_whole(spark, d):
    """The whole index: weights of all terms, whether a query has them or not."""
    t = _tokens(spark, d)
    return I.postings(t, I.corpus_stats(t)).select(F.col("id").alias("doc_id"), "term", "tf", F.round("weight", 6).alias("weight"))


def bm25_topk_per_query(spark, d):
    return _sparse(spark, d).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_topk_pruned(spark, d):
    """The same rows, from the blocks of postings that can matter."""
    rows = stored_index(spark, d).topk(_terms_asked(spark, d), V.POOL)
    return rows.select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def stats_merge(spark, d):
    t = _tokens(spark, d)
    parts = [(I.corpus_stats(p), I.document_frequency(p)) for p in (t.where("id % 2 = 0"), t.where("id % 2 = 1"))]
    stats, df = I.merge_stats(*parts)
    return df.crossJoin(F.broadcast(stats)).select("term", "df", "n_docs", F.round("avg_length", 6).alias("avg_length"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _item_vectors(spark, d) -> DataFrame:
    return _vectors(spark, d).join(table(spark, d, "benchmark").select("item_id"), F.col("id") == F.col("item_id")).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def _dense(spark, d, keep="true", k=V.POOL):
    """Items' vectors against those of documents."""
    return vector_lists(spark, d).search(_item_vectors(spark, d), k, F.expr(f"doc_id IS NOT NULL AND ({keep})"))


def _out(rows, *more):
    return rows.select("qid", F.col("id").alias("doc_id"), "score", *more, F.col("rank").cast("long").alias("rank"))


def dense_topk_cosine(spark, d):
    q = _vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return vector_lists(spark, d).search(q, 10).select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def dense_topk_lists(spark, d):
    """All items against all vectors, approximately: from the nearest lists."""
    rows = vector_lists(spark, d).search(_item_vectors(spark, d), V.POOL, exact=False)
    return rows.select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def dense_topk_filtered(spark, d):
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    rows = v.join(q, F.col("label") == F.col("q_label")).select("qid", "id", F.round(R.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    return R.top(rows, 10).select("qid", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def _scores(spark, d):
    return stored_index(spark, d).scores(_terms_asked(spark, d))


def best(spark, d, questions: DataFrame, k: int = V.POOL, keep: str | None = None) -> DataFrame:
    """(qid, id, score, rank) of questions (qid, term): the best documents of those that keep lets through."""
    among = None if keep is None else I.tokens(table(spark, d, "documents").where(keep), "doc_id", "text")
    return B.best(_tokens(spark, d), questions, k, among)


def _sparse(spark, d, keep=None):
    return best(spark, d, _terms_asked(spark, d), V.POOL, keep)


def rrf_fusion(spark, d):
    return R.fuse(_dense(spark, d), _sparse(spark, d)).select("qid", F.col("id").alias("doc_id"), "score", F.col("first").cast("long").alias("first"))


def _newest(spark, d):
    """A third list: each query's documents of its own source number, by length."""
    docs = table(spark, d, "documents")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.expr("item_id % 20")).alias("source"))
    return R.top(docs.join(q, "source").select("qid", F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")), V.POOL)


def rrf_three_lists(spark, d):
    return R.fuse(_dense(spark, d), _sparse(spark, d), _newest(spark, d), k=60).select("qid", F.col("id").alias("doc_id"), "score", F.col("first").cast("long").alias("first"))


def hybrid_search(spark, d):
    return _out(R.hybrid(_dense(spark, d), _sparse(spark, d)), "dense_score")


FILTER = "source IN ('src1', 'src2', 'src3', 'src4', 'src5')"


def hybrid_search_filtered(spark, d):
    return _out(R.hybrid(_dense(spark, d, FILTER), _sparse(spark, d, FILTER)), "dense_score")


def sparse_mode(spark, d):
    return _out(R.hybrid(None, _sparse(spark, d)), "dense_score")


def dense_mode(spark, d):
    return _out(R.hybrid(_dense(spark, d), None), "dense_score")


def _exact(spark, d):
    """Documents that a question names: here those of its own source among the first ten of it."""
    docs = table(spark, d, "documents").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 3")
    q = table(spark, d, "benchmark").where("item_id % 4 = 0").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.expr("item_id % 20")).alias("source"))
    return docs.join(q, "source").select("qid", F.col("doc_id").alias("id"))


def exact_lookup_pin(spark, d):
    return _out(R.pin(R.hybrid(_dense(spark, d), _sparse(spark, d)), _exact(spark, d)), "dense_score", "exact")


def _two(spark, d):
    """Even documents as the statute, odd ones as uploads. Scores are computed once for both, and so is their merge,
    whatever reads it."""
    scores = written(_scores(spark, d), "scores")
    legs = lambda side: R.hybrid(_dense(spark, d, f"doc_id % 2 = {side}"), R.top(scores.where(f"id % 2 = {side}"), V.POOL))
    return written(R.merge_corpora(legs(0), legs(1)), "merged")


def two_corpora_merge(spark, d):
    return _out(_two(spark, d), "dense_score", "source")


def _sources(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section"))


def diversify_cap2(spark, d):
    ranked = R.hybrid(_dense(spark, d), _sparse(spark, d)).join(_sources(spark, d), "id")
    return _out(R.diversify(ranked, "section"), "section")


def rerank_scores(spark, d, ranked, pool: int = V.RERANK_POOL, chars: int = V.RERANK_CHARS):
    """Scores of the local reranker: share of the question's terms that the document's first characters have."""
    q = I.tokens(table(spark, d, "benchmark"), "item_id", "text").select(F.col("id").alias("qid"), F.array_distinct("terms").alias("q"))
    pool = ranked.where(F.col("rank") <= pool).select("qid", "id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(pool.select("id").distinct(), "id", "left_semi")
    docs = docs.select("id", F.array_distinct(X.tokenize(F.substring("text", 1, chars))).alias("t"))
    rows = pool.join(docs, "id").join(q, "qid")
    return rows.select("qid", "id", F.round(F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1)), 6).alias("rerank_score"))


def rerank_pool_order(spark, d):
    ranked = written(R.hybrid(_dense(spark, d), _sparse(spark, d)), "ranked")
    return _out(R.rerank_order(ranked, rerank_scores(spark, d, ranked)), "rerank_score")


def retrieve_topk(spark, d):
    """The flagship: both legs, fusion, two corpora, pins for questions that name a section and rerank for the others,
    diversity, and the winners' payload."""
    merged = _two(spark, d)
    exact = _exact(spark, d)
    named = exact.select("qid").distinct()
    pinned = R.pin(merged.join(named, "qid", "left_semi"), exact)
    free = merged.join(named, "qid", "left_anti")
    free = R.rerank_order(free, rerank_scores(spark, d, free)).drop("rerank_score", "fused_rank").withColumn("exact", F.lit(False))
    both = pinned.unionByName(free, allowMissingColumns=True).join(_sources(spark, d), "id")
    return _out(R.diversify(both, "section"), "dense_score", "exact", "section")


def refusal_gate(spark, d):
    return R.refusal(_two(spark, d).where(F.col("rank") <= V.TOP_K)).select("qid", "statute_best", "document_best", "refused")


def top_score(spark, d):
    return R.refusal(_two(spark, d).where(F.col("rank") <= V.TOP_K)).select("qid", "top_score")


def session_isolation(spark, d):
    """Documents of a session reach only the questions of the same session."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.expr("item_id % 20")).alias("session"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session"))
    return _sparse(spark, d).join(docs, "id").join(q, ["qid", "session"], "left_semi").select("qid", F.col("id").alias("doc_id"), "score")


def prompt_context(spark, d):
    """Contexts that hold the whole text of each passage, as the prompt does."""
    ranked = R.top(_sparse(spark, d), V.TOP_K).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text"), "id")
    marker = R.citation_marker(F.lit("document"), F.lit(None), F.lit(None), F.lit(None), F.concat("source", F.lit(".pdf")), F.lit("1"))
    ranked = ranked.select("qid", "rank", F.concat(F.lit('uploaded document "'), "source", F.lit('.pdf", page 1 - cite as '), marker).alias("heading"), "text")
    return R.prompt_context(ranked).select("qid", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))


# ---- the same in SQL ------------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)


def _terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: (length(t) >= 2 OR regexp_matches(t, '[0-9]')) AND NOT list_contains([{_STOP}], t))"


def bm25_sql(questions: str, qid: str, text: str) -> str:
    return f"""tok AS (SELECT doc_id, {_terms('text')} AS terms FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_length FROM tok),
freq AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM tok) GROUP BY term),
qtok AS (SELECT DISTINCT {qid} AS qid, unnest({_terms(text)}) AS term FROM {questions}),
qterm AS (SELECT qid, q.term, ln(1 + (n_docs - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf FROM qtok q LEFT JOIN freq USING (term), stats),
tf AS (SELECT doc_id, len(terms) AS length, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM tok) GROUP BY ALL),
post AS (SELECT doc_id, term, tf, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)) AS weight FROM tf, stats)"""


BM25 = bm25_sql("benchmark", "item_id", "text")


def _sparse_sql(name: str = "sparse", where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(sum(weight * idf), 6) AS score FROM post JOIN qterm USING (term) JOIN documents USING (doc_id) WHERE {where} GROUP BY ALL)) WHERE rank <= 40)"


def _dense_sql(name: str = "dense", where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id AS qid, doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v JOIN documents ON doc_id = v.vec_id WHERE {where})) WHERE rank <= 40)"


def _fuse_sql(name: str, *legs: str, k: int = 20) -> str:
    union = " UNION ALL ".join(f"SELECT qid, doc_id, rank, {i} AS leg FROM {leg}" for i, leg in enumerate(legs))
    return f"{name}_f AS (SELECT qid, doc_id, round(sum(1 / ({k}::DOUBLE + rank)), 6) AS score, min(leg * 100000 + rank) AS first FROM ({union}) GROUP BY ALL)"


def _hybrid_sql(name: str = "hybrid", dense: str | None = "dense", sparse: str | None = "sparse") -> str:
    legs = [x for x in (dense, sparse) if x]
    cos = f"LEFT JOIN (SELECT qid, doc_id, score AS dense_score FROM {dense}) USING (qid, doc_id)" if dense else ""
    own = "dense_score" if dense else "NULL::DOUBLE AS dense_score"
    return f"{_fuse_sql(name, *legs)}, {name} AS (SELECT * FROM (SELECT qid, doc_id, score, {own}, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, doc_id) AS rank FROM {name}_f {cos}) WHERE rank <= 40)"


LEGS = f"WITH {BM25}, {_sparse_sql()}, {_dense_sql()}"
HYBRID = f"{LEGS}, {_hybrid_sql()}"
EXACT = "exact AS (SELECT item_id AS qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) JOIN benchmark ON source = 'src' || (item_id % 20) WHERE rn <= 3 AND item_id % 4 = 0)"
TWO = f"WITH {BM25}, {_sparse_sql('s0', 'doc_id % 2 = 0')}, {_dense_sql('d0', 'doc_id % 2 = 0')}, {_sparse_sql('s1', 'doc_id % 2 = 1')}, {_dense_sql('d1', 'doc_id % 2 = 1')}, {_hybrid_sql('h0', 'd0', 's0')}, {_hybrid_sql('h1', 'd1', 's1')}, merged AS (SELECT qid, doc_id, score, dense_score, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source = 'document', doc_id) AS rank FROM (SELECT *, 'statute' AS source FROM h0 UNION ALL SELECT *, 'document' AS source FROM h1))"


def _pin_sql(ranked: str) -> str:
    return f"pinned AS (SELECT qid, doc_id, score, dense_score, exact, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, old, doc_id) AS rank FROM (SELECT qid, doc_id, 1.0::DOUBLE AS score, NULL::DOUBLE AS dense_score, true AS exact, 0 AS old FROM exact UNION ALL SELECT qid, doc_id, score, dense_score, false, rank FROM {ranked} ANTI JOIN exact USING (qid, doc_id)))"


def _rerank_sql(ranked: str) -> str:
    return f"rr AS (SELECT qid, doc_id, round(len(list_intersect(list_distinct({_terms('b.text')}), list_distinct({_terms('substr(d.text, 1, 1800)')}))) / greatest(len(list_distinct({_terms('b.text')})), 1), 6) AS rerank_score FROM {ranked} JOIN benchmark b ON qid = item_id JOIN documents d USING (doc_id) WHERE rank <= 12), reranked AS (SELECT qid, doc_id, score, dense_score, rerank_score, row_number() OVER (PARTITION BY qid ORDER BY old > 12, rerank_score DESC NULLS LAST, old) AS rank FROM (SELECT qid, doc_id, score, dense_score, rank AS old, CASE WHEN rank <= 12 AND count(*) OVER (PARTITION BY qid) >= 2 THEN coalesce(rerank_score, 0) END AS rerank_score FROM {ranked} LEFT JOIN rr USING (qid, doc_id)))"


def _diverse_sql(ranked: str, columns: str) -> str:
    return f"SELECT * FROM (SELECT qid, doc_id, score, {columns}, row_number() OVER (PARTITION BY qid ORDER BY over_, old) AS rank FROM (SELECT * EXCLUDE (rank), rank AS old, row_number() OVER (PARTITION BY qid, section ORDER BY rank) > 2 AS over_ FROM (SELECT r.*, d.source AS section FROM {ranked} r JOIN documents d USING (doc_id)))) WHERE rank <= 8"


_VEC = "SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON {on} WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"
_REFUSE = f"{TWO} SELECT qid, coalesce(max(coalesce(dense_score, 0)) FILTER (source = 'statute'), -1) AS statute_best, coalesce(max(coalesce(dense_score, 0)) FILTER (source = 'document'), -1) AS document_best, greatest(0, max(coalesce(dense_score, 0))) AS top_score FROM merged WHERE rank <= 8 GROUP BY qid"

SQL = {
    "tokenize_counts": f"WITH {BM25} SELECT doc_id, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct, sha256(array_to_string(terms, ' ')) AS terms_sha256 FROM tok",
    "term_id_fnv1a": f"SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) >> 1 AS slot FROM (SELECT DISTINCT unnest({_terms('text')}) AS term FROM benchmark)",
    "term_id_fnv1a_documents": f"WITH {BM25} SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) >> 1 AS slot FROM freq",
    "stopword_filter": f"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_raw, len({_terms('text')}) AS n_kept FROM documents",
    "corpus_stats": f"WITH {BM25} SELECT n_docs, round(avg_length, 6) AS avg_length FROM stats",
    "doc_frequency_topk": f"WITH {BM25} SELECT term, df FROM freq ORDER BY df DESC, term LIMIT 100",
    "term_frequency": f"SELECT item_id, term, count(*) AS tf, length FROM (SELECT item_id, len({_terms('text')}) AS length, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL",
    "term_frequency_documents": f"WITH {BM25} SELECT doc_id, term, tf, length FROM tf",
    "bm25_idf": f"WITH {BM25} SELECT term, df, round(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM freq, stats",
    "bm25_doc_weights": f"WITH {BM25} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM post SEMI JOIN qterm USING (term)",
    "bm25_doc_weights_whole": f"WITH {BM25} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM post",
    "bm25_topk_per_query": f"WITH {BM25}, {_sparse_sql()} SELECT qid, doc_id, score, rank FROM sparse",
    "bm25_topk_pruned": f"WITH {BM25}, {_sparse_sql()} SELECT qid, doc_id, score, rank FROM sparse",
    "stats_merge": f"WITH {BM25} SELECT term, df, n_docs, round(avg_length, 6) AS avg_length FROM freq, stats",
    "dense_topk_cosine": _VEC.format(on="true"),
    "dense_topk_filtered": _VEC.format(on="q.label = v.label"),
    "rrf_fusion": f"{LEGS}, {_fuse_sql('x', 'dense', 'sparse')} SELECT * FROM x_f",
    "rrf_three_lists": f"{LEGS}, third AS (SELECT * FROM (SELECT item_id AS qid, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN benchmark ON source = 'src' || (item_id % 20)) WHERE rank <= 40), {_fuse_sql('x', 'dense', 'sparse', 'third', k=60)} SELECT * FROM x_f",
    "hybrid_search": f"{HYBRID} SELECT * FROM hybrid",
    "hybrid_search_filtered": f"WITH {BM25}, {_sparse_sql(where=FILTER)}, {_dense_sql(where=FILTER)}, {_hybrid_sql()} SELECT * FROM hybrid",
    "sparse_mode": f"{LEGS}, {_hybrid_sql(dense=None)} SELECT * FROM hybrid",
    "dense_mode": f"{LEGS}, {_hybrid_sql(sparse=None)} SELECT * FROM hybrid",
    "exact_lookup_pin": f"{HYBRID}, {EXACT}, {_pin_sql('hybrid')} SELECT * FROM pinned",
    "two_corpora_merge": f"{TWO} SELECT * FROM merged",
    "diversify_cap2": f"{HYBRID} {_diverse_sql('hybrid', 'section')}",
    "rerank_pool_order": f"{HYBRID}, {_rerank_sql('hybrid')} SELECT qid, doc_id, score, rerank_score, rank FROM reranked",
    "retrieve_topk": f"{TWO}, {EXACT}, named AS (SELECT * FROM merged SEMI JOIN exact USING (qid)), free AS (SELECT * FROM merged ANTI JOIN exact USING (qid)), {_pin_sql('named')}, {_rerank_sql('free')}, allrows AS (SELECT qid, doc_id, score, dense_score, exact, rank FROM pinned UNION ALL SELECT qid, doc_id, score, dense_score, false, rank FROM reranked) {_diverse_sql('allrows', 'dense_score, exact, section')}",
    "refusal_gate": f"SELECT qid, statute_best, document_best, statute_best < 0.58 AND document_best < 0.38 AS refused FROM ({_REFUSE})",
    "top_score": f"SELECT qid, top_score FROM ({_REFUSE})",
    "session_isolation": f"WITH {BM25}, {_sparse_sql()} SELECT qid, doc_id, score FROM sparse JOIN documents USING (doc_id) WHERE source = 'src' || (qid % 20)",
    "prompt_context": f"WITH {BM25}, {_sparse_sql()} SELECT qid, sha256(string_agg('[' || rank || '] uploaded document \"' || source || '.pdf\", page 1 - cite as [doc: ' || source || '.pdf p.1]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_sha256 FROM sparse JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY qid",
}
#: The name that the query of whole passages had while prompt_context cut them.
SQL["prompt_context_whole"], prompt_context_whole = SQL["prompt_context"], prompt_context
#: Approximate, and so without SQL: its recall is measured against the exact search.
QUERIES = {name: globals()[name] for name in (*SQL, "dense_topk_lists")}
