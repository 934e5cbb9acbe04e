"""Index build: corpus statistics, BM25 weights as a postings table, keyed upsert and purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import values as V


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): one row per row of docs, also where no term is left."""
    return docs.select(F.col(id_col).alias("id"), X.tokenize(F.col(text_col)).alias("terms"))


def corpus_stats(tokenised: DataFrame) -> DataFrame:
    """One row: count of documents (those without terms too) and their average length."""
    return tokenised.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("terms")), F.lit(0.0)).alias("avg_length"))


def document_frequency(tokenised: DataFrame) -> DataFrame:
    """(term, df): each document counts once per term; counted in part before the shuffle."""
    return tokenised.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_frequency(tokenised: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length); only: the terms that are wanted, which others are dropped for before the shuffle."""
    rows = tokenised.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def idf(n_docs, df):
    """Of a term; unseen terms have df 0."""
    df = F.coalesce(df, F.lit(0))
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def weighted(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, term, tf, weight) of term frequencies; stats is one row."""
    norm = F.when(F.col("avg_length") == 0, F.lit(1.0)).otherwise(1 - V.B + V.B * F.col("length") / F.col("avg_length"))
    rows = frequencies.crossJoin(F.broadcast(stats))
    return rows.select("id", "term", "tf", (F.col("tf") * (V.K1 + 1) / (F.col("tf") + V.K1 * norm)).alias("weight"))


def postings(tokenised: DataFrame, stats: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, weight): the document side of BM25, made once at index time, or for some terms alone."""
    return weighted(term_frequency(tokenised, only), stats)


def query_terms(queries: DataFrame, qid: str, text_col: str, stats: DataFrame, df: DataFrame) -> DataFrame:
    """(qid, term, idf): the different terms of each query."""
    terms = queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(X.tokenize(F.col(text_col)))).alias("term"))
    return terms.join(df, "term", "left").crossJoin(F.broadcast(stats)).select("qid", "term", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def merge_stats(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Statistics of several corpora as of one: counts and df are summed, the average is weighted by count."""
    stats, df = parts[0]
    for s, d in parts[1:]:
        stats, df = stats.unionByName(s), df.unionByName(d)
    total = F.sum("n_docs")
    merged = stats.agg(total.alias("n_docs"), F.coalesce(F.sum(F.col("n_docs") * F.col("avg_length")) / total, F.lit(0.0)).alias("avg_length"))
    return merged, df.groupBy("term").agg(F.sum("df").alias("df"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key."""
    last = Window.partitionBy(key).orderBy(F.desc(version))
    return old.unionByName(new, allowMissingColumns=True).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def purge(points: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Points without those of purged documents."""
    return points.join(gone.select(*on).distinct(), on, "left_anti")


def points(chunks: DataFrame, key: str, text_col: str) -> DataFrame:
    """Point rows: identity, dense vector if chunks have one, terms, and the payload as it is."""
    return chunks.select(X.point_id(F.col(key)).alias("point_id"), X.tokenize(F.col(text_col)).alias("terms"), F.struct(*chunks.columns).alias("payload"))
