"""Readers of what the retrieval service reads: uploads, manifests, golden sets, event frames, model services.

Models are callables registered by name; a batch of texts goes to them through Arrow. The default ones are
deterministic and local, for tests: an answer repeats its context, a score is the share of words in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "q string, expected_sections array<string>, type string"
FORM = "form_number int, title string, see_section string, filename string, start_page int, end_page int, sha256 string, size_bytes long, confidence double, needs_review boolean"
MANIFEST = f"act string, source_uri string, source_sha256 string, page_range array<int>, form_count int, forms array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FORM.split(', '))}>>"
#: The first bytes of a PDF, and the most bytes of an upload.
MAGIC, MOST_BYTES = b"%PDF-", 25 * 1024 * 1024


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, accepted) of the files of a folder: by their first bytes and size."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select("path", "length", ((F.substring("content", 1, 5) == F.lit(MAGIC)) & (F.col("length") <= MOST_BYTES)).alias("accepted"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per form of a JSON manifest."""
    return spark.read.option("multiLine", True).schema(MANIFEST).json(path).select(F.explode("forms").alias("f")).select("f.*")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(act, form_count, and the columns of a form) of manifests that are a line each."""
    return spark.read.schema(MANIFEST).json(path).select("act", "form_count", F.explode("forms").alias("f")).select("act", "form_count", "f.*")


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions with the sections that answer them, a line each; must_refuse marks those that nothing answers."""
    rows = spark.read.schema(GOLDEN).json(path).where(F.col("q").isNotNull())
    return rows.withColumn("must_refuse", F.col("type") == "must_refuse")


def runs(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Text runs of a range of pages; what a PDF reader gives as doc_id, page, x, y, width, height, str."""
    return pages.where(F.col("page").between(first, last))


def frames(text: Column) -> Column:
    """array<struct<event, data>> of server-sent events: frames end at a blank line, several data lines are joined,
    the event is "message" unless it is named, and [DONE] ends the stream."""
    parts = F.filter(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n"), lambda p: p.rlike("(?m)^data:"))
    event = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"(?m)^event:\s*(.*)$", 1), F.lit("")), F.lit("message"))
    data = lambda p: F.array_join(F.regexp_extract_all(p, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    all_ = F.transform(parts, lambda p: F.struct(event(p).alias("event"), data(p).alias("data")))
    done = F.array_position(F.transform(all_, lambda f: f["data"]), "[DONE]")
    return F.when(done > 0, F.slice(all_, F.lit(1), done.cast("int") - 1)).otherwise(all_)


def json_lines(text: Column, schema: str) -> Column:
    """Parsed lines of newline-delimited JSON; lines that don't parse are left out."""
    parsed = F.transform(F.split(text, "\n"), lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema)))
    return F.filter(parsed, lambda p: p.isNotNull())


MODELS: dict[str, Callable[[pd.Series, pd.Series], pd.Series]] = {}


def model(name: str):
    def register(f):
        MODELS[name] = f
        return f

    return register


@model("echo")
def echo(prompt: pd.Series, context: pd.Series) -> pd.Series:
    """Answers with the first line of the context."""
    return context.fillna("").str.split("\n").str[0]


@model("overlap")
def overlap(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the query's words that the text has, as text."""
    share = [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in zip(query.fillna(""), text.fillna(""), strict=True)]
    return pd.Series(share).map("{:.6f}".format)


def ask(name: str, first: Column, second: Column) -> Column:
    """A registered model's answers, batch by batch."""
    f = MODELS[name]

    @F.pandas_udf("string")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield f(a, b)

    return call(first, second)


def with_prefix(text: Column, is_query: bool, prefix: str) -> Column:
    """Text as an embedding service wants it: only questions get the prefix."""
    return F.concat(F.lit(prefix), text) if is_query else text
