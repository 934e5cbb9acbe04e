"""Queries on what is embedded and on what models say, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import sinks
from quarry.plans import parsing
from quarry.sources import archives, files
from quarry.sources.tables import shared_folder, table

PREFIX = "Represent this sentence for searching relevant passages: "
#: Words that every fourth document gets at its end, as its texts are prose without provisos.
TAIL = "CASE doc_id % 4 WHEN 1 THEN ' Provided that' WHEN 2 THEN ' Illustrations' WHEN 3 THEN ' Unprovided, Explanation.' ELSE '' END"


def embed_texts(spark, d):
    """What is embedded of each document, and what its text holds: the language as the chapter, if there is one, and the
    source as the heading."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.expr(f"concat(text, {TAIL})").alias("text"))
    whole = X.embed_text(F.when(F.col("lang") != "en", F.col("lang")), F.col("source"), F.col("text"))
    return docs.select("doc_id", F.sha2(files.with_prefix(whole, False, PREFIX).cast("binary"), 256).alias("embed_sha256"), X.structural_flags(F.col("text")).alias("f")).select("doc_id", "embed_sha256", "f.*")


def archive_round_trip(spark, d):
    """Documents as the files of an archive, read back from its parts."""
    archives.register(spark)
    folder = shared_folder(spark, "archives")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    docs.write.format("quarry_archive").mode("append").save(folder)
    back = spark.read.format("quarry_archive").load(folder)
    return back.select("name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_round_trip(spark, d):
    """Forms written as a manifest for each act, and read back."""
    folder = shared_folder(spark, "manifests")
    forms = parsing._forms(spark, d).select("manifest", "form_number", "title", F.col("see").alias("see_section"), "start_page", (F.col("n_ocr") > 0).alias("needs_review"))
    sinks.save_manifests(forms, "manifest", folder)
    return files.manifests(spark, folder).select("act", F.col("form_count").cast("long").alias("form_count"), F.col("form_number").cast("long").alias("form_number"), "title", "see_section", F.col("start_page").cast("long").alias("start_page"), "needs_review")


def golden_split(spark, d):
    """Questions of benchmark as a golden set in lines of JSON, read back: those that nothing answers are told apart. Lines
    without a question are left out."""
    folder = shared_folder(spark, "golden")
    kind = F.expr("CASE item_id % 4 WHEN 0 THEN 'must_refuse' WHEN 1 THEN 'lookup' WHEN 2 THEN 'concept' END")
    rows = table(spark, d, "benchmark").select(F.expr("CASE WHEN item_id % 9 <> 5 THEN text END").alias("q"), F.expr("transform(sequence(0, CAST(item_id % 3 AS INT)), i -> CAST(item_id + i AS STRING))").alias("expected_sections"), kind.alias("type"))
    rows.write.json(folder)
    return files.golden(spark, folder).select(F.sha2(F.col("q").cast("binary"), 256).alias("q_sha256"), F.array_join("expected_sections", ",").alias("expected"), "must_refuse")


def query_prefixes(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2(files.with_prefix(F.col("text"), True, PREFIX).cast("binary"), 256).alias("query_sha256"))


def first_lines(spark, d):
    """Turns as a model's answer in quotes, with more lines after it."""
    said = F.expr("concat(CASE WHEN turn % 2 = 0 THEN ' \n\"' ELSE '' END, text, CASE WHEN turn % 3 = 0 THEN concat('\"', chr(39)) ELSE '' END, ' \n more')")
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.first_line(said).cast("binary"), 256).alias("line_sha256"))


def embedded_json(spark, d):
    """Properties of events inside a sentence, some of them broken or missing."""
    said = F.expr("CASE event_id % 5 WHEN 0 THEN concat('{', props) WHEN 1 THEN 'none' ELSE concat('It is\n', props, ' I think') END")
    return table(spark, d, "events").select("event_id", X.embedded_json(said, "k int")["k"].alias("k"))


# ---- the same in SQL ------------------------------------------------------------------------------------------
SQL = {
    "manifest_round_trip": f"WITH {parsing._FORMS} SELECT manifest::VARCHAR AS act, count(*) OVER (PARTITION BY manifest) AS form_count, form_number, title, see AS see_section, start_page, n_ocr > 0 AS needs_review FROM forms",
    "golden_split": "SELECT sha256(text) AS q_sha256, array_to_string(list_transform(range(item_id % 3 + 1), lambda i: (item_id + i)::VARCHAR), ',') AS expected, CASE item_id % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS must_refuse FROM benchmark WHERE item_id % 9 <> 5",
    "archive_round_trip": "SELECT 'doc-' || doc_id || '.txt' AS name, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "embed_texts": f"SELECT doc_id, sha256(CASE WHEN lang <> 'en' AND lang <> '' THEN lang || chr(10) ELSE '' END || CASE WHEN source <> '' THEN source || chr(10) ELSE '' END || t) AS embed_sha256, regexp_matches(t, '\\bIllustrations?\\b') AS has_illustration, regexp_matches(t, '\\bProvided\\b') AS has_proviso, regexp_matches(t, '\\bException\\b') AS has_exception, regexp_matches(t, '\\bExplanation\\b') AS has_explanation FROM (SELECT *, text || {TAIL} AS t FROM documents)",
    "query_prefixes": f"SELECT item_id, sha256('{PREFIX}' || text) AS query_sha256 FROM benchmark",
    "first_lines": "SELECT conv_id, turn, sha256(regexp_replace(string_split(trim(CASE WHEN turn % 2 = 0 THEN '\"' ELSE '' END || text || CASE WHEN turn % 3 = 0 THEN '\"''' ELSE '' END || chr(10)), chr(10))[1], '^[\"'']+|[\"'']+$', '', 'g')) AS line_sha256 FROM conversations",
    "embedded_json": "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN regexp_extract(props, '[0-9]+')::INTEGER END AS k FROM events",
}
QUERIES = {name: globals()[name] for name in SQL}
