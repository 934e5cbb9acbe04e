"""Queries on what services answer to documents and turns. The services here are small, local and deterministic."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans import language
from quarry.sources import services as S
from quarry.sources.tables import table

LETTERS = "etaoinsh"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """How often a text has each of eight letters."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


def by_length(texts: list[str]) -> list[str]:
    """A verdict by the text's length, in a sentence; some are cut short or of an unknown kind, and some lengths fail."""
    if any(len(t) % 7 == 6 for t in texts):
        raise ConnectionError("no answer")
    said = {0: "ok", 1: "out_of_scope", 2: "unsafe", 3: "injection", 4: "other"}
    return ['I think {"category": "ok", ' if len(t) % 7 == 5 else f'It is {{"category": "{said[len(t) % 7]}", "reason": "length {len(t)}"}}.' for t in texts]


def served_vectors(spark, d):
    """Each document's vector, from a service that gets each different text once."""
    rows = S.embed(table(spark, d, "documents").select("doc_id", "text"), "text", letter_counts)
    return rows.select("doc_id", *(F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in range(len(LETTERS))))


def checked_inputs(spark, d):
    """Questions and user turns as messages; those of odd length come with documents."""
    rows = language._questions(spark, d).select("qid", F.col("q").alias("message"), (F.length("q") % 2 == 1).alias("uploaded"))
    return S.checked(rows, by_length, has_documents="uploaded", wait=0.0).select("qid", "allow", "category", "reason", F.sha2(F.col("rewritten").cast("binary"), 256).alias("rewritten_sha256"))


# ---- the same in SQL ------------------------------------------------------------------------------------------
_count = lambda c: f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE"
_NORM = " + ".join(f"pow({_count(c)}, 2)" for c in LETTERS)
SQL = {
    "served_vectors": f"SELECT doc_id, {', '.join(f'round(CASE WHEN norm > 0 THEN {_count(c)} / norm ELSE 0 END, 6) AS v{i}' for i, c in enumerate(LETTERS))} FROM (SELECT *, sqrt({_NORM}) AS norm FROM documents)",
    "checked_inputs": f"""WITH {language._QS}, m AS (SELECT qid, q, {language._trim("q")} AS t, rule FROM qs JOIN ({language.SQL["injection_scan"]}) USING (qid)),
v AS (SELECT *, length(substr(t, 1, {S.SEEN})) AS n, CASE WHEN t = '' THEN 'out_of_scope' WHEN rule IS NOT NULL THEN 'injection' ELSE CASE length(substr(t, 1, {S.SEEN})) % 7 WHEN 1 THEN CASE WHEN length(q) % 2 = 1 THEN 'ok' ELSE 'out_of_scope' END WHEN 2 THEN 'unsafe' WHEN 3 THEN 'injection' ELSE 'ok' END END AS category FROM m)
SELECT qid, category = 'ok' AS allow, category, CASE WHEN category = 'ok' THEN '' WHEN t = '' THEN 'empty message' WHEN rule IS NOT NULL THEN rule ELSE 'length ' || n END AS reason, CASE WHEN category = 'ok' THEN sha256(t) END AS rewritten_sha256 FROM v""",
}
QUERIES = {name: globals()[name] for name in SQL}
