"""Services that answer texts: embeddings, classifiers, rewriters.

Each different text is asked for once, in batches of the service's size, whatever batches the rows come in. A call that
fails is made again; a batch that keeps failing is asked text by text, so that one text does not cost the others their
answers; a text that keeps failing gets the defined answer. Answers are written before anything uses them, so a plan that is
run twice asks once. A lost task asks its texts again: services must not mind.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.sources.tables import written

#: Texts of a call; calls before a batch is given up; seconds before the second call, which double.
BATCH, TRIES, WAIT = 32, 3, 0.2
#: What a classifier may say, what a question may be about, and how much of a message and its history it sees.
CATEGORIES, INTENTS = ("ok", "injection", "out_of_scope", "unsafe"), ("concept", "document", "out_of_scope")
SEEN, TURNS = 2000, 2

Service = Callable[[list[str]], list]


def call(service: Service, texts: list[str], tries: int = TRIES, wait: float = WAIT) -> list[tuple[bool, object]]:
    """(answered, answer) of each text."""
    for n in range(tries):
        try:
            out = list(service(texts))
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} answers to {len(texts)} texts")
            return [(True, a) for a in out]
        except Exception:  # whatever a service raises, and answers that don't fit
            if n + 1 < tries:
                time.sleep(wait * 2**n)
    if len(texts) <= 1:
        return [(False, None) for _ in texts]
    return [one for t in texts for one in call(service, [t], 1, wait)]


def answers(texts: DataFrame, text: str, service: Service, kind: str, batch: int = BATCH, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """(key, answered, answer) of the different texts of a column, as a written table; key: their SHA-256. Null texts are not
    asked for. kind: the answers' type in DDL; a failed text has answered = false and a null answer."""
    asked = texts.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("key")).agg(F.first(text).alias("text"))

    def run(batches):
        import pyarrow as pa

        held: list[tuple[str, str]] = []
        schema = None

        def done(some):
            got = call(service, [t for _, t in some], tries, wait)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([ok for ok, _ in got], pa.bool_()), pa.array([a for _, a in got], schema)], names=["key", "answered", "answer"])

        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_json_string

        schema = to_arrow_type(_parse_datatype_json_string(type_json))
        for rows in batches:
            held += zip(rows.column("key").to_pylist(), rows.column("text").to_pylist(), strict=True)
            while len(held) >= batch:
                yield done(held[:batch])
                held = held[batch:]
        if held:
            yield done(held)

    out = f"key string, answered boolean, answer {kind}"
    type_json = texts.sparkSession.createDataFrame([], out).schema["answer"].dataType.json()
    return written(asked.mapInArrow(run, out), "answers")


def served(rows: DataFrame, text: str, service: Service, kind: str, out: str = "answer", **how) -> DataFrame:
    """rows with out, the service's answer to their text (null without text or answer), and answered. Answers are joined by
    the texts' digests; a text that many rows share is a skewed key of the rows, which adaptive execution splits."""
    found = answers(rows.select(text), text, service, kind, **how).select(F.col("key").alias("key_"), F.col("answer").alias(out), "answered")
    joined = rows.withColumn("key_", F.sha2(F.col(text).cast("binary"), 256)).join(found, "key_", "left").drop("key_")
    return joined.withColumn("answered", F.coalesce("answered", F.lit(False)))


def unit(vector: Column) -> Column:
    """A vector of length one; a vector of zeros stays."""
    def scaled(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return X.named(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))

    return X.named(vector, scaled)


def embed(rows: DataFrame, text: str, service: Service, is_query: bool = False, prefix: str = "", out: str = "vector", **how) -> DataFrame:
    """rows with their text's vector of length one, null where the service gives none; questions are asked with the prefix."""
    shown = F.concat(F.lit(f"{prefix} "), F.col(text)) if is_query and prefix else F.col(text)
    got = served(rows.withColumn("shown_", shown), "shown_", service, "array<double>", out, **how).drop("shown_", "answered")
    return got.withColumn(out, unit(F.col(out)))


def rewritten(rows: DataFrame, text: str, service: Service, out: str = "standalone", **how) -> DataFrame:
    """rows with the first line that the service makes of their text, or the text where it makes none."""
    got = served(rows, text, service, "string", out, **how).drop("answered")
    return got.withColumn(out, F.coalesce(F.nullif(X.first_line(F.col(out)), F.lit("")), F.col(text)))


def triaged(rows: DataFrame, text: str, service: Service, **how) -> DataFrame:
    """rows with intent and passage (a text that might answer, for the dense search) from JSON in the service's answer: a
    concept without passage where there is none; nothing is looked up for what is out of scope."""
    got = served(rows, text, service, "string", "said_", **how).drop("answered")
    parsed = X.embedded_json(F.col("said_"), "intent string, passage string")
    intent = F.when(parsed["intent"].isin(*INTENTS), parsed["intent"]).otherwise("concept")
    passage = F.nullif(X.trim(F.coalesce(parsed["passage"], F.lit(""))), F.lit(""))
    return got.withColumn("intent", intent).withColumn("passage", F.when(F.col("intent") != "out_of_scope", passage)).drop("said_")


def checked(rows: DataFrame, classify: Service, message: str = "message", history: str | None = None, document: str | None = None, has_documents: str | None = None, **how) -> DataFrame:
    """rows with allow, category, reason and rewritten (the message as it goes on). Rules come first and cost no call: an
    empty message, an order in the uploaded text, one in the message. The others are classified, with the last turns of
    history (array of struct(role, text)); a classifier that fails or says nothing known allows. With documents a message out
    of scope is about them."""
    text = X.trim(F.coalesce(F.col(message), F.lit("")))
    in_document = X.find_document_injection(F.col(document)) if document else F.lit(None).cast("string")
    own = rows.withColumn("text_", text).withColumn("rule_", F.when(F.col("text_") == "", F.lit("empty message")).otherwise(F.coalesce(F.concat(F.lit("uploaded document contains "), in_document), X.find_injection(F.col("text_")))))
    short = F.substring("text_", 1, SEEN)
    if history:
        turns = F.coalesce(F.col(history), F.array().cast("array<struct<role:string,text:string>>"))
        recent = F.array_join(F.transform(F.slice(turns, F.greatest(F.size(turns) - TURNS + 1, F.lit(1)), TURNS), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
        short = F.when(recent != "", F.concat(recent, F.lit("\nuser: "), short)).otherwise(short)
    own = served(own.withColumn("shown_", F.when(F.col("rule_").isNull(), short)), "shown_", classify, "string", "said_", **how)
    parsed = X.embedded_json(F.col("said_"), "category string, reason string")
    known = F.coalesce(parsed["category"].isin(*CATEGORIES), F.lit(False))
    said = F.when(~F.col("answered"), F.struct(F.lit("ok").alias("category"), F.lit("classifier unavailable").alias("reason"))).when(known, F.struct(parsed["category"].alias("category"), F.coalesce(F.nullif(parsed["reason"], F.lit("")), parsed["category"]).alias("reason"))).otherwise(F.struct(F.lit("ok").alias("category"), F.lit("unparseable verdict").alias("reason")))
    own = own.withColumn("said_", said)
    about = F.coalesce(F.col(has_documents), F.lit(False)) if has_documents else F.lit(False)
    by_rule = F.when(F.col("rule_") == "empty message", "out_of_scope").when(F.col("rule_").isNotNull(), "injection")
    category = F.coalesce(by_rule, F.when(about & (F.col("said_.category") == "out_of_scope"), "ok").otherwise(F.col("said_.category")))
    own = own.withColumn("category", category).withColumn("allow", F.col("category") == "ok")
    own = own.withColumn("reason", F.when(F.col("allow"), "").otherwise(F.coalesce("rule_", "said_.reason"))).withColumn("rewritten", F.when(F.col("allow"), F.col("text_")))
    return own.drop("text_", "rule_", "shown_", "said_", "answered")
