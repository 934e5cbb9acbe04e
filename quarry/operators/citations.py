"""Citations in answers: find markers, bind them to retrieved contexts, strip what was invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import values as V


def markers(answers: DataFrame) -> DataFrame:
    """(aid, pos, marker, kind, act, section, subs, doc, page) of every bracket in the answers (aid, answer); kind is
    other (not a citation), doc, section or broken."""
    one = lambda p, k: F.nullif(F.regexp_extract("marker", X.java(p), k), F.lit(""))
    found = answers.select("aid", F.posexplode(F.regexp_extract_all("answer", F.lit(V.CANDIDATE), F.lit(0))).alias("pos", "marker"))
    doc_like, legal = F.col("marker").rlike(X.java(V.DOC_HINT)), F.col("marker").rlike("[0-9]") & F.col("marker").rlike(X.java(V.ACT_HINT))
    kind = F.when(doc_like & F.col("marker").rlike(X.java(V.DOC_MARKER)), "doc").when(doc_like, "broken").when(~legal, "other").when(F.col("marker").rlike(X.java(V.STRICT)), "section").otherwise("broken")
    return found.select("aid", "pos", "marker", kind.alias("kind"), F.upper(one(V.STRICT, 1)).alias("act"), one(V.STRICT, 2).alias("section"), F.nullif(F.regexp_replace(F.regexp_extract("marker", X.java(V.STRICT), 3), r"\s+", ""), F.lit("")).alias("subs"), one(V.DOC_MARKER, 1).alias("doc"), F.expr("try_cast(nullif(regexp_extract(marker, '" + X.java(V.DOC_MARKER).replace("\\", "\\\\").replace("'", "\\'") + "', 2), '') AS INT)").alias("page"))


def holds_clause(text: Column, label: Column) -> Column:
    """Whether each bracket of the label opens a clause of the text."""
    parts = F.regexp_extract_all(label, F.lit(r"\([^)]{1,8}\)"), F.lit(0))
    opens = lambda p: F.regexp_like(text, F.concat(F.lit(r"(^|[\s.;:—\-])\Q"), p, F.lit(r"\E")))
    return (F.size(parts) > 0) & F.forall(parts, opens)


def bind(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """found with ctx (index of the context, or null) and text: what stands in the marker's place ('' if it was
    invented, itself if it is no citation). contexts: aid, idx, source, act_short, section_number, subsection, text,
    document_name, page_start, page_end.

    A section binds to a context of its number and act: to one with the same subsection, else to one whose text opens
    the clause, else to the section alone. A document binds to the page's context, by name if any has that name."""
    c = contexts.select(F.col("aid").alias("c_aid"), "idx", "source", F.upper(F.coalesce("act_short", F.lit(""))).alias("c_act"), "act_short", "section_number", F.regexp_replace(F.coalesce("subsection", F.lit("")), r"\s+", "").alias("c_sub"), F.coalesce("text", F.lit("")).alias("c_text"), "document_name", "page_start", "page_end")
    sections = found.where("kind = 'section'").join(c, (F.col("aid") == F.col("c_aid")) & (F.col("section") == F.col("section_number")) & F.col("c_act").isin("", F.col("act")))
    level = F.when(F.col("subs").isNull(), 0).when(F.col("c_sub") == F.col("subs"), 1).when(holds_clause(F.col("c_text"), F.col("subs")), 2).otherwise(3)
    label = F.when(level.isin(1, 2), F.col("subs")).otherwise("")
    clean = F.concat(F.lit("["), F.coalesce(F.nullif("act_short", F.lit("")), F.col("act")), F.lit(" s."), F.col("section"), label, F.lit("]"))
    sections = sections.select("aid", "pos", "idx", clean.alias("text"), level.alias("level"))
    named = F.lower("document_name") == F.lower(X.trim(F.col("doc")))
    docs = found.where("kind = 'doc'").join(c.where("source = 'document'"), F.col("aid") == F.col("c_aid"))
    docs = docs.withColumn("named", named).withColumn("any_named", F.max("named").over(Window.partitionBy("aid", "pos"))).where("(named OR NOT any_named) AND page BETWEEN page_start AND coalesce(page_end, page_start)")
    docs = docs.select("aid", "pos", "idx", F.concat(F.lit("[doc: "), F.col("document_name"), F.lit(" p."), F.col("page_start"), F.lit("]")).alias("text"), F.lit(0).alias("level"))
    best = sections.unionByName(docs).withColumn("rn", F.row_number().over(Window.partitionBy("aid", "pos").orderBy("level", "idx"))).where("rn = 1")
    bound = found.join(best.select("aid", "pos", F.col("idx").alias("ctx"), "text"), ["aid", "pos"], "left")
    return bound.withColumn("text", F.when(F.col("kind") == "other", F.col("marker")).otherwise(F.coalesce("text", F.lit(""))))


def tidy(text: Column) -> Column:
    for pattern, to in ((r"[ \t]{2,}", " "), (r"[ \t]+([.,;:)])", "$1"), (r"\(\s*\)", ""), (r"[ \t]+\n", "\n")):
        text = F.regexp_replace(text, pattern, to)
    return X.trim(text)


def prose_sections(text: Column) -> Column:
    """Sections that plain prose names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(X.java(V.PROSE)), F.lit(1)))


def validate(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(aid, text, n_kept, n_stripped, invented, valid): answers with invented markers taken out; invented lists the
    sections that prose names though neither contexts nor their cross-references have them."""
    bound = bind(markers(answers), contexts)
    parts = bound.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("to"), F.count_distinct(F.when(F.col("ctx").isNotNull(), F.col("text"))).alias("n_kept"), F.count_distinct(F.when((F.col("text") == "") & (F.col("kind") != "other"), F.regexp_replace("marker", r"\s+", " "))).alias("n_stripped"))
    gaps = F.split("answer", V.CANDIDATE)
    to = F.coalesce(F.transform("to", lambda x: x["text"]), F.array().cast("array<string>"))
    rows = answers.join(parts, "aid", "left").withColumn("raw", F.array_join(F.zip_with(gaps, to, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), ""))
    refs = F.coalesce("references", F.array().cast("array<string>")) if "references" in contexts.columns else F.array().cast("array<string>")
    known = contexts.select("aid", F.explode(F.concat(F.array(F.coalesce("section_number", F.lit(""))), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(X.java(V.MENTIONED)), F.lit(1)), refs)).alias("s"))
    known = known.groupBy("aid").agg(F.collect_set("s").alias("known"))
    rows = rows.join(known, "aid", "left").withColumn("invented", F.array_except(prose_sections(F.col("raw")), F.coalesce("known", F.array().cast("array<string>"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("aid", tidy(F.col("raw")).alias("text"), zero("n_kept"), zero("n_stripped"), F.array_join("invented", ",").alias("invented"), ((F.coalesce("n_stripped", F.lit(0)) == 0) & (F.size("invented") == 0)).alias("valid"))


def marker_gate(text: Column) -> Column:
    """What a stream lets through once it has ended: a bracket that never closes is dropped if it looks like a
    citation. Whole markers are judged by validate()."""
    rest = F.regexp_extract(text, r"(?s)\[[^\]]*$", 0)
    return F.when((rest != "") & rest.rlike(X.java(V.HALF_CITATION)), F.substring(text, F.lit(1), F.length(text) - F.length(rest))).otherwise(text)
