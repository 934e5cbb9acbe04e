"""Text functions as Columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import values as V

#: White space as a browser's or server's JavaScript sees it, for Java's and RE2's engines alike.
SPACE = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def java(pattern: str, ignore_case: bool = True) -> str:
    r"""A pattern with ASCII word boundaries: Java's own \b also looks at letters outside ASCII."""
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", edge)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


#: White space that is not one plain space already: what collapsing has to touch.
_UNEVEN = rf" {SPACE}+|{SPACE.replace(chr(92) + 's', chr(92) + 't' + chr(92) + 'n' + chr(92) + 'f' + chr(92) + 'r')}{SPACE}*"


def collapse(text: Column) -> Column:
    """Runs of white space as one space each."""
    return F.regexp_replace(text, _UNEVEN, " ")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


#: One pass over lower-case text: whole runs of letters and digits that are neither stop words nor single letters.
TERM = rf"(?<![a-z0-9])(?!(?:{'|'.join(V.STOP_WORDS)}|[a-z])(?![a-z0-9]))[a-z0-9]+"


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits, without stop words and single letters; single digits stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def named(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def term_id(term: Column) -> Column:
    """FNV-1a of the term's characters in 32 bits, without the lowest bit."""
    codes = F.transform(F.split(term, ""), F.ascii)
    step = lambda h, x: (h.bitwiseXOR(x.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.shiftrightunsigned(F.aggregate(codes, F.lit(2166136261).cast("long"), step), 1)


def expand_query(text: Column) -> Column:
    """The text, and after it the phrases of all patterns that it matches."""
    text = F.coalesce(text, F.lit(""))
    found = F.filter(F.array(*(F.when(text.rlike(java(p)), F.lit(words)) for p, words in V.BRIDGE)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.concat_ws(" ", text, F.array_join(found, " "))).otherwise(text)


def section_intent(text: Column) -> Column:
    """struct(number, subsection, act) of the first section that the text names; null if it names none."""
    text = F.coalesce(text, F.lit(""))
    part = lambda p, k: F.nullif(F.regexp_extract(text, java(p), k), F.lit(""))
    return F.when(text.rlike(java(V.SECTION)), F.struct(part(V.SECTION, 1).alias("number"), part(V.SECTION, 2).alias("subsection"), F.upper(part(V.ACT, 1)).alias("act")))


def sparse_query(message: Column, standalone: Column) -> Column:
    """The message, and its stand-alone wording if that differs in more than case."""
    same = standalone.isNull() | (standalone == "") | (F.lower(standalone) == F.lower(message))
    return F.when(same, message).otherwise(F.concat_ws(" ", message, standalone))


def first_line(text: Column) -> Column:
    """First line of a model's answer without the quotes around it."""
    return F.regexp_replace(trim(F.element_at(F.split(trim(F.coalesce(text, F.lit(""))), "\n"), 1)), "^[\"']+|[\"']+$", "")


def embedded_json(text: Column, schema: str) -> Column:
    """The first brace to the last one, parsed; null where it doesn't parse."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), F.from_json(body, schema))


def normalise(text: Column) -> Column:
    """Without zero-width and direction marks, white space collapsed: what guard rules are matched against."""
    return collapse(F.translate(F.coalesce(text, F.lit("")), "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e", ""))


def _first_rule(clean: Column, rules, soften: bool) -> Column:
    """Name of the first rule that the text breaks. Of each rule's words one must be there at all; only then its pattern
    is tried."""

    def tests(text: Column, lower: Column) -> Column:
        legal = text.rlike(java(V.LEGAL_SUBJECT))
        found = []
        for name, soft, p in rules:
            words = [lower.contains(w) for w in V.TRIGGERS[p]]
            there = words[0]
            for w in words[1:]:
                there = there | w
            hit = there & text.rlike(java(p))
            found.append(F.when(hit & ~legal if soft and soften else hit, F.lit(name)))
        return F.coalesce(*found)

    return named(F.struct(clean.alias("text"), F.lower(clean).alias("lower")), lambda x: tests(x["text"], x["lower"]))


def find_injection(text: Column) -> Column:
    """Name of the first guard rule that a question breaks, or null; soft rules don't hold in legal questions."""
    return _first_rule(normalise(text), V.RULES, True)


def find_document_injection(text: Column) -> Column:
    """The same for uploaded text: its own rules first, and none is softened."""
    return _first_rule(normalise(text), [*V.DOCUMENT_RULES, *V.RULES], False)


def small_talk(text: Column) -> Column:
    """Kind of small talk that the whole message is, or null."""
    text = trim(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(text.rlike(java(p)), F.lit(kind)) for kind, p in V.SMALL_TALK))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def neutralise(text: Column) -> Column:
    """struct(text, removed): the text without the sentences that give orders, and how many those are."""
    all_, kept = sentences(text), F.filter(sentences(text), lambda s: find_document_injection(s).isNull())
    cut = F.struct(F.array_join(kept, " ").alias("text"), (F.size(all_) - F.size(kept)).alias("removed"))
    # a text that breaks no rule as a whole has no sentence that does
    whole = F.struct(F.regexp_replace(text, r"(?<=[.!?])\s+", " ").alias("text"), F.lit(0).alias("removed"))
    return F.when(find_document_injection(text).isNull(), whole).otherwise(cut)


def find_references(text: Column) -> Column:
    """Numbers of sections that the text refers to (of a list, the first and the last), in numeric order."""
    both = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java(V.REFERENCES)), F.lit(k)) for k in (1, 2)]
    found = F.array_distinct(F.filter(F.concat(*both), lambda x: x != ""))
    return F.array_sort(found, lambda a, b: F.when(a.cast("int") < b.cast("int"), -1).when(a.cast("int") > b.cast("int"), 1).otherwise(0))


def title_case(text: Column) -> Column:
    """Words capitalised, halves of hyphenated words too; small words only at the start."""
    words = F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda w: w != "")
    small = F.array(*map(F.lit, V.SMALL_WORDS))
    halves = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda h: F.concat(F.regexp_extract(h, "^[^a-z]*", 0), F.upper(F.substring(F.regexp_replace(h, "^[^a-z]*", ""), 1, 1)), F.expr("''"), F.regexp_replace(h, "^[^a-z]*[a-z]?", ""))), "-")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(small, F.regexp_replace(w, "[^a-z]", "")), w).otherwise(halves(w))), " ")


def slug(text: Column) -> Column:
    """ASCII slug: apostrophes go, other runs become one hyphen. Accents are dropped by a table of Latin letters."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "['’]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_filename(name: Column) -> Column:
    return F.right(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_"), F.lit(80))


def conversation_title(message: Column) -> Column:
    text = trim(collapse(message))
    return F.when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text)


def point_id(key: Column) -> Column:
    """SHA-1 of the key, cut like a UUID: a stable identity for upserts."""
    h = F.sha1(key.cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def embed_text(chapter: Column, heading: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(chapter, F.lit("")), F.nullif(heading, F.lit("")), text)


def structural_flags(text: Column) -> Column:
    """struct of has_illustration, has_proviso, has_exception, has_explanation."""
    tests = {"illustration": r"\bIllustrations?\b", "proviso": r"\bProvided\b", "exception": r"\bException\b", "explanation": r"\bExplanation\b"}
    return F.struct(*(text.rlike(java(p, False)).alias(f"has_{k}") for k, p in tests.items()))


def session_ok(session_id: Column) -> Column:
    return F.coalesce(session_id.rlike(r"^[A-Za-z0-9_\-]{8,64}$"), F.lit(False))


def page_label(start: Column, end: Column) -> Column:
    return F.when(end.isNull() | (end == start), F.concat(F.lit("p. "), start)).otherwise(F.concat(F.lit("pp. "), start, F.lit("-"), end))


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
