r"""Secret scan with multipart credential linking; DataFrame operations only.

Base kinds stand alone: assignments, access identifiers and long hex runs. Weak candidates say little alone: a short
assigned value, a user name given by assignment, a mixed-case blob, a URL or host. They are reported only when a
complementary part stands within SCOPE code points in the same text: the candidates of a text are interval-joined,
cell by cell, and a semi join asks for one partner, so that no pairs are emitted.

Positions come from splitting a text by a pattern: what lies between the matches and the matches themselves alternate,
and running sums of their lengths are the offsets: over sqrt(n) matches at a time, then over those sums, since a fold that
appends to an array copies it. Texts without any hit of a pattern are never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

#: The base kinds in their order, and their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
BASE = ("assign", "access", "hex")

#: The weak kinds: pattern, and the roles of the parts that complete it. A name needs a secret, a secret needs a name
#: or an endpoint, an endpoint needs a secret.
USER = r"""(?i:user(?:name)?|login|access_?key(?:_?id)?|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@-]{3,}"""
SHORT = r"""(?i:password|passwd|pwd|secret|token|api_?key|pass)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"',;]{4,}"""
BLOB = r"[A-Za-z0-9+/]{38,}={0,2}"
ENDPOINT = r"""(?i:[a-z][a-z0-9+.-]{1,9}://[^\x20\x09-\x0D"'<>]{4,}|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})"""
WEAK = (("name", USER), ("short", SHORT), ("blob", BLOB), ("endpoint", ENDPOINT))
ROLE = {"assign": "secret", "access": "name", "hex": "secret", "name": "name", "short": "secret", "blob": "secret", "endpoint": "endpoint"}
NEEDS = {"name": ("secret",), "short": ("name", "endpoint"), "blob": ("name", "endpoint"), "endpoint": ("secret",)}
KINDS = (*BASE, *(kind for kind, _ in WEAK))
#: Code points between the starts of parts that belong together.
SCOPE = 256


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def offsets(pairs: Column) -> Column:
    """Array of (start, end, ok) of hits from the lengths of the gaps before them and of themselves: pairs (gap, hit, ok)."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("out"))
    bases = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    width = F.greatest(F.ceil(F.sqrt(F.size(pairs))), F.lit(1)).cast("int")

    def step(acc, pair):
        start = acc["at"] + pair["gap"]
        end = start + pair["hit"]
        one = F.struct(start.alias("start"), end.alias("end"), pair["ok"].alias("ok"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def whole(parts):
        before = F.aggregate(parts, bases, lambda acc, part: F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, before, lambda part, base: F.transform(part["out"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["ok"].alias("ok")))))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), width)
    return once(F.transform(firsts, lambda first: F.aggregate(F.slice(pairs, first, width), none, step)), whole)


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, end, kind) of the leftmost matches that don't overlap; keep: a test of the matched text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    lengths = lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), (keep(h) if keep else F.lit(True)).alias("ok"))
    pairs = once(found, lambda hits: F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lengths))
    hits = F.filter(once(pairs, offsets), lambda s: s["ok"])
    as_spans = F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return F.when(text.rlike(pattern), as_spans).otherwise(none)


def _joined(array: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak.

    A null or empty text has no spans. Rows with the same doc_id, or null, are scanned each on its own. Spans that
    start at the same place are ordered by kind; spans of different kinds may overlap. A weak span that lies within a
    base span of the same text is not reported. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST
    long_hex, long_access = HEX[:-1] + f"{{{HEX_LEAST},}}", ACCESS[:-1] + f"{{{ACCESS_LEAST - 4},}}"  # the same matches: these runs are maximal
    base = F.concat(spans(text, ASSIGN, "assign", value), spans(text, long_access, "access"), spans(text, long_hex, "hex"))
    weak = F.concat(*(spans(text, pattern, kind) for kind, pattern in WEAK))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.array_sort(base).alias("base"), weak.alias("weak"))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "candidates")

    # each part of a text that has weak candidates, in its cell; cells are as long as the scope, so partners are in
    # the same cell or in one beside it
    parts = found.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*").withColumn("cell", F.expr(f"start div {scope}"))
    role = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])))
    first_weak = len(BASE)
    needs = F.create_map(*(x for k in NEEDS for x in (F.lit(KINDS.index(k)), F.array(*map(F.lit, NEEDS[k])))))
    # a weak span inside a base one is none; a base span stands in every cell that it reaches
    covers = parts.where(F.col("kind") < first_weak).select(F.col("row").alias("b_row"), F.explode(F.sequence(F.col("cell"), F.expr(f"end div {scope}"))).alias("b_cell"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    covered = (F.col("row") == F.col("b_row")) & (F.col("cell") == F.col("b_cell")) & (F.col("b_start") <= F.col("start")) & (F.col("end") <= F.col("b_end"))
    outside = parts.where(F.col("kind") >= first_weak).join(covers, covered, "left_anti")
    wanted = outside.withColumn("need", F.explode(F.element_at(needs, F.col("kind")))).withColumn("cell", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)))
    offered = parts.select(F.col("row").alias("o_row"), F.col("cell").alias("o_cell"), F.element_at(role, F.col("kind")).alias("role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    near = (F.col("row") == F.col("o_row")) & (F.col("cell") == F.col("o_cell")) & (F.col("need") == F.col("role")) & (F.abs(F.col("start") - F.col("o_start")) <= scope) & ((F.col("end") <= F.col("o_start")) | (F.col("o_end") <= F.col("start")))
    linked = wanted.join(offered, near, "left_semi").groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("linked"))

    rows = found.join(linked, "row", "left")
    rows = rows.select("doc_id", "base", F.coalesce("linked", F.array().cast("array<struct<start:int,end:int,kind:int>>")).alias("more"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_weak"))
