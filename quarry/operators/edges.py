"""What stands between the operators and their users: job states, records, cards, labels, forms and table geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import values as V


def or_null(c: Column) -> Column:
    """An empty string counts as none."""
    return F.nullif(c, F.lit(""))


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key of an append-only log: what a key-value store would hold."""
    own = F.struct(*order, *(c for c in log.columns if c not in (key, *order)))
    return log.groupBy(key).agg(F.max(own).alias("last_")).select(key, "last_.*")


def job_status(log: DataFrame, key: str, order: list[str], stage: str, share: str, attempts: int = 2) -> DataFrame:
    """(key, status, progress, failures) of jobs from their stage events: the last stage and its share done, to two
    places, halves decided on a hundred times the share; a job is failed once it has failed as often as it is tried, and
    queued again before."""
    last = log.groupBy(key).agg(F.max_by(F.struct(stage, share), F.struct(*order)).alias("s"), F.count_if(F.col(stage) == "failed").alias("failures"))
    own, done = F.col(f"s.{stage}"), F.round(F.coalesce(F.col(f"s.{share}"), F.lit(0.0)) * 100) / 100
    status = F.when((own == "failed") & (F.col("failures") < attempts), "queued").otherwise(own)
    return last.select(key, status.alias("status"), F.when(own == "ready", 1.0).when(own == "failed", 0.0).otherwise(done).alias("progress"), "failures")


def stage_bar(status: Column, progress: Column) -> Column:
    """Percentage that a bar shows: what is done, at least what the stage says, within 6 and 100; none for failed jobs."""
    at = F.array_position(F.array(*map(F.lit, V.STAGES)), status)  # 0 for queued
    own = F.when(status == "ready", 100.0).otherwise(F.greatest(progress * 100, at / 4 * 100 - 12))
    return F.when(status != "failed", F.greatest(F.lit(6.0), F.least(F.lit(100.0), own)))


def backoff(attempt: Column, first: float, factor: float, most: float) -> Column:
    """Milliseconds to wait before an attempt, from 0."""
    return F.least(F.lit(first) * F.pow(F.lit(factor), attempt), F.lit(most))


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    return F.coalesce(origin.isin([a.rstrip("/") for a in allowed]), F.lit(False))


def cards(bound: DataFrame, contexts: DataFrame) -> DataFrame:
    """Citation cards of bound markers (aid, pos, text, ctx, subs) with their contexts: one per different marker of an
    answer, numbered from 1 as they appear."""
    hits = bound.where("ctx IS NOT NULL").groupBy("aid", F.col("text").alias("marker")).agg(F.min_by(F.struct("ctx", "subs"), "pos").alias("c"), F.min("pos").alias("pos"))
    hits = hits.select("aid", "marker", F.col("c.ctx").alias("idx"), F.col("c.subs").alias("subs"), F.row_number().over(Window.partitionBy("aid").orderBy("pos")).alias("number"))
    rows = hits.join(contexts.withColumnRenamed("text", "passage"), ["aid", "idx"])
    # a subsection that the marker lost in binding is not shown
    kept = F.when(F.col("marker").contains(F.coalesce("subs", F.lit("("))), F.col("subs"))
    names = {c: or_null(F.col(c)) for c in ("act_short", "section_number", "document_name")}
    return rows.select("aid", "number", "marker", F.coalesce(or_null(F.col("source")), F.lit("statute")).alias("source"), *(c.alias(name) for name, c in names.items()), F.coalesce(or_null(kept), or_null(F.col("subsection"))).alias("subsection"), "page_start", "page_end", F.coalesce("passage", F.lit("")).alias("text"))


def ui_parts(text: Column) -> Column:
    """array<struct<part, is_marker>>: plain text and bracketed markers in turn."""
    cut = F.split(F.regexp_replace(text, V.UI_MARKER, "\x01$0\x01"), "\x01")
    return F.filter(F.transform(cut, lambda p, i: F.struct(p.alias("part"), (i % 2 == 1).alias("is_marker"))), lambda p: p["part"] != "")


def citation_label(card: str = "") -> Column:
    """Of a card's columns: document and page, or act and section."""
    c = lambda name: F.col(card + name)
    page = F.when(c("page_start").isNotNull() & (c("page_start") != 0), X.page_label(c("page_start"), F.nullif(c("page_end"), F.lit(0))))
    section = F.concat(c("act_short"), F.lit(" s."), F.concat_ws("", or_null(c("section_number")), or_null(c("subsection"))))
    return F.when(c("source") == "document", F.concat_ws(" ", or_null(c("document_name")), page)).otherwise(section)


def size_label(size: Column) -> Column:
    kb = size / 1024
    return F.when(F.coalesce(size, F.lit(0)) == 0, "").when(kb < 1024, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.floor(kb / 1024 * 10 + 0.5) / 10), F.lit(" MB")))


def see_sections(see: Column) -> Column:
    """Sections that a form is prescribed under."""
    return F.filter(F.transform(F.split(F.coalesce(see, F.lit("")), r"[,\s]+and\s+|,\s*"), X.trim), lambda s: s != "")


def bare_section(section: Column) -> Column:
    return F.regexp_replace(section, r"(?s)\(.*", "")


def form_chunks(forms: DataFrame) -> DataFrame:
    """forms (form_number, title, see) as chunks: the sentence that prescribes each, under its first section."""
    rows = forms.withColumn("s", see_sections(F.col("see"))).withColumn("t", X.title_case(F.col("title")))
    under = F.when(F.size("s") > 0, F.concat(F.lit(" under section "), F.array_join("s", " and "), F.lit(" of the BNSS"))).otherwise("")
    text = F.concat(F.lit("The Second Schedule to the BNSS prescribes Form No. "), F.col("form_number").cast("string"), F.lit(", "), F.col("t"), under, F.lit("."))
    key = F.concat(F.lit("bnss-form-"), F.when(F.length(F.col("form_number").cast("string")) >= 3, F.col("form_number").cast("string")).otherwise(F.lpad(F.col("form_number").cast("string"), 3, "0")))
    first = or_null(bare_section(F.try_element_at(F.col("s"), F.lit(1))))
    return rows.select(*(c for c in forms.columns if c not in ("title", "see")), key.alias("chunk_id"), first.alias("section_number"), text.alias("text"), F.transform("s", bare_section).alias("references"))


def form_titles(lines: DataFrame, doc: str = "doc_id", order: str = "line_no", text: str = "text") -> DataFrame:
    """(doc, order, form_number, title, see): of each line that heads a form, the title from up to three of the seven lines
    below it that are not blank, and the reference that ends it."""
    ahead = Window.partitionBy(doc).orderBy(order).rowsBetween(1, 7)
    rows = lines.withColumn("t_", X.trim(F.col(text))).withColumn("below_", F.collect_list("t_").over(ahead))
    rows = rows.where(F.col("t_").rlike(V.FORM_HEADER)).withColumn("b_", F.filter("below_", lambda x: x != ""))
    is_see = F.transform("b_", lambda x: x.rlike(V.SEE_REFERENCE))
    at = F.array_position(is_see, F.lit(True))
    seen = (at > 0) & (at <= 4)  # a reference after more than three title lines is not reached
    parts = F.slice(F.col("b_"), F.lit(1), F.when(seen, at.cast("int") - 1).otherwise(3))
    see = F.when(seen, F.regexp_extract(F.get(F.col("b_"), at.cast("int") - 1), V.SEE_REFERENCE, 1))
    return rows.select(doc, order, F.regexp_extract("t_", V.FORM_HEADER, 1).cast("int").alias("form_number"), X.trim(X.collapse(F.array_join(parts, " "))).alias("title"), see.alias("see"))


def margin_notes(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, top_y, part, text): margin blocks (doc_id, page, top_y, text) split where a new sentence begins,
    without references to acts."""
    rows = blocks.select("doc_id", "page", "top_y", F.posexplode(F.split("text", r"(?<=\.)\s+(?=[A-Z])")).alias("part", "p"))
    return rows.select("doc_id", "page", "top_y", "part", X.trim(F.col("p")).alias("text")).where((F.col("text") != "") & ~F.col("text").rlike(V.ACT_REFERENCE))


def table_region(cells: DataFrame) -> DataFrame:
    """Runs (doc_id, page, line_no, str) of the table proper: after the last line of column numbers on a page and before
    the first line that heads part II."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "str"))), lambda r: r["str"]), " ")
    numbers = (F.count("*") >= 4) & F.every(X.trim(F.col("str")).rlike("^[1-6]$"))
    lines = cells.groupBy("doc_id", "page", "line_no").agg(numbers.alias("numbers"), X.trim(line).rlike(V.PART_TWO).alias("part_two"))
    end = lines.groupBy("doc_id", "page").agg(F.min(F.when(F.col("part_two"), F.col("line_no"))).alias("end_"))
    lines = lines.join(end, ["doc_id", "page"]).where("end_ IS NULL OR line_no < end_")
    start = F.coalesce(F.max(F.when(F.col("numbers"), F.col("line_no"))).over(Window.partitionBy("doc_id", "page")), F.lit(-1))
    return cells.join(lines.withColumn("start_", start).where("line_no > start_").select("doc_id", "page", "line_no"), ["doc_id", "page", "line_no"])


def nearest_space(text: Column, guess: Column) -> Column:
    """Place (from 0) of the space nearest to the guess, the first of two; -1 without one."""
    upto, start = F.substring(text, F.lit(1), guess + 1), F.greatest(guess + 1, F.lit(0))
    back, ahead = F.instr(F.reverse(upto), " "), F.instr(F.substring(text, start + 1, F.length(text)), " ")
    before, after = F.length(upto) - back, start + ahead - 1
    return F.when((back > 0) & ((ahead == 0) | (guess - before <= after - guess)), before).when(ahead > 0, after).otherwise(-1)


def split_run(x: Column, width: Column, text: Column, char_width: Column) -> Column:
    """array<struct<x, width, str>>: a run cut at each table column that starts inside it by more than five characters, at
    the space nearest to where its characters, counted from both ends, put the edge. A run is cut once per column at
    most, so the fold is over columns."""
    part = lambda a, w, s: F.struct(a.cast("double").alias("x"), w.cast("double").alias("width"), s.alias("str"))
    none = F.array().cast("array<struct<x:double,width:double,str:string>>")
    state = F.struct(none.alias("out"), x.cast("double").alias("x"), width.cast("double").alias("width"), text.alias("str"), F.lit(False).alias("done"))

    def step(s, edge):
        end = s["x"] + s["width"]
        inside = ~s["done"] & (edge > s["x"] + V.COLUMN_SLACK) & (edge < end - char_width * 5)
        guess = F.floor(((edge - s["x"]) / char_width + F.length(s["str"]) - (end - edge) / char_width) / 2 + 0.5).cast("int")
        return X.named(F.when(inside, nearest_space(s["str"], guess)).otherwise(-1), lambda at: after_cut(s, edge, end, inside, at))

    def after_cut(s, edge, end, inside, at):
        cut = inside & (at > 0)
        rest = X.trim(F.substring(s["str"], at + 2, F.length(s["str"])))
        return F.struct(
            F.when(cut, F.concat(s["out"], F.array(part(s["x"], edge - s["x"], X.trim(F.substring(s["str"], F.lit(1), at)))))).otherwise(s["out"]).alias("out"),
            F.when(cut, edge).otherwise(s["x"]).alias("x"),
            F.when(cut, end - edge).otherwise(s["width"]).alias("width"),
            F.when(cut, rest).otherwise(s["str"]).alias("str"),
            (s["done"] | (inside & ~cut) | (cut & (rest == ""))).alias("done"),
        )

    edges = F.array(*(F.lit(float(start)) for _, start, _ in V.TABLE_COLUMNS[1:]))
    ended = lambda s: F.when(s["str"] != "", F.concat(s["out"], F.array(part(s["x"], s["width"], s["str"])))).otherwise(s["out"])
    return F.aggregate(edges, state, step, ended)


def char_width(runs: DataFrame) -> DataFrame:
    """(doc_id, page, char_width): upper median over runs of ten characters or more that lie in one column; 3.4 without."""
    inside = F.lit(True)
    for _, start, _ in V.TABLE_COLUMNS[1:]:
        inside = inside & ~((F.lit(start) > F.col("x") + V.COLUMN_SLACK) & (F.lit(start) < F.col("x") + F.col("width")))
    w = F.sort_array(F.collect_list(F.when((F.length("str") >= 10) & inside, F.col("width") / F.length("str"))))
    return runs.groupBy("doc_id", "page").agg(F.coalesce(F.get(w, F.floor(F.size(w) / 2).cast("int")), F.lit(3.4)).alias("char_width"))


def slots(requests: DataFrame, box: str, key: str, start: str, end: str, request_id: str, per_key: int = 2, total: int = 12) -> DataFrame:
    """(box, request_id, allowed): requests of a box in order of their start; one is refused while its key holds per_key
    slots or the box all. A slot is given back once, when its request ends; ends at the same time count first. A box's
    requests stream through one task in order; only its open slots are held."""

    def run(batches):
        import heapq

        import pyarrow as pa

        now, held, busy = None, {}, []
        for batch in batches:
            allowed = []
            for b, k, a, z in zip(*(batch.column(c).to_pylist() for c in ("box", "key", "start", "end")), strict=True):
                if b != now:
                    now, held, busy = b, {}, []
                while busy and busy[0][0] <= a:
                    gone = heapq.heappop(busy)[1]
                    held[gone] -= 1
                ok = len(busy) < total and held.get(k, 0) < per_key
                if ok:
                    held[k] = held.get(k, 0) + 1
                    heapq.heappush(busy, (z, k))
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("box"), batch.column("id"), pa.array(allowed, pa.bool_())], names=["box", "request_id", "allowed"])

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = requests.select(F.col(box).alias("box"), F.col(key).alias("key"), micros(start).alias("start"), micros(end).alias("end"), F.col(request_id).alias("id"))
    kinds = dict(rows.dtypes)
    return rows.repartition("box").sortWithinPartitions("box", "start", "id").mapInArrow(run, f"box {kinds['box']}, request_id {kinds['id']}, allowed boolean")


def register(spark) -> list[str]:
    """Functions for SQL: quarry_tokens(text), quarry_token_estimate(text), quarry_see_sections(see), and the table function
    quarry_markers(answer). Their bodies are SQL, so that plans stay in the JVM."""
    raw = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    made = {
        "quarry_tokens(text STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(lower(coalesce(text, '')), {raw(X.TERM)}, 0)",
        "quarry_token_estimate(text STRING) RETURNS BIGINT": "ceil(length(coalesce(text, '')) / 4)",
        "quarry_see_sections(see STRING) RETURNS ARRAY<STRING>": f"filter(transform(split(coalesce(see, ''), {raw(r'[,\s]+and\s+|,\s*')}), s -> trim(s)), s -> s <> '')",
        "quarry_markers(answer STRING) RETURNS TABLE (pos INT, marker STRING)": f"SELECT pos, col FROM posexplode(regexp_extract_all(answer, {raw(V.CANDIDATE)}, 0))",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in made]
