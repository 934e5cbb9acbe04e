"""Queries over whole tables and whole texts: on tables of their own, against brute force in Python."""

import hashlib
import re
from collections import Counter

from quarry.functions import values as V
from quarry.plans import language, parsing, search

WORDS = "the officer may arrest any person who flees before court on bail and bond of peace".split()


def prose(n, seed, stop=11):
    """n words; a sentence ends at each word whose place is a multiple of stop."""
    words = [WORDS[(i * i + seed * 7 + i) % len(WORDS)] + ("." if stop and (i + 1) % stop == 0 else "") for i in range(n)]
    return " ".join(words)


def tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def pieces(text, most=1500):
    """Sentences packed up to `most`, longer ones cut at the last space before it."""
    text = " ".join(text.split())
    if len(text) <= most:
        return [text] if text else []
    out, buf = [], ""
    for t in re.split(r"(?<=[.!?])\s+", text):
        if buf and len(buf) + len(t) + 1 > most:
            out.append(buf)
            buf = ""
        buf = f"{buf} {t}" if buf else t
        while len(buf) > most:
            at = buf[: most + 1].rfind(" ")
            out.append(buf[: at if at > 0 else most])
            buf = buf[at + 1 if at > 0 else most :]
    return [*out, buf] if buf else out


def chunks(pages, most=1500, overlap=150):
    """(text, first page, last page) of an upload's pages."""
    out, buf, a, z = [], "", None, None
    for page, text in pages:
        for t in pieces(text or ""):
            if buf and len(buf) + len(t) + 2 > most:
                out.append((buf.strip(), a, z))
                tail = re.sub(r"^\S*\s", "", buf[-overlap:])
                a, buf = (z, tail) if tail else (page, "")
            a = page if a is None else a
            buf, z = f"{buf}\n\n{t}" if buf else t, page
    return [*out, (buf.strip(), a, z)] if buf.strip() else out


def test_page_ranges_of_long_pages(spark, tmp_path):
    """Pages of any length, without n_chars and without text."""
    texts = [prose(40, 1), prose(900, 2), None, prose(2500, 3, 0), "x" * 4000, "", prose(30, 4), prose(700, 5, 5)]
    rows = [(20 + i, t, None if i % 2 else len(t or "")) for i, t in enumerate(texts)]
    d = tables(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    got = sorted(tuple(r[c] for c in ("chunk_index", "page_start", "page_end", "text_sha256")) for r in parsing.chunk_page_ranges(spark, d).collect())
    want = chunks([(i + 1, t) for i, t in enumerate(texts)])
    assert got == [(k, a, z, hashlib.sha256(t.encode()).hexdigest()) for k, (t, a, z) in enumerate(want)]
    assert {1, 2, 4, 5, 7, 8} <= {p for _, a, z, _ in got for p in range(a, z + 1)} and any(z > a for _, a, z, _ in got)


def test_index_holds_terms_that_no_question_has(spark, tmp_path):
    texts = ["Warrant of arrest, arrest", "the bail bond bail bond bail", None, "the of"]
    d = tables(spark, tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark=spark.createDataFrame([(0, "arrest")], "item_id long, text string"))
    terms = [[t for t in re.findall("[a-z0-9]+", (x or "").lower()) if t not in V.STOP_WORDS] for x in texts]
    average = sum(map(len, terms)) / len(terms)
    want = {(i, t): (n, len(ts)) for i, ts in enumerate(terms) for t, n in Counter(ts).items()}
    assert {t for _, t in want} > {"arrest", "bail", "bond"}
    assert {(r["doc_id"], r["term"]): (r["tf"], r["length"]) for r in search.term_frequency_documents(spark, d).collect()} == want
    weights = {k: (n, round(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * m / average)), 6)) for k, (n, m) in want.items()}
    assert {(r["doc_id"], r["term"]): (r["tf"], r["weight"]) for r in search.bm25_doc_weights_whole(spark, d).collect()} == weights
    assert {r["term"] for r in search.term_id_fnv1a_documents(spark, d).collect()} == {t for _, t in want}


def test_contexts_hold_whole_passages(spark, tmp_path):
    text = "bail " + prose(300, 6)
    d = tables(spark, tmp_path, documents=spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"), benchmark=spark.createDataFrame([(0, "bail")], "item_id long, text string"))
    want = f'[1] uploaded document "s.pdf", page 1 - cite as [doc: s.pdf p.1]\n{text}'
    assert [r["context_sha256"] for r in search.prompt_context(spark, d).collect()] == [hashlib.sha256(want.encode()).hexdigest()]


def title(text):
    def half(h):
        at = re.match("[^a-z]*", h).end()
        return h[:at] + h[at : at + 1].upper() + h[at + 1 :]

    words = [w for w in re.split(r"[\s\ufeff]+", text.lower()) if w]
    return " ".join(w if i and re.sub("[^a-z]", "", w) in V.SMALL_WORDS else "-".join(map(half, w.split("-"))) for i, w in enumerate(words))


def slug(text):
    plain = text.lower().translate(str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", re.sub("['’]", "", plain)))


def test_titles_and_slugs_of_whole_texts(spark, tmp_path):
    """Words after the sixtieth character, long results and accents; a text without any letter, and none."""
    texts = [prose(200, 1) + " Café-Crème à l'été, of Übung and NAÏVE bail-bond", "x " * 60 + "(the) police's act\nof peace", "日本", "", None]
    d = tables(spark, tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [None if t is None else (sha(title(t)), sha(slug(t)), re.sub(r"[^A-Za-z0-9_.\-]", "_", t)[-80:]) for t in texts]
    got = {r["doc_id"]: (r["title_sha256"], r["slug_sha256"], r["file"]) for r in language.title_case_slug_whole(spark, d).collect()}
    assert [got[i] for i in range(len(texts))] == [w or (None, None, None) for w in want]


def test_titles_of_the_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in language.title_case_slug_whole(spark, d).collect():
        t = texts[r["doc_id"]]
        assert (r["title_sha256"], r["slug_sha256"]) == tuple(hashlib.sha256(f(t).encode()).hexdigest() for f in (title, slug))
