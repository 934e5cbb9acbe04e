"""Citations on small answers with known results, and that the queries on answers read the tables."""

import pytest

from quarry.operators import citations as C
from quarry.plans import edges, language, records
from tests.conftest import DATA

CTX = "aid int, idx int, source string, act_short string, section_number string, subsection string, text string, document_name string, page_start int, page_end int"
STATUTE = [
    (0, "statute", "BNSS", "35", "(1)", "Any police officer may. As in section 58 it is.", None, 10, 11),
    (1, "statute", "BNSS", "103", "(2)", "two: (2) that is (a) here", None, 31, 31),
    (2, "statute", "BNSS", "103", None, "Other text", None, 30, None),
    (3, "document", None, None, None, "uploaded", "notice.pdf", 1, 3),
]
CASES = [
    ("kept without its page", "Held [BNSS s.103, p.191].", "Held [BNSS s.103].", 1, 0, "", True),
    ("stripped", "Bail is granted [BNSS s.480].", "Bail is granted.", 0, 1, "", False),
    ("bound by subsection", "So [BNSS s.103(2)].", "So [BNSS s.103(2)].", 1, 0, "", True),
    ("subsection without support", "So [BNSS s.103(9)].", "So [BNSS s.103].", 1, 0, "", True),
    ("page of a document", "See [doc: Notice.pdf p.2].", "See [doc: notice.pdf p.1].", 1, 0, "", True),
    ("page beyond a document", "See [doc: notice.pdf p.99].", "See.", 0, 1, "", False),
    ("another act", "See [IPC s.35].", "See.", 0, 1, "", False),
    ("invented in prose", "Under Section 999 of the BNSS, and section 58.", "Under Section 999 of the BNSS, and section 58.", 0, 0, "999", False),
    ("no citation", "Take [12 apples] and [see note].", "Take [12 apples] and [see note].", 0, 0, "", True),
    ("empty brackets", "See ([BNSS s.7]) there", "See  there", 0, 1, "", False),
    ("empty", "", "", 0, 0, "", True),
]


def test_known_answers(spark):
    answers = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "aid int, answer string")
    contexts = spark.createDataFrame([(i, *c) for i in range(len(CASES)) for c in STATUTE], CTX)
    got = {r["aid"]: (r["text"], r["n_kept"], r["n_stripped"], r["invented"], r["valid"]) for r in C.validate(answers, contexts).collect()}
    for i, (name, _, *expected) in enumerate(CASES):
        assert got[i] == tuple(expected), name


def test_an_answer_without_contexts(spark):
    answers = spark.createDataFrame([(1, "Bail [BNSS s.480] x [BNSS s.3"), (2, None)], "aid int, answer string")
    got = {r["aid"]: r["text"] for r in C.validate(answers, spark.createDataFrame([], CTX)).collect()}
    assert got[1] == "Bail x [BNSS s.3"
    assert [r["s"] for r in answers.where("aid = 1").select(C.marker_gate(answers["answer"]).alias("s")).collect()] == ["Bail [BNSS s.480] x "]


@pytest.mark.parametrize("query", [language.citation_validate, language.marker_gate, language.doc_citation_range, records.citation_accuracy, edges.citation_cards, edges.ui_markers, edges.form_titles])
def test_answers_come_from_tables(spark, query):
    """Every leaf of the plan is a table."""
    leaves = query(spark, DATA)._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert "parquet" in leaves and "LocalRelation" not in leaves and "LogicalRDD" not in leaves
