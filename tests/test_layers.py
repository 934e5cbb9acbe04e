"""Nothing outside the corpus operators imports them; the rest stands alone."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent


def test_no_import_of_llm():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"quarry\.llm|from quarry import llm|corpus_pipeline", path.read_text()), path


def test_entry_registers_queries_with_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 80
