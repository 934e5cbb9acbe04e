import pytest

#: Names that operators give to columns of their own, with and without a leading underscore.
CLASHES = """score size kept hash digest root cls row n text_sha256 start bucket id own skey length maybe best ranges number
grp part block words spot_ bits_ deal_ salt_ v_id r_id _d _id _h _maybe _cls _own _passes""".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names clash with
    those that operators make."""
    long_ = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "a b c d", "same text here for two rows and more words to come", "same text here for two rows and more words to come", "Ünïcode 😀 text\x85with\x0bodd space", long_, "token = abcdefabcdef0123456789"]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    rows += [(None, "null id", None, None, None), (5, texts[5], "en", "s2", 1), (5, texts[5], "en", "s2", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
