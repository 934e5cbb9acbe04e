"""The table function that chunks pages gives the chunks of the JVM's fold."""

import random

import pytest

from quarry.functions import tables
from quarry.operators import chunking as C


def test_chunks_of_random_pages(spark):
    rng = random.Random(3)
    words = ["word", "End.", "no-\nbreak", "x" * 700, "é ", "\n\n", "\n \n", " ", "Why?  ", "longer-word!", " ", "-\n"]
    rows = [(rng.randint(0, 30), p, rng.choice([None, "", "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([3, 60, 400])))])) for p in range(120)]
    rows += [(77, 1, "a" * 4000), (78, 1, " \n\n "), (79, 1, "One. " * 900), (None, 5, "of nobody")]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string").repartition(4)
    df.createOrReplaceTempView("some_pages")
    assert tables.register(spark) == "quarry_chunk_pages"
    got = spark.sql("SELECT * FROM quarry_chunk_pages(TABLE(some_pages))")
    assert got.columns == ["id", "chunk_index", "text", "page_start", "page_end"]
    want = sorted(map(tuple, C.chunk_documents(df, page_col="page").collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 60
    assert spark.sql("SELECT * FROM quarry_chunk_pages(TABLE(SELECT * FROM some_pages WHERE false))").count() == 0


def test_the_function_wants_a_table(spark):
    tables.register(spark)
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM quarry_chunk_pages('text')").collect()
