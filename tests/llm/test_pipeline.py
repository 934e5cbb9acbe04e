"""The pipeline's stages against brute force on a small table, and its queries' SQL."""

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from quarry.llm import bpe, mixing, queries
from tests.llm import test_corpus_operators as C


@pytest.fixture(scope="module")
def stages(spark, documents):
    from quarry.llm.shared import written

    out, docs = [], documents
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "stage")
        out.append(docs)
    return out


def test_columns(stages, documents):
    assert all(s.columns == documents.columns for s in stages[:-1]) and stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_rules_and_dedup(stages, documents):
    from quarry.llm.quality_rules import quality_figures

    kept = {r["doc_id"] for r in quality_figures(documents).where("kept").collect()}
    assert {r["doc_id"] for r in stages[0].collect()} == kept
    texts = {}
    for r in stages[0].collect():
        key = C.squeezed(r["text"])
        texts[key] = min(texts.get(key, (0, 0)), (-len(r["text"]), r["doc_id"])) if key in texts else (-len(r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in stages[1].collect()} == {i for _, i in texts.values()}


def test_near_copies_are_gone(stages):
    rows = stages[2].collect()
    sets = [C.shingles(r["text"]) for r in rows]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_tokens_are_those_of_the_mix(stages):
    import hashlib

    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((r["doc_id"], hashlib.sha256(" ".join(map(str, plain.encode_ordinary(r["text"]))).encode()).hexdigest()) for r in stages[3].collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in stages[4].collect()) == want


def test_odd_rows_go_through_all_stages(spark, odd, none):
    """Extra columns stay, whatever their names, until the last stage; what is kept follows the rules of each stage."""
    from quarry.llm.shared import written

    long_ = odd.where("length(text) > 100").selectExpr(*(f"CAST(NULL AS BIGINT) AS {c}" if c == "doc_id" else f"`{c}`" for c in odd.columns))
    more = spark.range(90).selectExpr("id % 30 AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', x * (id % 30 + 2)))) AS text", "'en' AS lang", "IF(id % 2 = 0, NULL, 's') AS source", "1L AS n_chars", *(f"'x' AS `{c}`" for c in odd.columns[5:]))
    docs, counts = odd.unionByName(long_).unionByName(more), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "stage")
        assert docs.columns == odd.columns
        counts.append(docs.count())
    assert counts[1] <= counts[0] and counts[2] <= counts[1] == len({C.squeezed(r["text"]) for r in more.unionByName(long_).collect()}) and counts[3] > 0
    assert written(corpus_pipeline.STAGES[-1][1](spark, docs, ""), "stage").count() == counts[3]
    for _, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, ""), "stage")
        assert none.count() == 0


def test_mixing_has_one_worker_per_task(documents):
    """Two Python steps in one task take two workers, and idle ones keep their memory while later stages use them in turn."""
    steps = [x for x in mixing.mix_sources(documents).slots._jdf.queryExecution().executedPlan().toString().split("\n") if "MapIn" in x or "Exchange" in x or "WholeStage" in x]
    first, second = [i for i, x in enumerate(steps) if "MapIn" in x][:2]
    assert any("Exchange" in x and "BroadcastExchange" not in x for x in steps[first:second])


def test_blocks_are_smaller_than_batches():
    texts = [f"{i} " * 5000 for i in range(10, 1000)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    made = list(bpe.small_blocks([batch, batch]))
    assert [t for _, own in made for t in own] == 2 * texts and [k for own, _ in made for k in own] == 2 * list(range(len(texts)))
    assert max(sum(len(t or "") for t in own) for _, own in made) < bpe.BLOCK + bpe.ROWS * 21_000


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])
