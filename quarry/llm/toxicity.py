r"""Toxic passages as maximal-scoring segments of token log-odds, calibrated as extreme values.

A token is read as up to three units: the word, its first six and its first four characters, so that inflected and
unseen forms of a stem count. A unit's log-odds between toxic and clean training documents are shrunk by a Dirichlet
prior in proportion to its share of all training documents, and divided by their deviation to tell whether they mean
anything. A token's score is its strongest significant unit's log-odds, and a fixed loss if it has none or follows
itself, as a word that is repeated says nothing new. All maximal
segments of a text are found in linear time (Ruzzo and Tompa). The best segment of n tokens of clean text follows an
extreme-value law, P(score < x) = exp(-K n exp(-lambda x)) (Karlin and Altschul): lambda comes from the scores of clean
tokens, K is the law's maximum-likelihood fit to the best segments of clean documents. A segment's nats over what chance
gives in a text of that length are comparable between texts; a text's score is a logistic function of its best segment's
excess (its asinh, so that a few long passages do not bend the fit), fitted on training documents.

Labels meet documents by id alone; of equal texts one is chosen before any text moves, and a bitmap keeps the texts of
others where they are. The plan is the same however many labels there are. Document counts cover all units of all
training documents, in one aggregation, and significance is tested there: the driver gets all significant units that
UNIT_DOCS toxic documents have, and no others. Calibration uses a share of the labelled documents, chosen by hash, that
is expected to hold FIT_DOCS at most.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import marked, small_batches, written

UNIT_DOCS, FIT_DOCS = 4, 20_000
#: Strength of the Dirichlet prior in documents; documents that a class's variance rests on at least; deviations that make
#: a unit significant; loss of other tokens; most that one token can give.
PRIOR, FLOOR, SIGNIFICANT, LOSS, MOST = 50.0, 0.5, 4.0, 0.4, 4.0
#: Excess over chance (in nats) from which a segment is reported: chance gives one to a clean text in 400.
PASSAGE = 6.0
WORD = re.compile(r"\w+")


def units(word: str) -> list[str]:
    """The word itself, and longer words' first six and four characters, marked."""
    return [word, *(f"{word[:k]}*" for k in (6, 4) if len(word) > k)]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """weights of units; lam and k of chance; slope and offset of the calibration."""

    weights: dict[str, float]
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = 0.0


class Scorer:
    """Scores of tokens by a model; remembers words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def scores(self, words: list[str]) -> np.ndarray:
        known, weights = self.known, self.model.weights
        if len(known) > 500_000:
            known.clear()
        for w in {w for w in words if w not in known}:
            own = [weights[u] for u in units(w) if u in weights]
            known[w] = max(own, key=abs) if own else -LOSS
        out = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        out[[i for i in range(1, len(words)) if words[i] == words[i - 1]]] = -LOSS
        return out

    def score(self, best: float, n: int) -> float:
        """Of a text of n tokens whose best segment has this score: 0 to 1."""
        x = self.model.slope * math.asinh(self.excess(best, max(1, n))) + self.model.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def excess(self, score: float, n: int) -> float:
        """Nats by which a segment's score exceeds what chance gives in n tokens."""
        return self.model.lam * score - math.log(max(self.model.k * n, 1e-9))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in order; linear time."""
    total = np.cumsum(scores)
    start, end, left, right, link = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        a, b, low, high = i, i + 1, float(total[i] - scores[i]), float(total[i])
        while True:
            j = len(start) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            a, low = start[j], left[j]
            for own in (start, end, left, right, link):
                del own[j:]
        start.append(a), end.append(b), left.append(low), right.append(high), link.append(j)
    return [(a, b, h - low) for a, b, low, h in zip(start, end, left, right, strict=True)]


def _counts(docs: DataFrame) -> DataFrame:
    """(unit, toxic, clean): documents of each class that have the unit. Counted in each task first."""

    def run(batches):
        found: dict[str, list[int]] = {}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), *(pa.array([n[k] for n in found.values()], pa.int64()) for k in (1, 0))], names=["unit", "toxic", "clean"])

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if toxic not in (0, 1):
                    continue
                for u in {u for w in set(WORD.findall((text or "").lower())) for u in units(w)}:
                    found.setdefault(u, [0, 0])[toxic] += 1
                if len(found) > 400_000:
                    yield flush()
                    found.clear()
        yield flush()

    return docs.select("toxic", "text").mapInArrow(run, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def weight(y1: int, y0: int, n1: int, n0: int) -> float | None:
    """Log-odds of a unit that y1 of n1 toxic and y0 of n0 clean documents have; none if it is not significant. The prior
    of a rare unit is a small part of a document; its variance is that of FLOOR documents, and does not grow beyond. A unit
    of all documents says nothing."""
    if y1 + y0 == n1 + n0:
        return None
    prior = PRIOR * (y1 + y0) / (n1 + n0)
    a, b = y1 + prior, y0 + prior
    odds = math.log(a / (n1 + PRIOR - a)) - math.log(b / (n0 + PRIOR - b))
    return max(-MOST, min(MOST, odds)) if abs(odds) / math.sqrt(1 / max(a, FLOOR) + 1 / max(b, FLOOR)) >= SIGNIFICANT else None


def _significant(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """(unit, weight) of the significant units."""

    def run(batches):
        for batch in batches:
            rows = [(u, w) for u, y1, y0 in zip(*(batch.column(c).to_pylist() for c in ("unit", "toxic", "clean")), strict=True) if (w := weight(y1, y0, n1, n0)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["unit", "weight"])

    return counts.where(F.col("toxic") >= UNIT_DOCS).mapInArrow(run, "unit string, weight double")


def _labelled(own: DataFrame, labels: DataFrame) -> DataFrame:
    """(hash, toxic, text): the labelled texts of own (doc_id, hash, text), each once, with its least doc_id's label."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.select("doc_id", "hash").hint("merge").join(marks.hint("merge"), "doc_id").groupBy("hash").agg(F.min(F.struct("doc_id", "toxic")).alias("first"))
    chosen = written(chosen.select("hash", "first.doc_id", "first.toxic"), "chosen")
    rows = marked(own, F.struct("hash", "doc_id"), chosen, F.struct("hash", "doc_id")).where("maybe").drop("maybe")
    return rows.hint("merge").join(chosen.hint("merge"), ["hash", "doc_id"]).groupBy("hash", "doc_id").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")).drop("doc_id")


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled documents that are not held out. Of documents with the same text the least doc_id
    counts. Null labels and texts are left out; documents with contradicting labels count as toxic. Without documents
    of both classes, the model scores every text alike."""
    own = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("hash", F.xxhash64("text"))
    found = written(_labelled(own, labels), "labelled")
    n1, n0 = found.agg(F.expr("count_if(toxic = 1)"), F.expr("count_if(toxic = 0)")).first()
    if not n1 or not n0:
        return Model({}, slope=0.0)
    model = Model({r["unit"]: r["weight"] for r in _significant(_counts(found), n1, n0).collect()})

    sample = found.where(F.pmod(F.xxhash64("hash"), F.lit(n1 + n0)) < FIT_DOCS).select("toxic", "text")

    def measure(batches):
        scorer = Scorer(model)
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = scorer.scores(WORD.findall(text.lower()))
                best = max((x[2] for x in maximal_segments(s)), default=0.0)
                values, n = np.unique(np.round(s, 1), return_counts=True)
                rows.append((toxic, len(s), best, values.tolist(), n.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.list_(pa.float64())), pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["toxic", "n", "best", "scores", "counts"])

    fit = written(sample.mapInArrow(measure, "toxic int, n long, best double, scores array<double>, counts array<long>"), "fit")
    share = fit.where("toxic = 0").select(F.explode(F.arrays_zip("scores", "counts")).alias("x")).groupBy("x.scores").agg(F.sum("x.counts").alias("n")).collect()  # scores are rounded: 100 values at most
    model.lam = decay([r["scores"] for r in share], [r["n"] for r in share])
    rows = fit.select("toxic", "n", "best").collect()  # about FIT_DOCS at most
    model.k = extremes(model.lam, [(r["n"], r["best"]) for r in rows if not r["toxic"]])
    scorer = Scorer(model)
    x = np.array([math.asinh(scorer.excess(r["best"], max(1, r["n"]))) for r in rows])
    model.slope, model.offset = logistic(x, np.array([r["toxic"] for r in rows], float))
    return model


def decay(scores: list[float], counts: list[int]) -> float:
    """lambda with sum p(s) exp(lambda s) = 1, by bisection; where no score is positive, or scores grow, 1."""
    p, s = np.array(counts, float), np.array(scores, float)
    if not len(s) or s.max() <= 0 or (p @ s) >= 0:
        return 1.0
    p /= p.sum()
    low, high = 1e-6, 1.0
    while p @ np.exp(high * s) < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return low


def extremes(lam: float, best: list[tuple[int, float]]) -> float:
    """K from (tokens, best segment's score) of clean documents: where the derivative of the log-likelihood is 0. A
    document without any segment says that its score is below what can be measured, and counts so. Smoothed by one
    document, so that K is positive."""
    met = sum(1 for _, x in best if x > 0)
    return (met + 1) / (sum(n * math.exp(-lam * x) for n, x in best) + 1 / 0.1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset of a penalised logistic fit, by Newton's method; the slope is not negative."""
    mean, scale = x.mean(), x.std() or 1.0
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    slope = max(0.0, w[0] / scale)
    return float(slope), float(w[1] - slope * mean)


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), n_passages, and passages:
    (start, end in code points, excess in nats) of every significant segment.

    A null or empty text has no tokens and gets the score of no toxic segment. Rows with the same doc_id, or null, are
    scored each on its own (null is not held out); other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # significant units alone
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64()), ("passages", passage)])

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                s = scorer.scores(WORD.findall(text.lower()))
                segments = maximal_segments(s)
                best = max((x[2] for x in segments), default=0.0)
                scores.append(scorer.score(best, len(s)))
                found = [(a, b, e) for a, b, v in segments if (e := scorer.excess(v, len(s))) >= PASSAGE]
                if found:
                    at = [m.span() for m in WORD.finditer(text.lower())]
                    found = [{"start": at[a][0], "end": at[b - 1][1], "excess": e} for a, b, e in found]
                passages.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(list(map(len, passages)), pa.int64()), pa.array(passages, passage)], schema=schema)

    out = f"doc_id {kind.simpleString()}, held_out boolean, score double, predicted int, n_passages long, passages array<struct<start:int,end:int,excess:double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, out)
