r"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on a text. Documents are counted by their pattern of votes (at most
3 ** labellers patterns, so that what reaches the driver is bounded); expectation-maximisation over all patterns
estimates each labeller's accuracy and the posterior of "good" for every pattern. Posteriors then train a linear
scorer over hashed features (words, word shapes and pairs of shapes), so that texts are told apart by more than the
labellers look at.

Votes are counted over all documents. The scorer learns from a share of the documents, chosen by hash, that is expected
to hold FIT_DOCS at most: workers learn on their part, and their weights are averaged, position by position.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import small_batches, written

FIT_DOCS, WIDTH, EPOCHS, RATE = 10_000, 1 << 16, 3, 0.5
GOOD, BAD, NONE = 1, 0, 2
SYMBOLS = b"#*$%&|<>{}[]\\^~="
#: A word that ends as prose does: in a letter or digit, with one mark after it at most.
PLAIN = re.compile(rb"[A-Za-z0-9\x80-\xff][.,;:?!\"')]?(?=[ \t-\r]|$)")
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LABELLERS = 12
END = (b".", b"!", b"?", b'"', b":", b"\xe2\x80\xa6")


def votes(text: bytes) -> list[int]:
    """A vote of each labeller on a text (UTF-8)."""
    words = text.split()
    n = len(words)
    if not n:
        return [NONE] * (LABELLERS - 1) + [BAD]
    between = lambda x, good, bad: GOOD if x <= good else BAD if x >= bad else NONE
    upper, lower = (len(text) - len(text.translate(None, letters)) for letters in (UPPER, LOWER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    different, symbols = len(set(words)), len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.decode("utf-8", "replace"))
    black = len(text.translate(None, b" \t\n\r\x0b\x0c"))
    return [
        between(symbols / n, 0.02, 0.25),
        between(1 - len(text.translate(None, NOT_LETTERS)) / black, 0.1, 0.2),
        between(1 - len(PLAIN.findall(text)) / n, 0.05, 0.3),
        between(upper / max(1, upper + lower), 0.2, 0.5) if upper + lower >= 10 else NONE,
        between(1 - different / n, 0.5, 0.7) if n >= 20 else NONE,
        between(sum(map(bytes.__eq__, words, words[1:])) / n, 0.02, 0.1),
        between(max(Counter(words).values()) / n, 0.12, 0.2) if n >= 20 else NONE,
        between(1 - len(set(lines)) / len(lines), 0.1, 0.3) if len(lines) >= 3 else NONE,
        between(text.count(b"!") / n, 0.03, 0.2),
        GOOD if 3 <= chars / n <= 11 else BAD if chars / n < 2 or chars / n > 16 else NONE,
        between(1 - sum(x.rstrip().endswith(END) for x in lines) / len(lines), 0.4, 0.9) if n >= 20 else NONE,
        GOOD if n >= 50 else BAD if n < 3 else NONE,
    ]


@dataclass
class Labellers:
    """prior of good; chance[y][j][v]: that labeller j, if it votes, votes v on a text of class y."""

    prior: float
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Of good, for each row of votes."""
        j = np.arange(patterns.shape[1])
        logs = [np.log(p) + np.log(self.chance[y, j, patterns]).sum(axis=1) for y, p in ((BAD, 1 - self.prior), (GOOD, self.prior))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Labellers:
    """Expectation-maximisation from the majority of votes; counts are smoothed by one."""
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    p = (good + 1.0) / (good + 2.0 * bad + 2.0)
    model = None
    for _ in range(rounds):
        chance = np.ones((2, patterns.shape[1], 3))  # of no vote, too: it says nothing
        for y, w in ((BAD, counts * (1 - p)), (GOOD, counts * p)):
            for v in (BAD, GOOD):
                chance[y, :, v] = w @ (patterns == v) + 1
        chance[:, :, :NONE] /= chance[:, :, :NONE].sum(axis=2, keepdims=True)
        model = Labellers(float(np.clip(counts @ p / counts.sum(), 0.01, 0.99)), chance)
        new = model.posterior(patterns)
        if abs(new - p).max() < 1e-9:
            break
        p = new
    return model


_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[0-9]+"), b"9")]


def _bucket(feature: bytes) -> int:
    return zlib.crc32(feature) & (WIDTH - 1)


class Features:
    """Hashed features of texts; remembers words."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and weights: shares of the text's words, shapes and pairs of shapes, and of length."""
        words = text.split()
        if not words:
            return np.array([_bucket(b"empty")]), np.array([1.0])
        if len(self.known) > 300_000:
            self.known.clear()
        for w in {w for w in words if w not in self.known}:
            shape = w
            for pattern, to in _SHAPES:
                shape = pattern.sub(to, shape)
            self.known[w] = (_bucket(b"w" + w.lower()), zlib.crc32(shape[:12]))
        pairs = np.array(list(map(self.known.__getitem__, words)), np.int64)
        shape = pairs[:, 1]
        double = (shape[:-1] * 31 + shape[1:] * 17 + 7) & (WIDTH - 1)
        at, n = np.unique(np.concatenate([pairs[:, 0], shape & (WIDTH - 1), double]), return_counts=True)
        weight = np.sqrt(n / len(words))
        return np.append(at, _bucket(b"length%d" % len(words).bit_length())), np.append(weight, 1.0)


@dataclass
class Model:
    labellers: Labellers
    weights: np.ndarray
    offset: float

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.array([self.weights[at] @ w for at, w in found]) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(found: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression towards soft labels, by adaptive gradient steps, text by text."""
    weights, squares, offset, offset_squares = np.zeros(WIDTH), np.full(WIDTH, 1e-3), 0.0, 1e-3
    for _ in range(EPOCHS):
        for (at, w), y in zip(found, target.tolist(), strict=True):
            error = 1 / (1 + np.exp(-np.clip(weights[at] @ w + offset, -30, 30))) - y
            gradient = error * w
            squares[at] += gradient * gradient
            weights[at] -= RATE * gradient / np.sqrt(squares[at])
            offset_squares += error * error
            offset -= RATE * error / np.sqrt(offset_squares)
    return weights, offset


def train(docs: DataFrame, text_col: str = "text") -> Model | None:
    """Labellers' accuracies from all documents, and the scorer; None if there are no documents."""
    small_batches(docs.sparkSession)
    texts = docs.selectExpr(f"CAST(`{text_col}` AS BINARY) AS text")

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            found.update(tuple(votes(t or b"")) for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict({"votes": pa.array(list(found), pa.list_(pa.int32())), "n": pa.array(found.values(), pa.int64())})

    rows = texts.mapInArrow(count, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # 3 ** labellers at most
    if not rows:
        return None
    rows.sort(key=lambda r: r["votes"])
    total = sum(r["n"] for r in rows)
    labellers = estimate(np.array([r["votes"] for r in rows]), np.array([r["n"] for r in rows], float))

    def learn(batches):
        features, found, seen = Features(), [], []
        for batch in batches:
            for t in batch.column("text").to_pylist():
                found.append(features.of(t or b""))
                seen.append(votes(t or b""))
        if found:
            weights, offset = fitted(found, labellers.posterior(np.array(seen)))
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1), pa.int32()), "w": np.append(weights[at], offset) * len(found), "n": pa.array(np.full(len(at) + 1, len(found)), pa.int64())})

    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(total)) < FIT_DOCS).repartition(8)
    parts = written(chosen.mapInArrow(learn, "at int, w double, n long"), "weights")
    weights, offset = np.zeros(WIDTH), 0.0
    learnt = parts.where("at = -1").agg(F.sum("n")).first()[0] or 1
    for r in parts.groupBy("at").agg(F.sum("w").alias("w")).collect():  # WIDTH at most
        if r["at"] < 0:
            offset = r["w"] / learnt
        else:
            weights[r["at"]] = r["w"] / learnt
    return Model(labellers, weights, offset)


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, posterior (of good, from the votes), score (of the hashed scorer) and kept
    (score >= least).

    A null text counts as empty. Rows with the same doc_id, or null, are scored each on its own; other columns are
    ignored; an empty table gives an empty result. Whole texts are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # WIDTH weights
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        features, model = Features(), shared.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            if not texts:
                continue
            score = model.scores(list(map(features.of, texts)))
            posterior = model.labellers.posterior(np.array(list(map(votes, texts))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(posterior), pa.array(score), pa.array(score >= least)], schema=schema)

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(run, f"doc_id {kind.simpleString()}, posterior double, score double, kept boolean")
