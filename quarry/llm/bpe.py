"""Byte-level BPE encoding and decoding by replaying the merges over a whole block of the corpus.

Per block of texts, the distinct pre-tokens that the worker has not met form one table of symbols. An inverted
index from token pair to the positions where it stands is kept in buckets by the pair's rank; the lowest rank is
applied at all its positions at once, and only the pairs that touch a merged symbol are looked up again.
Everything is local to a task: no shuffle, and a lost executor's task just runs again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.shared import blocks, chunk_pattern, small_batches

#: Chunks of text whose ids a worker remembers, bytes of text whose merges are replayed at once, and rows that join a
#: block together (over 32 MB of check_l a worker's peak is 174 MB with blocks of 1 MB and 201 with 2, but the smaller
#: ones take 15 % more time; it is 238 MB with whole batches of 1000 rows).
MEMORY, BLOCK, ROWS = 400_000, 2 << 20, 50


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def distinct(at: np.ndarray) -> np.ndarray:
    """The different values in order; by sorting, which beats hashing on the short runs that occur here."""
    at = np.sort(at)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


class MergeReplay:
    """Ids of many pre-tokens at once. A pre-token that is itself in the vocabulary gets its own id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(a << 32 | b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.keys, self.merged = np.array(sorted(pairs), np.int64).reshape(-1, 2).T.copy()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has no such merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def one(self, word: bytes) -> list[int]:
        """The same for one pre-token, step by step; for words where a merge makes an earlier-ranked pair."""
        ids = [self.ranks[bytes([b])] for b in word]
        token = [bytes([b]) for b in word]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: self.ranks.get(token[i] + token[i + 1], 1 << 60))
            rank = self.ranks.get(token[best] + token[best + 1])
            if rank is None:
                break
            token[best : best + 2] = [token[best] + token[best + 1]]
            ids[best : best + 2] = [rank]
        return ids

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and where each word's ids start; one entry more at the end."""
        own = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        whole = own >= 0
        lengths = np.where(whole, 1, np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(words) + 1, np.int64)
        word_of = np.repeat(np.arange(len(words)), lengths)
        token = np.empty(n, np.int64)
        token[ends[whole] - 1] = own[whole]
        token[~whole[word_of]] = self.of_byte[np.frombuffer(b"".join(w for w, x in zip(words, whole.tolist(), strict=True) if not x), np.uint8)]
        filled = lengths > 0
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        after[ends[filled] - 1] = -1
        before[(ends - lengths)[filled]] = -1
        pair = np.full(n, -1, np.int64)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        again: set[int] = set()

        def file(at: np.ndarray) -> np.ndarray:
            """Look up the pairs that start at these positions, and put those that merge into the index."""
            nxt = after[at]
            ranks = np.where(nxt >= 0, self.rank_of(token[at], token[nxt]), -1)
            pair[at] = ranks
            hit = ranks >= 0
            at, ranks = at[hit], ranks[hit]
            if len(at):
                order = np.argsort(ranks, kind="stable")
                at, sorted_ranks = at[order], ranks[order]
                cuts = np.flatnonzero(np.diff(sorted_ranks)) + 1
                for rank, part in zip(sorted_ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].append(part)
            return np.stack([at, ranks])

        file(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            at = distinct(np.concatenate(index.pop(rank)))
            at = at[pair[at] == rank]
            if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():
                # in a run like aaaa the leftmost pair merges first: every second position of the run
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.r_[True, ~chained], place, 0))
                at = at[(place - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            token[at] = rank
            alive[gone] = False
            pair[gone] = -1
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            left = before[at]
            changed, ranks = file(distinct(np.concatenate([at, left[left >= 0]])))
            if len(ranks) and (lower := ranks < rank).any():
                again.update(word_of[changed[lower]].tolist())
        kept = np.flatnonzero(alive)
        ids, owner = token[kept].astype(np.uint32), word_of[kept]
        starts = np.searchsorted(owner, np.arange(len(words) + 1))
        if again:
            parts = [np.array(self.one(words[i]), np.uint32) if i in again else ids[starts[i] : starts[i + 1]] for i in range(len(words))]
            ids, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, starts


class ChunkMemory:
    """Ids of the chunks that texts are made of. When it is full, what came in two blocks or more stays."""

    def __init__(self):
        self.chunks = chunk_pattern().findall
        self.ids: dict[str, bytes] = {}
        self.common: set[str] = set()

    def coded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks on end, and where each chunk's ids start; one entry more at the end."""
        raise NotImplementedError

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all of them learnt."""
        if len(self.ids) > MEMORY:
            self.ids, self.common = {c: self.ids[c] for c in self.common}, set()
        each = list(map(self.chunks, texts))
        block = set().union(*each)
        new = [c for c in block if c not in self.ids]
        self.common.update(block.difference(new))
        if new:
            ids, starts = self.coded(new)
            raw, cuts = ids.astype("<u4").tobytes(), (4 * starts).tolist()
            self.ids.update((c, raw[a:b]) for c, a, b in zip(new, cuts, cuts[1:], strict=False))
        return each

    def encode(self, texts: list[str]):
        """For each text: its ids."""
        for own in self.learn(texts):
            yield np.frombuffer(b"".join(map(self.ids.__getitem__, own)), "<u4")


class Encoder(ChunkMemory):
    """Texts to ids as a tiktoken Encoding does it, and back."""

    _made: dict[tuple, Encoder] = {}

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        super().__init__()
        ranks = read_ranks(ranks_path)
        self.replay, self.split = MergeReplay(ranks), regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.bytes_of}

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Encoder:
        """One per worker process."""
        if (ranks_path, pattern) not in cls._made:
            cls._made = {(ranks_path, pattern): cls(ranks_path, pattern)}
        return cls._made[ranks_path, pattern]

    def coded(self, chunks):
        """Merge replay over the pre-tokens of all these chunks together."""
        tokens = list(map(self.split, chunks))
        ids, starts = self.replay.encode([m.encode("utf-8", "surrogatepass") for each in tokens for m in each])
        return ids, starts[np.cumsum([0, *map(len, tokens)])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def small_blocks(batches):
    """doc_ids and texts of consecutive rows that hold about BLOCK bytes, however large the batches are."""
    few = (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))
    return blocks(few, ["doc_id", "text"], BLOCK)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256
    (of the bytes that the ids decode to), and with with_ids the ids.

    A null text counts as empty (no tokens). Rows with the same doc_id, or null, are encoded each on its own;
    other columns are ignored; an empty table gives an empty result. Ties don't arise. Texts of any length are
    encoded whole: a worker holds one block of texts (BLOCK, or one longer text) at a time.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        encoder = Encoder.of(ranks_path, pattern)
        for keys, texts in small_blocks(batches):
            rows = []
            for key, ids in zip(keys, encoder.encode([t or "" for t in texts]), strict=True):
                plain = ids.tolist()
                text = " ".join(map(encoder.decimal.__getitem__, plain))
                rows.append((key, len(plain), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(encoder.decode(plain)).hexdigest(), *[plain] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    out = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, out)
