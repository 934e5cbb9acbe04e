"""Token ids in shard files of independent zstandard frames with a trailing seek table.

Layout of a shard, integers little-endian:
  frames      zstandard frames, each with a content checksum; together the ids of the shard's documents on end
  index       a skippable frame (0x184D2A5D): zstandard-packed entries of (doc_id int64, is_null uint8, n_tokens int64)
              in the order of the documents
  seek table  a skippable frame (0x184D2A5E) as in the public seekable format: per frame its packed size, its plain
              size and the low 32 bits of the XXH64 of its plain bytes, all uint32; then the number of frames
              (uint32), a descriptor byte (0x80: with checksums) and 0x8F92EAB1
Ordinary zstandard tools unpack the ids and skip the rest. A reader takes the last bytes, then only the frames that
hold the documents that it wants.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.shared import shared_folder, small_batches

#: Fixed values of the seekable format, and of our index frame.
SEEK_MAGIC, SEEK_END, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
#: Chunks of text that the tokenizer gets as one, bytes of chunks and ids that a worker remembers, and bytes of a block.
JOINED, MEMORY, BLOCK = 200, 32 << 20, 8 << 20
ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n", "<i8")])


def parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a large string or binary array start in its bytes, with the end of the last; and those bytes."""
    if not len(array):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def text_blocks(batches):
    """doc_ids and texts, as an Arrow array, of consecutive rows whose texts hold about BLOCK bytes."""
    keys, texts, size = [], [], 0
    for batch in batches:
        keys += batch.column("doc_id").to_pylist()
        texts.append(batch.column("text").cast(pa.large_string()))
        size += batch.nbytes
        if size >= BLOCK:
            yield keys, pa.concat_arrays(texts)
            keys, texts, size = [], [], 0
    if keys:
        yield keys, pa.concat_arrays(texts)


class FastTokenizer:
    """The tokenizers library, asked once for each chunk of text; documents are put together from the chunks.

    Chunks stay in Arrow arrays from the text to the ids: no Python object stands for a word. The chunks met so far are
    remembered, and when they fill MEMORY bytes, what came in two blocks or more stays."""

    _made: dict[str, FastTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors run tasks side by side as it is
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True  # the text of a special token is ordinary text
        # what this library's pattern takes for white space: two of it in a row come apart
        apart = lambda c: len(self.own.pre_tokenizer.pre_tokenize_str(f"a{c}{c}a")) == 4 or c == " "
        spaces = [c.encode("utf-8") for c in map(chr, range(0x3001)) if apart(c)]
        # letters and digits of ASCII 0, white space of ASCII 2, the rest of ASCII 1; no cut stands beside other characters' bytes
        self.right = np.array([0 if b > 127 or chr(b).isalnum() else 2 if bytes([b]) in spaces else 1 for b in range(256)], np.uint8)
        self.left = np.where(np.arange(256) > 127, 2, self.right).astype(np.uint8)
        self.wide = [np.array([int.from_bytes(c, "big") for c in spaces if len(c) == n]) for n in (2, 3)]
        # bytes of each id: a byte-level vocabulary has a character for each byte
        vocabulary = self.own.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.seen, self.ids, self.common = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    @classmethod
    def of(cls, path: str) -> FastTokenizer:
        """One per worker process."""
        if path not in cls._made:
            cls._made = {path: cls(path)}
        return cls._made[path]

    def inked(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether the characters that end at these bytes are no white space."""
        two = data[last - 1].astype(np.int64) << 8 | data[last]
        three = data[last - 2].astype(np.int64) << 16 | two
        wide = data[last] > 127
        return np.where(wide, ~(np.isin(two, self.wide[0]) | np.isin(three, self.wide[1])), self.left[data[last]] < 2)

    def cut(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where chunks start: at these firsts, at white space after another character, and at another mark after a letter or
        digit (of ASCII). No alternative of the byte-level pattern reaches over such a place: what reaches white space
        starts at it, and a word or number ends where its class ends."""
        starts = np.zeros(len(data), bool)
        np.less(self.left[data[:-1]], self.right[data[1:]], out=starts[1:])
        if len(data) and data.max() > 127:
            last = np.flatnonzero((data[:-1] > 127) & (self.right[data[1:]] == 2))
            starts[last[self.inked(data, last)] + 1] = True
        starts[firsts] = True
        return np.flatnonzero(starts)

    def coded(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """An order of the chunks, and the ids of each as bytes, in that order. Chunks that can follow each other and stay
        apart (see cut) are encoded by the hundred, as one text, and their ids told apart by the bytes that they stand
        for; the others one by one, as they would run into their neighbours."""
        bounds, data = parts(chunks)
        first, last = self.right[data[bounds[:-1]]], bounds[1:] - 1
        mark = (first == 1) & (self.left[data[last]] == 0)
        space = (first == 2) & self.inked(data, last)
        kind = np.where(space, 2, np.where(mark, 1, 0))
        order = np.argsort(kind, kind="stable")
        bounds, data = parts(chunks.take(order))
        alone = int(np.count_nonzero(kind == 0))
        ends = bounds[[*range(alone), *range(alone, len(chunks), JOINED), len(chunks)]].tolist()
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(ends, ends[1:], strict=False)]
        ids: list[np.ndarray] = []
        for a in range(0, len(texts), 1000):
            ids += [np.array(e.ids, "<u4") for e in self.own.encode_batch_fast(texts[a : a + 1000], add_special_tokens=False)]
        flat = np.concatenate(ids)
        starts = np.searchsorted(np.cumsum(self.bytes_of[flat]), bounds, "right")
        return order, pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(4 * starts), pa.py_buffer(flat)])

    def learn(self, chunks: pa.Array) -> np.ndarray:
        """The places in self.ids of these different chunks, all of them learnt."""
        if self.seen.nbytes + self.ids.nbytes > MEMORY:
            kept = pa.array(self.common)
            self.seen, self.ids = self.seen.filter(kept), self.ids.filter(kept)
            self.common = np.zeros(len(self.seen), bool)
        place = pc.fill_null(pc.index_in(chunks, value_set=self.seen), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.common[place[place >= 0]] = True
        new = np.flatnonzero(place < 0)
        if len(new):
            order, ids = self.coded(chunks.take(new))
            place[new[order]] = len(self.seen) + np.arange(len(new))
            self.seen, self.ids = pa.concat_arrays([self.seen, chunks.take(new[order])]), pa.concat_arrays([self.ids, ids])
            self.common = np.append(self.common, np.zeros(len(new), bool))
        return place

    def encode(self, texts: pa.Array):
        """For each of these texts (large_string): its ids. A null counts as empty."""
        at, data = parts(texts.fill_null(""))
        starts = self.cut(data, at[:-1][at[1:] > at[:-1]])
        bounds = np.append(starts, len(data))
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        place = self.learn(chunks.dictionary)
        ends, raw = parts(self.ids.take(place[chunks.indices.to_numpy()]))
        flat, cuts = raw.view("<u4"), (ends[np.searchsorted(starts, at)] // 4).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield flat[a:b]


class ShardWriter:
    """Frames of about frame_bytes of plain ids; a document may span frames."""

    def __init__(self, out, kind: str, frame_bytes: int = 1 << 18):
        self.out, self.kind, self.frame_bytes = out, np.dtype(kind), frame_bytes
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.held, self.size, self.frames, self.entries = [], 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids.astype(self.kind).tobytes())
        self.size += len(self.held[-1])
        while self.size >= self.frame_bytes:
            plain = b"".join(self.held)
            self.flush(plain[: self.frame_bytes])
            self.held = [plain[self.frame_bytes :]]
            self.size = len(self.held[0])

    def flush(self, plain: bytes) -> None:
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.size:
            self.flush(b"".join(self.held))
        index = self.pack.compress(np.array(self.entries, ENTRY).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()


class ShardReader:
    """Random access to the documents of a shard: file is seekable."""

    def __init__(self, file, kind: str):
        self.file, self.kind, self.unpack = file, np.dtype(kind), zstandard.ZstdDecompressor()
        file.seek(0, 2)
        size = file.tell()
        n, _, end = struct.unpack("<IBI", self._at(size - 9, 9))
        if end != SEEK_END:
            raise ValueError("no seek table")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = np.frombuffer(table, "<u4").reshape(n, 3)
        self.packed_at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        self.plain_at = np.concatenate([[0], np.cumsum(self.frames[:, 1], dtype=np.int64)])
        magic, length = struct.unpack("<II", self._at(int(self.packed_at[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index")
        self.index = np.frombuffer(self.unpack.decompress(self._at(int(self.packed_at[-1]) + 8, length)), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.index["n"])])
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            plain = self.unpack.decompress(self._at(int(self.packed_at[k]), int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, plain)
        return self.last[1]

    def ids(self, place: int) -> np.ndarray:
        """Ids of the document at this place of the index; unpacks only the frames that hold it."""
        a, b = (int(x) * self.kind.itemsize for x in self.starts[place : place + 2])
        parts, k = [], bisect_right(self.plain_at, a) - 1
        while a < b:
            start, end = int(self.plain_at[k]), int(self.plain_at[k + 1])
            parts.append(self.frame(k)[a - start : min(b, end) - start])
            a, k = end, k + 1
        return np.frombuffer(b"".join(parts), self.kind)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, kind: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Write shards in ascending doc_id order (null first, equal ids by the hash of their text) and return (path, documents,
    ids) of each, in order.

    kind is the width of an id in the files ("<u2" holds vocabularies below 65,536). Documents are dealt by ranges of
    doc_id, hash and a number that tells rows alike in both, so that shards follow each other and no id, null neither, is
    bound to one task; a shard is written under a name of its task's attempt and then renamed,
    so that a lost or repeated task leaves whole files only. What comes to the driver is a row per shard.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        from pyspark import TaskContext

        fast, context, writer, total, n = FastTokenizer.of(tokenizer_path), TaskContext.get(), None, 0, 0
        fs, base = _open(folder)
        name = f"{base}/shard-{context.partitionId():06d}.ids.zst"
        part = f"{name}.{context.taskAttemptId()}.part"
        for keys, texts in text_blocks(batches):
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = ShardWriter(fs.open_output_stream(part, compression=None), kind)
            for key, ids in zip(keys, fast.encode(texts), strict=True):
                writer.add(key, np.append(ids, np.uint32(end_id)))
                total, n = total + len(ids) + 1, n + 1
        if writer is not None:
            writer.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [f"{folder}/{name.rpartition('/')[2]}"], "docs": [n], "ids": [total]})

    dealt = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text", f"xxhash64(`{text_col}`) AS hash", "monotonically_increasing_id() % 1024 AS alike")
    dealt = dealt.repartitionByRange("doc_id", "hash", "alike").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    shards = dealt.mapInArrow(run, "shard long, path string, docs long, ids long").collect()
    return [(r.path, r.docs, r.ids) for r in sorted(shards, key=lambda r: r.shard)]


def read_token_files(spark: SparkSession, shards: list[tuple[str, int, int]], kind: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of
    all its ids as unsigned 32-bit integers), and with with_ids the ids. Each shard is read by a task of its own."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                fs, own = _open(path)
                with fs.open_input_file(own) as file:
                    shard = ShardReader(file, kind)
                    for a in range(0, len(shard.index), 2000):
                        rows = []
                        for i in range(a, min(a + 2000, len(shard.index))):
                            ids, (key, null, n) = shard.ids(i), shard.index[i].item()
                            rows.append((None if null else key, first + int(shard.starts[i]), n, zlib.crc32(ids.astype("<u4").tobytes()), *[ids.astype(np.int32)] * with_ids))
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    firsts = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).tolist()
    rows = [(path, first) for (path, _, _), first in zip(shards, firsts, strict=False)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "path string, first long")
    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write the files to the shared folder, and return what reading them back gives.

    A null text counts as empty: its only id is the end id. Documents without an id come first; rows with the same
    doc_id follow each other in the order of their texts' hashes. An empty table gives no file and no row. Other columns are
    ignored.
    """
    folder = shared_folder(docs.sparkSession)
    folder = f"{folder if '://' in folder else 'file://' + folder}/tokens"
    return read_token_files(docs.sparkSession, write_token_files(docs, folder, tokenizer_path, end_id, id_col=id_col, text_col=text_col))
