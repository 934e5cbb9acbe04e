"""Table functions for SQL that hold an open chunk from row to row."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from quarry.functions import text as X
from quarry.functions import values as V

_SPACE = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", X.SPACE)
_RUN, _ENDS, _ASCII = re.compile(f"{_SPACE}+", re.A), re.compile(rf"\A{_SPACE}+|{_SPACE}+\Z", re.A), re.A


def _trim(text: str) -> str:
    return _ENDS.sub("", text)


def _cut(text: str, target: int) -> Iterator[str]:
    """Sentences up to the target; a longer run at its last space before it."""
    held = ""
    for sentence in re.split(r"(?<=[.!?])\s+", text, flags=_ASCII) if len(text) > target else [text]:
        if held and len(held) + len(sentence) + 1 > target:
            yield held
            held = ""
        held = f"{held} {sentence}" if held else sentence
        while len(text) > target and len(held) > target:
            space = held.rfind(" ", 1, target + 1)
            yield held[: space if space > 0 else target]
            held = held[space + 1 if space > 0 else target :]
    if held:
        yield held


def _pieces(text: str | None, target: int) -> Iterator[str]:
    for block in re.split(r"\n\s*\n+", text or "", flags=_ASCII):
        block = _trim(_RUN.sub(" ", re.sub(r"-\n([a-z])", r"\1", block)))
        if block:
            yield from _cut(block, target)


class ChunkPages:
    """Rows (id, page, text), by position, to chunks (id, chunk_index, text, page_start, page_end): those of
    chunking.chunk_documents. Rows of an id come together and in order of their pages (texts, on one page); null and empty
    texts have no pieces. Only an id's open chunk is held."""

    def __init__(self):
        self.id, self.n, self.open, self.start, self.end, self.done = None, 0, "", None, None, []

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or len(pages.dataType.fields) < 3:
            raise ValueError("quarry_chunk_pages takes a table of id, page and text")
        own, page, text = (f.name for f in pages.dataType.fields[:3])
        out = StructType().add("id", pages.dataType.fields[0].dataType).add("chunk_index", IntegerType()).add("text", StringType()).add("page_start", IntegerType()).add("page_end", IntegerType())
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(own)], orderBy=[OrderingColumn(page), OrderingColumn(text)])

    def _close(self) -> None:
        text = _trim(self.open)
        self.done.append((self.id, self.n, text, self.start, self.end))
        self.n += 1

    def eval(self, row) -> Iterator[tuple]:
        self.id, page = row[0], row[1]
        for piece in _pieces(row[2], V.UPLOAD_CHARS):
            if self.open and len(self.open) + len(piece) + 2 > V.UPLOAD_CHARS:
                self._close()
                tail = re.sub(r"\A\S*\s", "", self.open[-V.UPLOAD_OVERLAP :], count=1, flags=_ASCII)
                self.open, self.start = tail, self.end if tail else page
            elif self.start is None:
                self.start = page
            self.open = f"{self.open}\n\n{piece}" if self.open else piece
            self.end = page
        yield from self.done
        self.done = []

    def terminate(self) -> Iterator[tuple]:
        if _trim(self.open):
            self._close()
        yield from self.done


def register(spark: SparkSession) -> str:
    """quarry_chunk_pages(TABLE(...)) for this session's SQL."""
    spark.udtf.register("quarry_chunk_pages", F.udtf(ChunkPages, useArrow=True))
    return "quarry_chunk_pages"
