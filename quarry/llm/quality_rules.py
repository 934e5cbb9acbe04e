r"""Quality rules on repetition, from suffix arrays over words.

The suffixes of all texts of a block are sorted together by prefix doubling: ranks of 1, 2, 4, ... words. The first
rank holds the text's number, so that suffixes of different texts never tie, and a suffix whose rank is unique is
settled and not sorted again; ordinary prose settles after a few words. From the ranks of each length, the longest
common prefix of neighbours follows by binary lifting. A suffix's deepest LCP interval is the larger one of the two
prefixes that it shares with its neighbours; that is the longest repeated substring that starts there, so the union of
those spans is the union of the spans of all maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.shared import blocks, small_batches

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
#: Blanks, and the bytes of UTF-8 that continue a character.
NO_CHARACTER = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50
#: The method's limits: repeats of REPEAT words or more may cover at most MAX_COVERED percent of a text's words, and
#: the longest repeat may have at most LONGEST words.
REPEAT, MAX_COVERED, LONGEST = 5, 40, 60


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word's place, the words of the longest substring that starts there and occurs elsewhere in the same
    text, too. words: numbers of the words, of all texts on end; text: the number of each place's text, ascending."""
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    end = np.searchsorted(text, text, "right")  # the text's end, for each place
    # ranks by one word; equal ranks have the smallest place of their group in sorted order
    order = np.lexsort((words, text))

    def ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return rank

    new = np.r_[True, (words[order[1:]] != words[order[:-1]]) | (text[order[1:]] != text[order[:-1]])]
    rank = ranked(order, new)
    levels = [rank]
    length = 1
    while True:
        tied = ~new | ~np.r_[new[1:], True]  # in sorted order: those in groups of two or more
        at = order[tied]
        if not len(at):
            break
        nxt = at + length
        tail = np.where(nxt < end[at], rank[np.minimum(nxt, n - 1)], -1)
        group = rank[at]
        within = np.lexsort((tail, group))
        place = np.flatnonzero(tied)
        order = order.copy()
        order[place] = at[within]
        new = new.copy()
        group, tail = group[within], tail[within]
        new[place] = np.r_[True, (group[1:] != group[:-1]) | (tail[1:] != tail[:-1])]
        rank = ranked(order, new)
        levels.append(rank)
        length *= 2
    # order is the suffix array; common prefixes of neighbours, by the longest equal power first
    a, b = order[:-1], order[1:]
    same = text[a] == text[b]
    a, b = a[same].copy(), b[same].copy()
    start_a, start_b = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a + (1 << k) <= end[start_a]) & (b + (1 << k) <= end[start_b])
        equal = inside.copy()
        equal[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        a[equal] += 1 << k
        b[equal] += 1 << k
    np.maximum.at(best, start_a, a - start_a)
    np.maximum.at(best, start_b, a - start_a)
    return best


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which places lie in a span [p, p + lengths[p])."""
    n = len(lengths)
    reach = np.maximum.accumulate(np.where(lengths > 0, np.arange(n) + lengths, 0))
    return reach > np.arange(n)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures of each text (UTF-8)."""
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D
    n = np.array([len(w) for w in split])
    words = np.array([numbers.setdefault(w, len(numbers)) for own in split for w in own], np.int64)
    text = np.repeat(np.arange(len(texts)), n)
    longest = longest_repeats(words, text)
    # a span never leaves its text, so that the running reach needs no reset between texts
    per_text = lambda flags: np.bincount(text[flags], minlength=len(texts))
    chars = np.array([len(t.translate(None, NO_CHARACTER)) for t in texts], np.int64)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, text, longest)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n.astype(np.int64),
        "word_chars": chars,
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": per_text(covered(np.where(longest >= WINDOW, WINDOW, 0))),
        "n_covered": per_text(covered(np.where(longest >= REPEAT, longest, 0))),
        "longest_repeat": most,
    }


def verdicts(m: dict[str, np.ndarray], repeat_percent: int = MAX_COVERED, longest: int = LONGEST) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return {"base_failed": failed, "kept": ~failed & (100 * m["n_covered"] <= repeat_percent * m["n_words"]) & (m["longest_repeat"] <= longest)}


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the figures, base_failed and kept.

    A null or empty text has no words and fails. Rows with the same doc_id, or null, are judged each on its own; an
    empty table gives an empty result; other columns are ignored. Texts of any length are judged whole.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((c, pa.int64()) for c in FIGURES), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(batches):
        for keys, texts in blocks(batches, ["doc_id", "text"], 4 << 20):
            m = measure([t or b"" for t in texts])
            m |= verdicts(m)
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), *(pa.array(m[c]) for c in schema.names[1:])], schema=schema)

    out = f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in FIGURES) + ", base_failed boolean, kept boolean"
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(run, out)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; a row's verdict is made where the row is."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            kept, i = [], 0
            while i < len(texts):  # parts of bounded size
                j, size = i, 0
                while j < len(texts) and size < 4 << 20:
                    size += len(texts[j] or b"")
                    j += 1
                kept.append(verdicts(measure([t or b"" for t in texts[i:j]]))["kept"])
                i = j
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(run, docs.schema)
