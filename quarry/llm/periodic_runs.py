r"""Periodic runs of words: difference-cover LCE and a harmonic grid.

A run of period q is a stretch of words in which words q apart are identical, at least max(6, 4 * q) long, that no
neighbouring word extends. A run of length L gives L - q places i with word i equal to word i + q, on end; so for each
period p a grid of step max(6, 4 * p) - p has a place in every run of it. The grids of all periods have about
n / 3 * ln(n / 4) places for a text of n words. From each place whose two words are equal, the run is what the longest
common extensions (LCE) to both sides give.

LCE: places whose number modulo COVER is in DIFFERENCES are samples; any two places have a distance below COVER at which
both are samples. So fewer than COVER words are compared, and what is still equal then is the common prefix of two
sampled suffixes: the least of the LCP values between their ranks, by a sparse table. Only samples are sorted, by words
up to COVER, then by prefix doubling in steps of COVER; and only in texts where a comparison comes as far as samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.shared import blocks, small_batches

#: A run's least length, and its least number of periods.
LEAST, PERIODS = 6, 4
#: A perfect difference set: each remainder of COVER but 0 is the difference of two of these.
COVER, DIFFERENCES = 31, (1, 5, 11, 24, 25, 27)
#: Places of the grid that are looked at together.
GRID = 1 << 20

_SLOT = np.full(COVER, -1)
_SLOT[list(DIFFERENCES)] = np.arange(len(DIFFERENCES))
_MEET = np.array([[min(k for k in range(COVER) if _SLOT[(a + k) % COVER] >= 0 and _SLOT[(b + k) % COVER] >= 0) for b in range(COVER)] for a in range(COVER)])


def agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, up to `most`."""
    got = most.copy()
    open_ = np.arange(len(a))
    for k in range(int(most.max(initial=0))):
        open_ = open_[most[open_] > k]
        same = words[a[open_] + k] == words[b[open_] + k]
        got[open_[~same]] = k
        open_ = open_[same]
    return got


class SampledSuffixes:
    """Common prefixes of sampled suffixes of the same text. words: those of many texts, each followed by -1; text: the
    number of each place's text; wanted: the places whose texts are looked at."""

    def __init__(self, words: np.ndarray, text: np.ndarray, wanted: np.ndarray):
        in_use = np.zeros(int(text.max()) + 2, bool)
        in_use[text[wanted]] = True
        at = np.flatnonzero((_SLOT[np.arange(len(words)) % COVER] >= 0) & in_use[text])
        span = len(words) // COVER * len(DIFFERENCES) + len(DIFFERENCES)
        number = self.number(at)
        n, wide = len(at), int(words.max()) + 2
        # rank by text, then word by word, then by ranks of COVER, 2 * COVER, ... words; only what is tied is sorted on
        group, key = text[at].astype(np.int64), words[at]
        order = np.argsort(group * wide + key + 1)
        new = np.r_[True, (group[order[1:]] != group[order[:-1]]) | (key[order[1:]] != key[order[:-1]])]
        rank, levels, length = np.zeros(span, np.int64), [], 1
        while True:
            rank[number[order]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            if length >= COVER:
                levels.append(rank.copy())
            tied = ~new | ~np.r_[new[1:], True]
            if not tied.any() and length >= COVER:
                break
            place = np.flatnonzero(tied)
            own = order[place]
            group = rank[number[own]]
            if length < COVER:
                key, width = words[at[own] + length] + 1, wide
            else:
                key, width = levels[-1][number[own] + length // COVER * len(DIFFERENCES)], n
            within = np.argsort(group * width + key)
            order[place], group, key = own[within], group[within], key[within]
            if len(place):
                new[place] = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
            length = length + 1 if length < COVER else 2 * length
        self.rank = levels[-1]
        # LCP of neighbours: the longest equal powers first, then words
        a, b = order[:-1], order[1:]
        same = np.flatnonzero(text[at[a]] == text[at[b]])
        x, y, shared = number[a[same]], number[b[same]], np.zeros(len(same), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            equal = levels[k][x] == levels[k][y]
            shared[equal] += COVER << k
            x[equal] += len(DIFFERENCES) << k
            y[equal] += len(DIFFERENCES) << k
        rest = agreement(words, at[a[same]] + shared, at[b[same]] + shared, np.full(len(same), COVER))
        lcp = np.zeros(n, np.int32)
        lcp[same + 1] = shared + rest
        self.least = [lcp]
        most = int(np.bincount(text[at]).max(initial=1))  # no query spans more samples than a text has
        while 2 << (len(self.least) - 1) <= most:
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last, np.r_[last[half:], np.zeros(half, np.int32)]) if half < n else last)
        self.table = np.stack(self.least)

    @staticmethod
    def number(at: np.ndarray) -> np.ndarray:
        """Samples are numbered by place, so that the sample COVER words on has a number len(DIFFERENCES) larger."""
        return at // COVER * len(DIFFERENCES) + _SLOT[at % COVER]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """LCE of samples at a and b, which are of one text and differ."""
        x, y = self.rank[self.number(a)], self.rank[self.number(b)]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level) + 1]).astype(np.int64)


def extensions(words: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCE of the places a and b of one text each."""
    meet = _MEET[a % COVER, b % COVER]
    got = agreement(words, a, b, meet)
    on = np.flatnonzero(got == meet)
    # a word on, most have ended: suffixes are sorted for the texts of the others alone
    on = on[words[a[on] + meet[on]] == words[b[on] + meet[on]]]
    if len(on):
        got[on] += SampledSuffixes(words, text, a[on]).common(a[on] + meet[on], b[on] + meet[on])
    return got


def grid(starts: np.ndarray, n: np.ndarray):
    """(places, periods) of all grids, a bounded number at a time. n: words of each text."""
    order = np.argsort(-n, kind="stable")
    starts, n = starts[order], n[order]
    periods = np.arange(1, int(n[0]) // PERIODS + 1) if len(n) and n[0] >= LEAST else np.zeros(0, np.int64)
    if not len(periods):
        return
    least = np.maximum(LEAST, PERIODS * periods)
    texts = np.searchsorted(-n, -least, "right")  # so many texts are long enough
    step = least - periods
    load = np.cumsum(np.cumsum(n)[texts - 1] // step + texts)
    cuts = np.searchsorted(load, np.arange(GRID, load[-1] + GRID, GRID), "right")
    begin = 0
    for end in np.unique(np.maximum(cuts, 1)):
        k = np.arange(begin, end)
        if len(k):
            which = np.repeat(k, texts[k])
            own = np.arange(len(which)) - np.repeat(np.cumsum(texts[k]) - texts[k], texts[k])
            many = -(-(n[own] - periods[which]) // step[which])
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield np.repeat(starts[own], many) + nth * np.repeat(step[which], many), np.repeat(periods[which], many)
        begin = end


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts (each an array of word numbers from 0), ordered by text, start
    and period."""
    n = np.array([len(t) for t in texts], np.int64)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(n) or n.max() < LEAST:
        return none
    gap = np.array([-1], np.int64)
    words = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    starts = 1 + np.cumsum(n + 1) - (n + 1)
    found = []
    for at, period in grid(starts, n):
        hit = words[at] == words[at + period]
        found.append((at[hit], period[hit]))
    a, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # of most, the words beside say that the stretch ends within LEAST words
    ahead = agreement(words, a, a + period, np.full(len(a), LEAST))
    back = words[::-1]
    size = len(words)
    behind = agreement(back, size - a, size - a - period, np.full(len(a), LEAST))
    may = (ahead == LEAST) | (behind == LEAST) | (ahead + behind + period >= np.maximum(LEAST, PERIODS * period))
    a, period = a[may], period[may]
    if not len(a):
        return none
    text = np.repeat(np.arange(len(n)), n + 1)
    ahead = extensions(words, np.r_[0, text], a, a + period)
    behind = extensions(back, np.r_[text, len(n) - 1][::-1], size - a, size - a - period)
    start, end = a - behind, a + period + ahead
    may = end - start >= np.maximum(LEAST, PERIODS * period)
    start, end, period = start[may], end[may], period[may]
    # a stretch of period q has the periods 2q, 3q, ... as well: the least is its own
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    own = np.searchsorted(starts, start, "right") - 1
    return own, start - starts[own], end - start, period


def planted(n: int, doc_id) -> np.ndarray | None:
    """Where each word of a text of n words comes from, if the contract makes its tail periodic; else none."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


FIGURES = ("start", "length", "period", "exponent_milli")


def measure(keys: list, texts: list[bytes], plant: bool) -> dict[str, list]:
    numbers = defaultdict(count().__next__)  # each new word takes the next number
    split = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D
    source = [planted(len(w), k) if plant else None for w, k in zip(split, keys, strict=True)]
    ids = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in split]
    ids = [x if s is None else x[s] for x, s in zip(ids, source, strict=True)]
    text, start, length, period = find_runs(ids)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    out: dict[str, list] = {c: [] for c in ("n_runs", *FIGURES, "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
    for d, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        s, m, q = start[low:high], length[low:high], period[low:high]
        out["n_runs"].append(high - low)
        best = int(np.lexsort((q, s, -m))[0]) if high > low else None
        for name, value in zip(FIGURES, (None,) * 4 if best is None else (s[best], m[best], q[best], 1000 * m[best] // q[best]), strict=True):
            out[name].append(None if value is None else int(value))
        words = split[d]
        if source[d] is not None or best is not None:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, s + q, 1)
            np.add.at(edge, s + m, -1)
            kept = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
            words = [words[i] for i in (kept if source[d] is None else source[d][kept]).tolist()]
        collapsed = b" ".join(words)
        out["runs"].append(list(zip(s.tolist(), m.tolist(), q.tolist(), strict=True)))
        out["collapsed"].append(collapsed)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in out["runs"][-1]).encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(collapsed).hexdigest())
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, whole: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, the longest run (ties: least start, then period; without a run nulls),
    runs_sha256 and collapsed_sha256; whole: also `runs` (start, length, period) and `collapsed`, the text's words
    without what repeats.

    plant: the words of a tenth of the documents, told by their ids, are made periodic first; a null id never is. A null
    or empty text has no words, no runs and an empty collapsed text. Rows with the same doc_id, or null, are each on
    their own; other columns are ignored; an empty table gives an empty result. Texts of any length are taken whole.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    fields = [("doc_id", to_arrow_type(kind)), ("n_runs", pa.int64()), *((c, pa.int64()) for c in FIGURES), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    out = f"doc_id {kind.simpleString()}, n_runs long, " + ", ".join(f"{c} long" for c in FIGURES) + ", runs_sha256 string, collapsed_sha256 string"
    if whole:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        fields += [("runs", pa.list_(run)), ("collapsed", pa.string())]
        out += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    schema = pa.schema(fields)

    def run_block(batches):
        for keys, texts in blocks(batches, ["doc_id", "text"], 4 << 20):
            m = measure(keys, [t or b"" for t in texts], plant)
            if whole:
                m["runs"] = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in m["runs"]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), *(pa.array(m[f.name], f.type) for f in list(schema)[1:])], schema=schema)

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS BINARY) AS text").mapInArrow(run_block, out)
