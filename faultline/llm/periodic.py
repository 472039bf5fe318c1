"""Maximal periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q and at least two periods, which no neighbouring word extends. Texts are cut
into runs of whole documents inside a task and become one array of word numbers, each document closed by a symbol of its own.
Windows of 1, 2, 4, ... words are named exactly (equal names, equal words), level by level.

* At scale t (a power of two) position i is *selected* if the least hash of the windows of t words that start in i ... i + t
  belongs to the first or the last of them; windows of period t / 3 at most take no part. Selection depends on the 2 t words
  from i only, so a run repeats its selected positions at distance q. Selected positions with equal 2 t words at a distance of
  3 t - 1 ... 6 t - 2 propose that distance as a period; at most 18 partners are that near, so all pairs are taken.
* Periods up to ``DIRECT`` are read off by comparing the words with themselves moved; together with the runs of smaller scales
  they are the highly periodic regions that the selection leaves out. A run of period q without selected positions is two
  such regions of one period p side by side: where two touch, all q of the one remainder modulo p that joins them are proposed.
* Every proposal is extended both ways by the named windows to the longest stretch of that period and kept if it holds two
  periods; of stretches with equal ends the smallest period counts. So the result is exact, not approximate.

Work is about the number of words times the logarithm of the longest document; memory is 4 bytes for each word and level, in
blocks of ``BLOCK_BYTES`` (one longer text is one block). Nothing is shuffled, so copies and hot sources don't matter.

Null and empty texts and texts without words have no runs. Repeated rows and null ids give a row each. Columns other than
id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.lexing import BLOCK_BYTES, mix, ragged

#: Shortest run that is reported, in words.
LEAST = 12
#: Periods found by direct comparison.
DIRECT = 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_RUNS = "array<struct<start:long,length:long,period:long>>"


class _Names:
    """Names of the windows of 2^k symbols from every position; documents are ordered by length, the longest first.

    ``level[k]`` covers the documents that hold such a window; windows over a document's end are unlike all others.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.size, self.starts, self.lengths = len(symbols), starts, lengths
        self.level = [symbols.astype(np.int32)]
        width = 1
        while len(lengths) and 2 * width <= lengths[0]:
            names = self.level[-1][: self.covered(2 * width)]
            pair = names[:-width].astype(np.int64) << 32 | names[width:]
            found, name = np.unique(pair, return_inverse=True)
            self.level.append(np.concatenate([name, len(found) + np.arange(width)]).astype(np.int32))
            width *= 2

    def covered(self, words: int) -> int:
        """Symbols of the documents of so many words at least."""
        n = int(np.searchsorted(-self.lengths, -words, side="right"))
        return int(self.starts[n - 1] + self.lengths[n - 1] + 1) if n else 0

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Number of equal symbols from ``a`` and ``b`` (different positions) onwards, or before them."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            names, width = self.level[k], 1 << k
            x, y = (a - out - width, b - out - width) if back else (a + out, b + out)
            inside = (x >= 0) & (y >= 0) & (x < len(names)) & (y < len(names))
            same = np.zeros(len(a), bool)
            same[inside] = names[x[inside]] == names[y[inside]]
            out += np.where(same, width, 0)
        return out

    def extended(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Columns start, end, period of the longest stretches around ``at`` that repeat after ``period``, two periods at least."""
        start = at - self.common(at, at + period, back=True)
        end = at + period + self.common(at, at + period)
        held = end - start >= 2 * period
        return _distinct(np.stack([start[held], end[held], period[held]]))


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Runs in order of start and end, each pair of ends once with its smallest period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)
    return runs[:, new]


def _direct(symbols: np.ndarray, period: int) -> np.ndarray:
    same = np.concatenate([[False], symbols[:-period] == symbols[period:], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, end = edge[::2], edge[1::2] + period
    held = end - start >= max(2 * period, 4)
    return np.stack([start[held], end[held], np.full(int(held.sum()), period)])


def _periodic(runs: np.ndarray, width: int, size: int) -> np.ndarray:
    """Whether the window of ``width`` symbols from each position has a period of a third of it at most."""
    start, end, period = runs[:, (3 * runs[2] <= width) & (runs[1] - runs[0] >= width)]
    change = np.zeros(size + 1, np.int64)
    inside = end <= size
    np.add.at(change, start[inside], 1)
    np.add.at(change, end[inside] - width + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _selected(names: np.ndarray, width: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set: positions chosen by the least hash within reach."""
    ident = mix(names.astype(np.uint64) + np.uint64(width << 32))
    ident[periodic] = _NONE
    least, reach = ident, 1
    while reach < width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    first, last = ident[:-width], ident[width:]
    least = np.minimum(least[: len(first)], last)
    return np.flatnonzero((least != _NONE) & ((first == least) | (last == least)))


def _proposals(at: np.ndarray, context: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of selected positions with equal contexts; a chain of overlapping ones is one proposal."""
    order = np.argsort(context[at], kind="stable")
    at = at[order]
    group = context[at]
    found, step = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 1
    while step < len(at):
        distance = at[step:] - at[:-step]
        near = (group[step:] == group[:-step]) & (distance <= 6 * width - 2)
        if not near.any():
            break
        near &= distance >= max(3 * width - 1, DIRECT + 1)
        found.append((at[:-step][near], distance[near]))
        step += 1
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(period) != 0) | (np.diff(at) > 2 * width)
    return at[new], period[new]


def _side_by_side(names: _Names, runs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from touching regions of one period between a sixth and a third of ``width``."""
    start, end, period = runs[:, (6 * runs[2] > width) & (3 * runs[2] <= width) & (runs[1] - runs[0] >= 8 * runs[2])]
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    pair = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]))
    s1, e1, s2, e2, p = start[pair], end[pair], start[pair + 1], end[pair + 1], period[pair]
    # the one remainder by which the second region continues the first
    each, shift = np.repeat(np.arange(len(pair)), p), ragged(p, p)
    joined = names.common(s2[each] - shift, s2[each]) >= p[each]
    each, shift = each[joined], shift[joined]
    times = np.minimum(e1 - s1, e2 - s2)[each] // p[each] + 1
    period = np.repeat(shift, times) + ragged(np.zeros(len(times), np.int64), times) * np.repeat(p[each], times)
    each = np.repeat(each, times)
    at = np.maximum(s1[each], s2[each] - period)
    held = np.minimum(e1[each], e2[each] - period) - at >= period
    return at[held], period[held]


def maximal_runs(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Columns start, end, period of all maximal runs of ``least`` symbols at least, in order of start and end.

    ``symbols`` holds the documents in order of falling length, each followed by a symbol that occurs nowhere else.
    """
    names = _Names(symbols, starts, lengths)
    runs = _distinct(np.concatenate([np.zeros((3, 0), np.int64)] + [_direct(symbols, p) for p in range(1, DIRECT + 1) if p < len(symbols)], axis=1))
    k = 1
    while size := names.covered(2 * (3 * (width := 1 << k) - 1)):
        at, period = _proposals(_selected(names.level[k][:size], width, _periodic(runs, width, size)), names.level[k + 1], width)
        more_at, more = _side_by_side(names, runs, width)
        found = names.extended(np.concatenate([at, more_at]), np.concatenate([period, more]))
        runs = _distinct(np.concatenate([runs, found], axis=1))
        k += 1
    return runs[:, runs[1] - runs[0] >= least]


def _runs_of(texts: list[bytes], least: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words and runs (rows start, length, period) of each text."""
    words = [text.split() for text in texts]
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    counts = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= max(least, 4)]
    if len(order):
        ids = pa.array([w for i in order.tolist() for w in words[i]], pa.binary()).dictionary_encode().indices.to_numpy()
        lengths = counts[order]
        starts = np.cumsum(lengths + 1) - lengths - 1
        symbols = np.empty(int(lengths.sum()) + len(order), np.int64)
        symbols[ragged(starts, lengths)] = ids
        symbols[starts + lengths] = len(ids) + np.arange(len(order))
        runs = maximal_runs(symbols, starts, lengths, least)
        doc = np.searchsorted(starts, runs[0], side="right") - 1
        rows = np.stack([runs[0] - starts[doc], runs[1] - runs[0], runs[2]], axis=1)
        rows, doc = (x[np.lexsort((rows[:, 2], rows[:, 0], doc))] for x in (rows, doc))
        cuts = np.searchsorted(doc, np.arange(len(order) + 1))
        for i, lo, hi in zip(order.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = rows[lo:hi]
    return words, out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: id, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text's words
    joined by blanks without those that a run holds after its first period."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            at = 0
            while at < len(ids):
                block, size = [], 0
                while at + len(block) < len(ids) and (not block or size < BLOCK_BYTES):
                    block.append(texts[at + len(block)].as_py() or b"")
                    size += len(block[-1])
                words, runs = _runs_of(block, least)
                rows = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"]))
                kept = pa.array([_collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(block)), pa.array([len(w) for w in words], pa.int64()), lists, kept],
                                                 names=[id_col, "n_words", "runs", "collapsed"])
                at += len(block)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, n_words long, runs {_RUNS}, collapsed string")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("first", first).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("first.start")).alias("start"), F.col("first.length").alias("length"),
        (-F.col("first.period")).alias("period"), F.floor(1000 * F.col("first.length") / -F.col("first.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text; in every tenth document by the crc32 of its id the words from one place on repeat a stretch of a period
    that follows from the id. Such texts have their words joined by single blanks; all others are as they were."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col(text_col))

    words = F.array(F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    return docs.select(id_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), F.transform(words, periodic)[0]).otherwise(F.col(text_col)).alias(text_col))
