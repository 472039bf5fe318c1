"""Text batches as numpy arrays: word spans, split patterns, and hashes of spans.

Everything here works on one Arrow batch inside a task. Texts are cut into blocks of whole documents of a few
MB, so that memory does not depend on the batch; a longer single text is one block. Null texts count as empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_SEGMENT = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LETTER, NUMBER, SPACE, OTHER = range(4)
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    values = np.asarray(values, np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@cache
def _symbol_values(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _MULTIPLIER)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(base: np.uint64) -> np.ndarray:
        out = np.full(_SEGMENT + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return powers(_MULTIPLIER), powers(_INVERSE)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans (ascending, not overlapping) of an array of bytes or code points.

    Prefix sums of a polynomial give all spans at once; spans longer than a segment are hashed by pieces.
    """
    out = np.zeros(len(starts), np.uint64)
    values, (up, down) = _symbol_values(256 if symbols.dtype == np.uint8 else 0x110000), _powers()
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        if ends[at] - base > _SEGMENT:
            total = np.uint64(0)
            for lo in range(int(base), int(ends[at]), _SEGMENT):
                piece = values[symbols[lo: min(lo + _SEGMENT, int(ends[at]))]]
                total = mix(np.array([total + (piece * up[: len(piece)]).sum(dtype=np.uint64)]))[0]
            out[at] = total
            at += 1
            continue
        part = values[symbols[base: ends[upto - 1]]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        lo, hi = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (sums[hi] - sums[lo]) * down[lo]
        at = upto
    return mix(out + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def blocks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, start of each text and the end) for runs of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        yield row, upto, data[offsets[row]: offsets[upto]], offsets[row: upto + 1] - offsets[row]
        row = upto


def batch_blocks(batches, column: str = "text"):
    """(batch, first row, row after the last, bytes, offsets) over Arrow batches."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(column)):
            yield batch, lo, hi, data, offsets


def _edges(n: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        inner = np.unique(offsets[offsets < n])
        first[inner] = True
        last[np.append(inner[1:], n) - 1] = True
    return first, last


@cache
def _blank_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (and the end)."""
    solid = ~_blank_bytes()[data]
    first, last = _edges(len(data), offsets)
    before, after = np.roll(solid, 1), np.roll(solid, -1)
    starts = np.flatnonzero(solid & (first | ~before))
    ends = np.flatnonzero(solid & (last | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@cache
def _lower_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    return _lower_bytes()[data]


@cache
def classes() -> np.ndarray:
    """Letter, number, space or other, by code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = LETTER if kind == "L" else NUMBER
    table[_SPACES] = SPACE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets counted in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    return points, leads[offsets]


def pretokens(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans into which the public split pattern of byte-level vocabularies cuts each text.

    The pattern is contractions, then runs of letters, numbers or other characters with one leading space,
    then white space without its last character, then white space. Spans tile each text; returned are starts,
    ends and the first span of each text (and the end).
    """
    n = len(points)
    kind = classes()[points]
    first, last = _edges(n, offsets)
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    tail = np.zeros(n, bool)  # last white space before something else of the same text
    tail[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    begin |= tail
    attached = np.flatnonzero(tail & (points == 0x20)) + 1
    begin[attached] = False
    quotes = np.flatnonzero((points == 0x27) & begin & ~last)
    quotes = quotes[kind[quotes + 1] == LETTER]
    if len(quotes):
        one = points[quotes + 1]
        more = ~last[quotes + 1]
        two = np.where(more, points[np.minimum(quotes + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, length in ((quotes[single], 1), (quotes[double], 2)):
            begin[hit + 1] = False
            after = hit[~last[hit + length]] + length + 1
            begin[after] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, offsets)


def letter_runs(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and the first run of each text (and the end)."""
    solid = classes()[points] == LETTER
    first, last = _edges(len(points), offsets)
    starts = np.flatnonzero(solid & (first | ~np.roll(solid, 1)))
    ends = np.flatnonzero(solid & (last | ~np.roll(solid, -1))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length`` of all rows, one row after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _strings(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The strings of spans: all symbols in one array, with a separator that the spans don't hold."""
    if symbols.dtype == np.uint8:
        return [symbols[lo:hi].tobytes().decode() for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
    lengths = ends - starts + 1
    joined = symbols[np.minimum(ragged(starts, lengths), len(symbols) - 1)]
    if (joined == 0).any():
        return [symbols[lo:hi].tobytes().decode("utf-32-le") for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
    joined[np.cumsum(lengths) - 1] = 0
    return joined.tobytes().decode("utf-32-le").split("\0")[:-1]


class Lexicon:
    """Values of distinct spans, computed once per task and span: hash -> row of ragged arrays.

    Distinct spans are told apart by their 64-bit hashes. ``compute`` gets the strings of new spans and returns
    their values as one array and the number of values of each. Beyond ``limit`` spans the table starts anew, so that its memory is bounded.
    """

    def __init__(self, compute, limit: int = 300_000, dtype=np.uint32):
        self.compute, self.limit, self.dtype = compute, limit, dtype
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def look_up(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each span."""
        import pandas as pd

        if len(self.rows) > self.limit:
            self._clear()
        codes, distinct = pd.factorize(span_hashes(symbols, starts, ends))
        one = np.empty(len(distinct), np.int64)
        one[codes] = np.arange(len(codes))
        rows = np.array([self.rows.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            names = _strings(symbols, starts[one[new]], ends[one[new]])
            base = len(self.rows)
            rows[new] = np.arange(base, base + len(new))
            self.rows.update(zip(distinct[new].tolist(), rows[new].tolist(), strict=True))
            joined, lengths = self.compute(names)
            while self.used + len(joined) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while base + len(new) > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.flat[self.used: self.used + len(joined)] = joined
            self.lengths[base: base + len(new)] = lengths
            self.starts[base: base + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.used += len(joined)
        return rows[codes]

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the rows in order, and the number of values of each row."""
        lengths = self.lengths[rows]
        return self.flat[ragged(self.starts[rows], lengths)], lengths
