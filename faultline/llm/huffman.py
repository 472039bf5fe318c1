"""Token ids in files: canonical, length-limited Huffman codes from global counts.

The format is a folder with two Parquet tables, so that Spark's own writers and committers make it on any file
system. ``codes``: id and code length (codes are canonical: ascending by length, then id). ``blocks``: runs of whole
documents of about ``BLOCK_IDS`` ids each, with their document ids and lengths, the ids before them in their part,
the bits (uncompressed), and the bit offset of every ``STEP``-th id. Blocks decode independently of each other; the
offsets let a decoder start anywhere, and here let it run all stretches of a batch side by side through one table.

Parts and blocks ascend by document id (equal ids by a hash of the text, null ids first). Null texts count as
empty; each document ends with ``end_id``. An empty table gives empty files. Further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.llm import lexing
from faultline.session import settle

MAX_BITS = 18
BLOCK_IDS = 1 << 16
STEP = 1 << 10
#: Pieces given to the tokenizers library in one text.
JOINED = 1 << 12
_ENCODED = "part int, seq long, first_id long, doc_id long, n long, ids binary"
_BLOCKS = "part int, seq long, first_id long, n_ids long, doc_ids array<long>, lengths array<long>, offsets array<long>, bits binary"
_DECODED = "doc_id long, part int, first_id long, n_tokens long, ids binary"


class Words:
    """Ids of split pieces by the tokenizers library, each distinct piece once per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [str(t).encode() for t in self.tokenizer.get_added_tokens_decoder().values() for t in [t.content]]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte-level sign of a space
        self.lexicon = lexing.Lexicon(self._pieces)

    def _single(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(lengths.sum())), lengths

    def _joined(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_single``, for pieces of a space and letters: one after the other they are a text that splits into just these
        pieces, and an id whose token begins with a space begins a piece."""
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(names), JOINED):
            part = names[lo: lo + JOINED]
            found = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int64)
            starts = np.flatnonzero(self.spaced[found])
            n = np.diff(np.append(starts, len(found)))
            if len(starts) != len(part) or starts[0]:  # a tokenizer that splits otherwise
                found, n = self._single(part)
            ids.append(found)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _pieces(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((x[0] == " " and x[1:].isalpha() for x in names), bool, len(names))
        lengths, parts = np.zeros(len(names), np.int64), []
        for own, encode_names in ((np.flatnonzero(plain), self._joined), (np.flatnonzero(~plain), self._single)):
            ids, n = encode_names([names[i] for i in own.tolist()])
            lengths[own] = n
            parts.append((own, ids))
        out, at = np.zeros(int(lengths.sum()), np.int64), np.cumsum(lengths) - lengths
        for own, ids in parts:
            out[lexing.ragged(at[own], lengths[own])] = ids
        return out, lengths

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and the number of each document's."""
        points, own = lexing.code_points(data, offsets)
        starts, ends, first = lexing.pretokens(points, own)
        ids, lengths = self.lexicon.values(self.lexicon.look_up(points, starts, ends))
        at = np.concatenate([[0], np.cumsum(lengths)])[first]
        raw = data.tobytes()
        if not any(mark in raw for mark in self.marks):
            return ids, np.diff(at)
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if any(mark in raw[a:b] for mark in self.marks):  # added tokens are cut out before the split pattern
                out[row] = np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


@cache
def words(path: str) -> Words:
    return Words(path)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each document with its end id, written as a table in ascending order of ids.

    Columns: part and position of the document, ids before it in its part, document id, number of ids, and the
    ids as little-endian integers of 16 bits where the vocabulary allows it, else 32.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        own, part, seq, before = words(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        form = "<u2" if own.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches):
            ids, n = own.encode_block(data, offsets)
            ended = np.full(len(ids) + len(n), end_id, form)
            ended[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            n = n + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.arange(seq, seq + hi - lo)), pa.array(before + np.cumsum(n) - n),
                 batch.column("doc_id").slice(lo, hi - lo), pa.array(n), _binary(ended, n)],
                names=["part", "seq", "first_id", "doc_id", "n", "ids"])
            seq, before = seq + hi - lo, before + int(n.sum())

    return settle(ordered.mapInArrow(run, _ENCODED), "token-ids", compression="zstd")


def id_counts(encoded: DataFrame) -> DataFrame:
    """``id`` and ``n`` over all documents; each task adds up its own counts first."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column("ids"), batch.column("n").to_numpy()), minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return encoded.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _binary(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of ``n`` numbers as binary values."""
    ends = (np.concatenate([[0], np.cumsum(n)]) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(values: pa.Array, n: np.ndarray) -> np.ndarray:
    """All ids of binary values (``n`` each) as one array."""
    values = values.cast(pa.binary())
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset: values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0]: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view("<u2" if len(raw) == 2 * int(n.sum()) else "<u4")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts, by package-merge.

    Level by level the counts are merged with the pairs of the level before; going back, the cheapest
    ``2 n - 2`` items of the last level tell how many counts of each level are taken.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit into codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    items, levels = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        packages = items[0: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        levels.append(rank < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of (id, length) pairs, for both directions."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, sizes = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.bits = int(sizes[-1]) if len(sizes) else 1
        room = np.int64(1) << (self.bits - sizes)  # entries of the decoding table
        at = np.cumsum(room) - room
        top = int(self.ids.max()) + 1 if len(sizes) else 1
        self.code, self.size = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.ids], self.size[self.ids] = (at >> (self.bits - sizes)).astype(np.uint64), sizes
        self.table_id, self.table_size = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        used = int(room.sum())
        self.table_id[:used], self.table_size[:used] = np.repeat(self.ids, room), np.repeat(sizes, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, from the high end of each byte, and the bit offset of every ``STEP``-th id."""
        code, size = self.code[ids], self.size[ids]
        ends = np.cumsum(size)
        at = ends - size
        total = int(ends[-1]) if len(ids) else 0
        cells = np.zeros(total // 64 + 2, np.uint64)
        cell, over = at >> 6, (at & 63) + size - 64  # over: bits that run into the next cell
        high = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        if len(ids):
            heads = np.flatnonzero(np.diff(cell, prepend=-1))
            cells[cell[heads]] = np.bitwise_or.reduceat(high, heads)
            cut = np.flatnonzero(over > 0)
            cells[cell[cut] + 1] |= code[cut] << (64 - over[cut]).astype(np.uint64)
        return cells.astype(">u8").tobytes()[: (total + 7) // 8], at[::STEP]

    def decode(self, bits: list[bytes], offsets: list[np.ndarray], n_ids: list[int]) -> list[np.ndarray]:
        """The ids of several blocks: all stretches between offsets advance together, one id a round."""
        base = np.cumsum([0, *(len(b) for b in bits)])
        data = np.frombuffer(b"".join(bits) + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        lanes = [len(o) for o in offsets]
        at = np.concatenate([np.asarray(o, np.int64) + 8 * b for o, b in zip(offsets, base[:-1], strict=True)]) if lanes else np.zeros(0, np.int64)
        left = np.concatenate([np.minimum(STEP, n - STEP * np.arange(k)) for n, k in zip(n_ids, lanes, strict=True)]) if lanes else np.zeros(0, np.int64)
        order = np.argsort(-left, kind="stable")
        at, count = at[order], left[order]
        found = np.zeros((len(at), STEP), np.uint32)
        active = np.searchsorted(-count, -np.arange(STEP), side="left")  # lanes that have an id in round k
        drop = np.uint32(32 - self.bits)
        for k in range(int(count[0]) if len(count) else 0):
            m = active[k]
            peek = (window[at[:m] >> 3] << (at[:m] & 7).astype(np.uint32)) >> drop
            found[:m, k] = self.table_id[peek]
            at[:m] += self.table_size[peek]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        out, lane = [], 0
        for n, k in zip(n_ids, lanes, strict=True):
            rows = found[back[lane: lane + k]]
            out.append(rows.reshape(-1)[:n] if k else np.zeros(0, np.uint32))
            lane += k
        return out


def write_files(encoded: DataFrame, path: str) -> None:
    """Codes from the counts of ``encoded`` and its blocks, as the two tables of the format under ``path``."""
    spark = encoded.sparkSession
    counts = id_counts(encoded).orderBy("id").toPandas()  # a row per id: bounded by the vocabulary
    ids, sizes = counts["id"].to_numpy(np.int64), code_lengths(counts["n"].to_numpy(np.int64))
    spark.createDataFrame(pa.table({"id": ids, "bits": sizes.astype(np.int32)}).to_pandas(), "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")

    def run(batches):
        code, held = Code(ids, sizes), []

        def block():
            joined = np.concatenate([x[4] for x in held])
            bits, offsets = code.encode(joined)
            part, seq, first_id = held[0][:3]
            held_rows = [[part], [seq], [first_id], [len(joined)], [[x[3] for x in held]], [[len(x[4]) for x in held]], [offsets.tolist()], [bits]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held_rows, kinds, strict=True)], names=names)

        names = [x.split()[0] for x in _BLOCKS.split(", ")]
        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), longs, longs, longs, pa.binary()]
        n_held = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            flat, ends = _flat(batch.column("ids"), n), np.cumsum(n)
            for part, seq, first_id, doc_id, lo, hi in zip(*(c.to_pylist() for c in batch.columns[:4]), (ends - n).tolist(), ends.tolist(), strict=True):
                if held and (n_held >= BLOCK_IDS or part != held[0][0] or seq != held[-1][1] + 1):
                    yield block()
                    n_held = 0
                held.append((part, seq, first_id, doc_id, flat[lo:hi]))
                n_held += hi - lo
        if held:
            yield block()

    encoded.select("part", "seq", "first_id", "doc_id", "n", "ids").mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids``
    (little-endian unsigned 32-bit integers)."""
    codes = spark.read.parquet(f"{path}/codes").toPandas()  # bounded by the vocabulary
    blocks = spark.read.parquet(f"{path}/blocks")
    ids, sizes = codes["id"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64)

    def run(batches):
        code = Code(ids, sizes)
        for whole in batches:
            for lo in range(0, whole.num_rows, 32):
                batch = whole.slice(lo, 32)
                col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                lists = code.decode(col["bits"], [np.array(x, np.int64) for x in col["offsets"]], col["n_ids"])
                lengths = [np.array(x, np.int64) for x in col["lengths"]]
                n = np.concatenate(lengths)
                per = [len(x) for x in lengths]
                first = np.concatenate([f + np.cumsum(x) - x for f, x in zip(col["first_id"], lengths, strict=True)])
                joined = np.concatenate(lists).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for x in col["doc_ids"] for d in x], pa.int64()), pa.array(np.repeat(col["part"], per).astype(np.int32)), pa.array(first), pa.array(n), _binary(joined, n)],
                    names=["doc_id", "part", "first_id", "n_tokens", "ids"])

    decoded = blocks.select("part", "first_id", "n_ids", "doc_ids", "lengths", "offsets", "bits").mapInArrow(run, _DECODED)
    # a row per part, that is per task of the sort
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = settle(parts.select("part", "before"), "id-parts")  # its known size lets Spark pick the join
    return decoded.join(parts, "part").select("doc_id", (F.col("before") + F.col("first_id")).alias("start"), "n_tokens", "ids")


def checksums(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the unsigned CRC-32 of the ids."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids) -> int:
    """The checksum of a list of ids, for checks outside Spark."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
