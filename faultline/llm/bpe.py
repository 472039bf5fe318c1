"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside tasks.

Texts are cut by the public split pattern; each distinct piece of a task is encoded once. A recursive query holds
the token positions of the pieces that still change, joins neighbours with the merge table, and contracts in each
piece the leftmost pair of least rank until none is left. Decoding is a join with the vocabulary and an ordered
aggregation. Results equal the tiktoken library's for the same ranks.

Null texts count as empty and give no tokens; nulls, repeated rows and further columns of the input don't matter,
because only the named identifier and the text are read and each row is encoded by itself. Pieces of over
``LONG_BYTES`` bytes are contracted by a priority queue in the same order: a recursion takes as many rounds as
merges, which is too slow for a piece of many thousand characters.
"""

from __future__ import annotations

import base64
import heapq
import tempfile
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from faultline.llm import lexing

LONG_BYTES = 256
DECODE_ROWS = 1 << 18
PIECES = 20_000

_MERGE = """
WITH RECURSIVE state(piece, pos, token, done) AS (
  SELECT piece, pos, token, FALSE FROM start
  UNION ALL (
    WITH neighbours AS (
      SELECT piece, pos, token, lead(token) OVER w AS next_token, lead(pos) OVER w AS next_pos
      FROM state WHERE NOT done WINDOW w AS (PARTITION BY piece ORDER BY pos)),
    pairs AS (
      SELECT n.piece, n.pos, n.token, n.next_pos, m.merged
      FROM neighbours n LEFT JOIN merges m ON m.lhs = n.token AND m.rhs = n.next_token),
    best AS (
      SELECT piece, min(merged) AS merged, arg_min(pos, merged::BIGINT * 1000000 + pos) AS first_pos,
             arg_min(next_pos, merged::BIGINT * 1000000 + pos) AS gone_pos
      FROM pairs GROUP BY piece)
    SELECT p.piece, p.pos, CASE WHEN p.pos = b.first_pos THEN b.merged ELSE p.token END, b.merged IS NULL
    FROM pairs p JOIN best b USING (piece)
    WHERE b.merged IS NULL OR p.pos <> b.gone_pos))
SELECT piece, token FROM state WHERE done ORDER BY piece, pos
"""
_DECODE = """
SELECT doc, string_agg(chars, '' ORDER BY pos) AS chars FROM tokens JOIN vocabulary USING (token) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """The merge table and the vocabulary of one rank file, in an in-process database of one thread."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        self.byte_tokens = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(self.ranks[token[:cut]], self.ranks[token[cut:]], rank) for token, rank in self.ranks.items()
                  for cut in range(1, len(token)) if token[:cut] in self.ranks and token[cut:] in self.ranks]
        self.pairs = {(lhs, rhs): rank for lhs, rhs, rank in merges}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": tempfile.gettempdir()})
        columns = np.array(merges, np.int32).reshape(-1, 3)
        self._table("merges", lhs=columns[:, 0], rhs=columns[:, 1], merged=columns[:, 2])
        # one Latin-1 character for each byte, so that parts of characters can be strings
        self._table("vocabulary", token=np.array(list(self.ranks.values()), np.int32), chars=[t.decode("latin-1") for t in self.ranks])
        self.lexicon = lexing.Lexicon(self.encode_pieces)

    def _table(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.db.register("given", given)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces, one piece after the other, and the number of tokens of each."""
        found = [self._merged(pieces[i: i + PIECES]) for i in range(0, len(pieces), PIECES)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode() for p in pieces]
        sizes = np.array([len(d) for d in data], np.int64)
        short = np.flatnonzero(sizes <= LONG_BYTES)
        parts: dict[int, list[int]] = {i: self._by_queue(data[i]) for i in np.flatnonzero(sizes > LONG_BYTES).tolist()}
        joined = np.frombuffer(b"".join(data[i] for i in short.tolist()), np.uint8)
        positions = lexing.ragged(np.zeros(len(short), np.int64), sizes[short])
        given = pa.table({"piece": np.repeat(short, sizes[short]).astype(np.int32), "pos": positions.astype(np.int32),
                          "token": self.byte_tokens[joined]})
        self.db.register("start", given)
        out = self.db.execute(_MERGE).fetchnumpy()
        self.db.unregister("start")
        owner, tokens = np.asarray(out["piece"], np.int64), np.asarray(out["token"], np.int64)
        lengths = np.bincount(owner, minlength=len(pieces))
        if parts:
            for i, found in parts.items():
                lengths[i] = len(found)
            owner = np.concatenate([owner, *(np.full(len(found), i) for i, found in parts.items())])
            tokens = np.concatenate([tokens, *(np.array(found, np.int64) for found in parts.values())])
            tokens = tokens[np.argsort(owner, kind="stable")]
        return tokens, lengths

    def _by_queue(self, data: bytes) -> list[int]:
        tokens = self.byte_tokens[np.frombuffer(data, np.uint8)].tolist()
        before, after = list(range(-1, len(tokens) - 1)), [*range(1, len(tokens)), -1]
        queue = [(rank, i) for i in range(len(tokens) - 1) if (rank := self.pairs.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if tokens[i] < 0 or j < 0 or self.pairs.get((tokens[i], tokens[j])) != rank:
                continue
            tokens[i], tokens[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for lhs, rhs in ((before[i], i), (i, after[i])):
                if lhs >= 0 and rhs >= 0 and (new := self.pairs.get((tokens[lhs], tokens[rhs]))) is not None:
                    heapq.heappush(queue, (new, lhs))
        return [t for t in tokens if t >= 0]

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts of a block, and where each text's tokens begin (and the end)."""
        points, offsets = lexing.code_points(data, offsets)
        starts, ends, first = lexing.pretokens(points, offsets)
        tokens, lengths = self.lexicon.values(self.lexicon.look_up(points, starts, ends))
        return tokens, np.concatenate([[0], np.cumsum(lengths)])[first]

    def decode(self, token_lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of tokens."""
        out, at = [b""] * len(token_lists), 0
        while at < len(token_lists):
            upto, rows = at, 0
            while upto < len(token_lists) and (upto == at or rows + len(token_lists[upto]) <= DECODE_ROWS):
                rows += len(token_lists[upto])
                upto += 1
            lengths = np.array([len(x) for x in token_lists[at:upto]], np.int64)
            given = pa.table({"doc": np.repeat(np.arange(at, upto), lengths).astype(np.int32), "pos": np.arange(rows, dtype=np.int32),
                              "token": np.concatenate(token_lists[at:upto]).astype(np.int32)})
            self.db.register("tokens", given)
            for doc, chars in self.db.execute(_DECODE).fetchall():
                out[doc] = chars.encode("latin-1")
            self.db.unregister("tokens")
            at = upto
        return out


@cache
def codec(path: str) -> Codec:
    """One per Python worker, so that later tasks of the worker find its pieces."""
    return Codec(path)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``tokens``: the ids of each text as little-endian unsigned 32-bit integers (binary)."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches):
        own = codec(ranks_path)
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches):
            tokens, first = own.encode_block(data, offsets)
            raw = tokens.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(lo, hi - lo), pa.array([raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                names=["key", "tokens"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("tokens", T.BinaryType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``id_col``, ``tokens`` and ``decoded``: the bytes of each row's tokens (null tokens count as none)."""
    kind = tokens.schema[id_col].dataType
    source = tokens.select(F.col(id_col).alias("key"), F.col(tokens_col).alias("tokens"))

    def run(batches):
        own = codec(ranks_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = [np.frombuffer(x.as_py() or b"", "<u4") for x in part.column("tokens")]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("tokens"), pa.array(own.decode(lists), pa.binary())],
                                                 names=["key", "tokens", "decoded"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("tokens", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return source.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass of one Python worker: the columns ``keep``, ``tokens`` and ``decoded``."""
    source = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        own = codec(ranks_path)
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches, "__text"):
            tokens, first = own.encode_block(data, offsets)
            raw = tokens.astype("<u4")
            lists = [raw[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            kept = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in keep), pa.array([x.tobytes() for x in lists], pa.binary()), pa.array(own.decode(lists), pa.binary())],
                names=[*keep, "tokens", "decoded"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("tokens", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return source.mapInArrow(run, schema)


def digests(decoded: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the number of tokens, and SHA-256 of the ids and of the decoded bytes."""
    return decoded.select(
        *keep, (F.length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce("tokens", F.lit(b"")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
