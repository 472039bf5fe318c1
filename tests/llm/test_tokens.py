"""BPE and id files against the libraries themselves."""

from __future__ import annotations

import base64
import pathlib
import random
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

import public_tokenizers as vocabularies  # noqa: E402
import regex  # noqa: E402
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from faultline.llm import bpe, huffman, lexing  # noqa: E402
from faultline.session import shared_dir  # noqa: E402

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))
from cases import TEXTS, documents  # noqa: E402

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(texts):
    out = []
    for lo, hi, data, offsets in lexing.blocks(pa.array(texts, pa.string())):
        points, at = lexing.code_points(data, offsets)
        starts, ends, first = lexing.pretokens(points, at)
        found = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts, ends, strict=True)]
        out += [found[first[i]: first[i + 1]] for i in range(hi - lo)]
    return out


def test_pieces_equal_the_pattern():
    draw = random.Random(3)
    parts = [*"ab 1'stremvdl\n\t .,é²½中\u0085\x1c’", "'s", "'ll", " '", "  "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 16))) for _ in range(20_000)]
    assert _pieces(texts) == [regex.findall(vocabularies.PATTERN, t) for t in texts]


def test_bpe_equals_the_library(spark, encoding):
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    both = bpe.round_trip(docs, RANKS, ("doc_id", "tokens_")[:1]).collect()
    expected = sorted((d is None, d or 0, encoding.encode_ordinary(t or "")) for d, t, *_ in TEXTS)
    for found in (rows, both):
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, np.frombuffer(bytes(r["tokens"]), "<u4").tolist()) for r in found) == expected
        assert sorted(bytes(r["decoded"]).decode() for r in found) == sorted(t or "" for _, t, *_ in TEXTS)
    assert bpe.digests(bpe.round_trip(documents(spark, []), RANKS), "doc_id").count() == 0


def test_long_pieces_equal_the_library(encoding):
    codec, draw = bpe.Codec(RANKS), random.Random(5)
    texts = ["".join(draw.choice("abeinstr") for _ in range(n)) for n in (255, 256, 257, 3000)] + ["é" * 5000, "=" * 40_000]
    tokens, lengths = codec.encode_pieces(texts)
    at = np.cumsum(lengths) - lengths
    assert [tokens[a: a + n].tolist() for a, n in zip(at, lengths, strict=True)] == [encoding.encode_ordinary(t) for t in texts]


def test_id_files_round_trip(spark):
    path, library = vocabularies.path("byte_bpe_50k.json"), Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    huffman.write_files(huffman.encode(documents(spark).repartition(3), path), folder)
    rows = huffman.read_files(spark, folder).orderBy("start").collect()
    got = [(r["doc_id"], r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in rows]
    assert [g[0] for g in got] == sorted((d for d, *_ in TEXTS), key=lambda d: -1 if d is None else d)
    expected = sorted([(-1 if d is None else d), library.encode(t or "", add_special_tokens=False).ids + [0]] for d, t, *_ in TEXTS)
    assert [[-1 if d is None else d, ids] for d, _, ids in got] == expected
    start = 0
    for row, (_, n, ids) in zip(rows, got, strict=True):
        assert row["start"] == start and n == len(ids)
        start += n
    assert [r["ids_crc32"] for r in huffman.checksums(huffman.read_files(spark, folder)).orderBy("start").collect()] == [zlib.crc32(np.array(i, "<u4").tobytes()) for _, _, i in got]


def test_id_files_of_no_documents(spark):
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    huffman.write_files(huffman.encode(documents(spark, []), vocabularies.path("byte_bpe_50k.json")), folder)
    assert huffman.read_files(spark, folder).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 70, 5000])
def test_code_lengths(n):
    counts = np.random.default_rng(n).zipf(1.3, n).clip(1, 10 ** 9)
    lengths = huffman.code_lengths(counts, 13)
    assert lengths.max() <= 13 and (n == 1 or (0.5 ** lengths).sum() == 1)
    order = np.argsort(counts, kind="stable")
    assert (np.diff(lengths[order]) <= 0).all()
    ids = np.random.default_rng(1).choice(np.arange(n) * 3, 9000, p=counts / counts.sum())
    code = huffman.Code(np.arange(n) * 3, lengths)
    bits, offsets = code.encode(ids)
    assert (code.decode([bits, bits], [offsets, offsets], [len(ids)] * 2)[1] == ids).all()


def test_code_lengths_are_optimal():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 200)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (huffman.code_lengths(counts, 18) * counts).sum() == cost


def test_pieces_joined_in_one_text_keep_their_ids():
    own = huffman.Words(vocabularies.path("byte_bpe_50k.json"))
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäéßçñøжяλ中文가ªʰǅ"
    names = [draw.choice(["", " ", "  "]) + "".join(draw.choice(letters) for _ in range(draw.randint(1, 14))) for _ in range(6000)] + [" ", "\n", " '", "'s", " 12", "x", " ́a", " á"]
    draw.shuffle(names)
    ids, lengths = own._pieces(names)
    expected = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in names]
    assert ids.tolist() == [i for x in expected for i in x] and lengths.tolist() == [len(x) for x in expected]
    own.spaced[:] = False  # every text looks as if it split otherwise
    again, n = own._pieces(names)
    assert again.tolist() == ids.tolist() and n.tolist() == lengths.tolist()
