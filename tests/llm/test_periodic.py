"""Maximal runs of words against a plain definition, on random, periodic and recursive words."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from cases import ROWS, documents
from hypothesis import given, settings, strategies as st

from faultline.llm import periodic, queries


def plain_runs(words, least=12):
    """By definition: every period, every longest stretch, the smallest period of equal stretches."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def found_runs(texts, least=12):
    return [[tuple(r) for r in rows.tolist()] for rows in periodic._runs_of([" ".join(map(str, t)).encode() for t in texts], least)[1]]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def nested(seed, n):
    """Repetitions of repetitions: regions of small periods side by side within larger periods."""
    rng = np.random.default_rng(seed)
    text = ["a", "b"] if seed % 2 else ["a"]
    while len(text) < n:
        kind = rng.integers(5)
        if kind == 0:
            text = text * int(rng.integers(2, 6)) + text[: int(rng.integers(0, len(text) + 1))]
        elif kind == 1:
            text = text + [str(rng.integers(3))]
        elif kind == 2:
            text = [str(rng.integers(3))] + text
        elif kind == 3:
            cut = int(rng.integers(0, len(text)))
            text = text[cut:] + text
        else:
            text = text + text[: int(rng.integers(1, len(text) + 1))]
    return text[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_words(letters):
    rng = np.random.default_rng(letters)
    texts = [rng.integers(letters, size=int(n)).tolist() for n in rng.integers(0, 160, size=120)]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_recursive_words():
    thue = [bin(i).count("1") % 2 for i in range(700)]
    blocks = ("ab" * 5 + "a") * 2 + "c" + ("abcab" * 7 + "abc") * 3 + ("ab" * 9 + "a" + "ab" * 12 + "a") * 2
    texts = [fibonacci(600), thue, list(blocks), ["x"] * 500, list("ab" * 150), list(("a" * 40 + "b") * 6), list("a" * 300 + "b" + "a" * 300)]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_nested_repetitions():
    texts = [nested(seed, 50 + seed) for seed in range(250)]
    assert found_runs(texts) == [plain_runs(t) for t in texts]
    assert found_runs(texts, 4) == [plain_runs(t, 4) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 14), st.text("abc", max_size=2)), min_size=1, max_size=6), st.integers(1, 3))
def test_powers_side_by_side(parts, times):
    text = list("".join(u * k + v for u, k, v in parts) * times)[:700]
    assert found_runs([text, text[1:]]) == [plain_runs(text), plain_runs(text[1:])]


def test_long_period_and_long_text():
    rng = np.random.default_rng(1)
    part = rng.integers(10 ** 6, size=3_000).tolist()
    text = rng.integers(10 ** 6, size=500).tolist() + part * 2 + part[:100] + [-1] + ["z"] * 40_000
    assert found_runs([text])[0] == [(500, 6_100, 3_000), (6_601, 40_000, 1)]


def plain(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words) if n < 5_000 else None
    if runs is None:
        return None
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_plain_version(spark):
    path = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, path).collect()}
    texts = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    short = [(d, t) for d, t in texts if len((t or "").split()) < 600]
    for doc_id, text in short:
        assert rows[doc_id] == plain(doc_id, text, True), doc_id
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in short) > 5


def test_edge_cases(spark):
    rows = [*ROWS, (200, "a b " * 10 + " x", "en", "a", 1, "k", 7, "t", 5), (201, " \t".join(["x"] * 13) + "\x0b\x0c y\x85z", None, None, 1, "k", 7, "t", 5)]
    docs = documents(spark, rows)
    got = sorted(map(tuple, periodic.digests(periodic.find_runs(docs)).collect()), key=repr)
    want = [(r[0], plain(r[0], r[1], False)) for r in rows]
    assert len(got) == len(want)
    for doc_id, row in want:
        assert row is None or (doc_id, *row) in got
    planted = periodic.with_planted_runs(docs)
    assert sorted(map(repr, (r["doc_id"] for r in planted.collect()))) == sorted(repr(r[0]) for r in rows)
    empty = periodic.digests(periodic.find_runs(periodic.with_planted_runs(docs.limit(0))))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    clash = docs.withColumnRenamed("key", "runs").withColumnRenamed("node", "collapsed").withColumnRenamed("size", "n_words")
    assert periodic.find_runs(clash).count() == len(rows)
