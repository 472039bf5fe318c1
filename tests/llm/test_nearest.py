"""Nearest neighbours against brute force: recall, exact scores, order and edge cases."""

from __future__ import annotations

import numpy as np
import pytest

from faultline.llm import nearest, queries


def brute(rows, wanted, k=20):
    """Exact answers by definition; ``rows`` of (id, vector)."""
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for q, x in sound:
        if not wanted(q):
            continue
        best = out.setdefault(q, {})
        for i, y in sound:
            if i != q and len(x) == len(y):
                best[i] = max(best.get(i, -np.inf), float((x * y).sum()))
    return {q: sorted(((-s, i) for i, s in best.items()))[:k] for q, best in out.items()}


def answers(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def check(found, truth, k=20):
    """Recall, after scores, ranks and order have been verified."""
    hit = n = 0
    for q, best in truth.items():
        got = found.get(q, [])
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1)) and len({i for _, i, _ in got}) == len(got)
        assert got == sorted(got, key=lambda x: (-x[2], x[1]))
        true = {i: -s for s, i in best}
        assert all(abs(true[i] - s) <= 1e-12 * max(1, abs(s)) for _, i, s in got if i in true)
        hit += len({i for _, i, _ in got} & set(true))
        n += len(best)
    assert set(found) <= set(truth)
    return hit / max(n, 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = answers(queries.QUERIES["op11_adaptive_scan"](spark, path))
    assert check(found, brute(rows, lambda q: q % 20 == 0)) >= 0.95


def clustered(n, size, seed, spread=0.35, offset=0.0, crowd=1 / 3, places=40):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((places, size)) + offset
    which = np.where(rng.random(n) < crowd, 0, rng.integers(places, size=n))
    return centres[which] + spread * rng.standard_normal((n, size)), rng


@pytest.mark.parametrize("case", ["lengths", "offset", "even"])
def test_recall_on_uneven_vectors(spark, case):
    rows, rng = clustered(20_000, 48, 3, offset=2.0 if case == "offset" else 0.0)
    if case == "lengths":
        rows = rows * np.exp(rng.standard_normal((len(rows), 1)))
    if case == "even":
        rows = rng.standard_normal(rows.shape)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    asked = table.filter("vec_id % 500 = 0")
    model, listed = nearest.fit(table, asked)
    assert model.recall >= nearest.RECALL and listed.count() == len(rows)
    index, lists = nearest.build(model, listed)
    found = answers(nearest.search(model, index, lists, asked))
    own = np.arange(0, len(rows), 500)
    score = rows[own] @ rows.T
    score[np.arange(len(own)), own] = -np.inf
    truth = {int(q): sorted((-s[i], int(i)) for i in np.argsort(-s)[:20]) for q, s in zip(own, score, strict=True)}
    assert check(found, truth) >= 0.95


def test_scan_reads_fewer_values():
    """Candidates are abandoned early, and none that belongs to the best is lost but by the test's error."""
    rows, rng = clustered(1_024, 64, 5, crowd=0, places=16)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    turned = rows @ nearest._rotation(64)
    part = nearest._Part(np.arange(1_024, dtype="<i8").tobytes(), np.full(1_024, 64, "<i4").tobytes(), [np.ascontiguousarray(turned[:, c: c + 16]).tobytes() for c in range(0, 64, 16)],
                         rows.tobytes(), "<f8")
    floor = np.sort(rows[:100] @ rows.T, axis=1)[:, -21]
    q, r, score, read = nearest.scan(part, turned[:100], floor, np.ones((100, 1_024), bool))
    assert np.allclose(score, (rows[q] * rows[r]).sum(axis=1))
    assert (score >= floor[q] - 1e-8).all() and len(q) >= 0.99 * 21 * 100
    assert read < 0.5 * 100 * 1_024 * 64
    everything = nearest.scan(part, turned[:100], np.full(100, -2.0), np.ones((100, 1_024), bool))
    assert len(everything[0]) == 100 * 1_024


def test_edge_cases(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(5).tolist(), 1) for i in range(40)]
    rows += [(40, None, 1), (60, [0.0] * 5, 2), (80, [1.0, None, 0.0, 0.0, 0.0], None), (100, [float("nan")] * 5, 1), (120, [1.0, float("inf"), 0.0, 0.0, 0.0], 1), (140, [], 1)]
    rows += [(20, [1.0, 2.0], 1), (160, [2.0, 1.0], 1), (None, [1.0] * 5, 1)]  # a second vector of id 20, other lengths, no id
    rows += [(200 + i, [3.0, 0.0, 0.0, 0.0, 0.0], 1) for i in range(30)] + [(200, [3.0, 0.0, 0.0, 0.0, 0.0], 1)] * 25  # ties and repeated rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    found = answers(nearest.neighbours(table, table.filter("vec_id % 20 = 0")))
    truth = brute([r[:2] for r in rows], lambda q: q % 20 == 0)
    truth = {q: best for q, best in truth.items() if best}
    lost = {q: {i for _, i in best} - {i for _, i, _ in found.get(q, [])} for q, best in truth.items()}
    assert check(found, truth) >= 0.95, lost
    assert {q: len(v) for q, v in found.items()} == {q: len(v) for q, v in truth.items()}
    assert [i for _, i, _ in found[200]][:3] == [i for _, i in truth[200]][:3]
    empty = nearest.neighbours(table.limit(0), table.limit(0))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    nobody = nearest.neighbours(table, table.filter("vec_id = 40"))
    assert nobody.count() == 0
