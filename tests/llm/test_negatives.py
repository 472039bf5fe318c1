"""Hard negatives against the plain definition, in whole numbers of any size."""

from __future__ import annotations

import math

import numpy as np
import pytest

from faultline.llm import negatives


def brute(rows, wanted):
    """By definition, with Python's integers; ``rows`` of (id, vector, label)."""
    sound = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
             if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for a, x, label in sound:
        if not wanted(a):
            continue
        score = lambda y: min(max(sum(p * q for p, q in zip(x, y, strict=True)), -(1 << 63) + 1), (1 << 63) - 1)  # noqa: B023, E731
        near = sorted(((-score(y), b, other) for b, y, other in sound if b != a and len(x) == len(y)))
        for p, b, _ in [r for r in near if r[2] == label][:5]:
            hard = [r for r in near if r[2] != label and 80 * -p <= 100 * -r[0] <= 100 * -p][:5]
            out += [(a, b, rank + 1, n, -p, -s) for rank, (s, n, _) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, wanted="vec_id % 10 = 0", kind="double"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    sound = negatives.sound(table.withColumn("slot", table["vec_id"]).withColumn("score", table["label"]))
    return sorted(map(tuple, negatives.mine(sound, sound.filter(wanted)).collect()))


@pytest.mark.parametrize("case", ["even", "clusters", "offset", "integers"])
def test_equals_definition(spark, case):
    rng = np.random.default_rng(4)
    n = 2_300
    x = rng.standard_normal((n, 20)) / 4
    if case == "clusters":  # a third of the rows in one place and under one label
        x = rng.standard_normal((12, 20))[np.where(rng.random(n) < 1 / 3, 0, rng.integers(12, size=n))] + x / 8
    if case == "offset":
        x += 0.5
    if case == "integers":  # many ties
        x = rng.integers(-1, 2, size=(n, 20)) / 256
    label = np.where(rng.random(n) < 1 / 3, 0, rng.integers(6, size=n))
    rows = [(i, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), label.tolist(), strict=True))]
    assert mined(spark, rows, "vec_id % 50 = 0") == brute(rows, lambda i: i % 50 == 0) != []


def test_edge_cases(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(4) + 0.4).tolist(), int(i % 3)) for i in range(60)]
    rows += [(100, None, 1), (110, [0.0] * 4, 1), (120, [1.0, None, 0.0, 0.0], 1), (130, [float("nan")] * 4, 1), (140, [1.0, 1.0, 1.0, 1.0], None),
             (150, [], 1), (160, [1.0, 2.0], 0), (161, [1.0, 2.0], 0), (162, [1.0, 1.9], 1), (None, [1.0] * 4, 1), (170, [0.3] * 4, 7)]
    rows += [(300 + i, [2.0, 2.0, 0.0, 0.0], i % 2) for i in range(14)]  # ties
    rows += [(400, [0.5] * 4, 1)] * 3 + [(401, [0.5] * 4, 1)] * 7 + [(402, [0.5] * 4, 2)] * 7  # repeated rows
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, rows, "vec_id = 100") == []


def test_large_components(spark):
    rows = [(i, [float(1 + i % 5) * 10.0 ** (6 + i % 9), 3.0, -2.0], i % 2) for i in range(40)] + [(50, [1e300, -1e300, 0.0], 0), (60, [1e300, 1e300, 0.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []


def test_join_leaves_products_out():
    rng = np.random.default_rng(2)
    weight = np.exp(-np.arange(64) / 8)
    x = np.floor(256 * rng.standard_normal((1_024, 64)) * weight)
    order = np.argsort(-(x ** 2).sum(axis=0))
    arrays = [np.arange(1_024, dtype="<i8"), np.zeros(1_024, "<i8"), np.full(1_024, 64, "<i8"), order.astype("<i8")]
    block = negatives._Block(*(a.tobytes() for a in arrays), [np.ascontiguousarray(x[:, order[c: c + 16]]).astype("<f8").tobytes() for c in range(0, 64, 16)])
    score = (x[:100] @ x.T).astype(np.int64)
    low = np.sort(score, axis=1)[:, -10]
    a, r, s, made = negatives.threshold_pairs(block, x[:100], low, np.ones((100, 1_024), bool))
    assert set(zip(a.tolist(), r.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(score >= low[:, None])), strict=True))
    assert (s == score[a, r]).all() and made < 0.6 * score.size * 64
    high = negatives.threshold_pairs(block, x[:100], np.full(100, score.max() * 100), np.ones((100, 1_024), bool))
    assert len(high[0]) == 0 and high[3] == 0
