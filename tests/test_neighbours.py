"""Neighbours by pivots against brute force, and the share of pairs that is compared."""

from __future__ import annotations

import pathlib
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline import session
from faultline.operators import neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")


def clustered(n, size, seed, places=60):
    rng = np.random.default_rng(seed)
    return 6 * rng.standard_normal((places, size))[rng.integers(places, size=n)] + 0.3 * rng.standard_normal((n, size))


@pytest.mark.parametrize("case", ["clusters", "even", "copies", "grid"])
def test_equals_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(7)
    x = clustered(1_500, 4, 1) if case == "clusters" else rng.standard_normal((1_500, 4))
    if case == "copies":
        x[:500] = x[0]  # a third of the rows in one place
    if case == "grid":
        x = rng.integers(0, 6, size=x.shape).astype(float)  # many ties
    df = frame(spark, x)
    k = 6
    got = {}
    for r in neighbours.nearest(df.filter("id % 3 = 0"), df, k).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["point_id"], r["distance"]))
    for q in range(0, len(x), 3):
        d = ((x[q] - x) ** 2).sum(axis=1)
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:k]
        assert [i for i, _ in got[q]] == want.tolist()
        np.testing.assert_allclose([s for _, s in got[q]], np.sqrt(d[want]))


def compared(queries, points, k):
    sent, placed = neighbours.parted(queries, points, k)
    a, b = (df.groupBy("__part").agg(F.count("*").alias(n)) for df, n in ((sent, "a"), (placed, "b")))
    return a.join(b, "__part").agg(F.sum(F.col("a") * F.col("b"))).first()[0]


def test_few_pairs_are_compared(spark):
    n = 50_000
    df = frame(spark, clustered(n, 8, 2)).repartition(8)
    share = compared(df, df, 5) / n ** 2
    assert share < 0.06, share


def test_small_and_empty_tables(spark):
    df = frame(spark, np.arange(12.0).reshape(6, 2))
    assert neighbours.nearest(df, df, 10).groupBy("query_id").count().filter("count = 5").count() == 6
    assert neighbours.nearest(df, df.limit(0), 3).count() == 0 and neighbours.nearest(df.limit(0), df, 3).count() == 0


def test_piles_of_copies_do_not_crowd_a_pivot(spark):
    n, k = 20_000, 5
    x = clustered(n, 8, 3)
    x[: n // 2] = x[0]  # half the rows are one vector
    df = frame(spark, x).repartition(8)
    kept = neighbours.distinct_enough(df, k)
    assert kept.count() == n // 2 + k + 1
    _, placed = neighbours.parted(df, kept, k)
    assert placed.groupBy("__part").count().agg(F.max("count")).first()[0] < 2_000
    got = neighbours.nearest(df.filter("id IN (0, 3, 9999)"), df, k).orderBy("query_id", "place").collect()
    pile = {q: [r["point_id"] for r in got if r["query_id"] == q] for q in (0, 3, 9999)}
    assert pile == {q: [i for i in range(k + 1) if i != q][:k] for q in (0, 3, 9999)}


def test_wide_vectors_with_ties_equal_brute_force(spark, monkeypatch):
    """64 dimensions, as the embeddings have: rough distances by a product, exact ones for the candidates, ties by id."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(600, 64)).astype(float) * 1e3
    x[:50] = x[0]
    got = neighbours.nearest(frame(spark, x), frame(spark, x), 5).select("query_id", "point_id", "place").collect()
    dist = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(dist, np.inf)
    want = {(q, int(p), i + 1) for q in range(len(x)) for i, p in enumerate(np.lexsort((np.arange(len(x)), dist[q]))[:5])}
    assert {(r["query_id"], r["point_id"], r["place"]) for r in got} == want


def local_bytes(spark):
    """Bytes that Spark holds in its local folders: shuffle and spill files."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = (path for top in manager.localDirs() for path in pathlib.Path(top.getPath()).rglob("*") if path.is_file())
    return sum(path.stat().st_size for path in files if path.exists())


def test_disk_grows_with_rows_not_with_pairs(spark, monkeypatch, tmp_path):
    """Even vectors of 64 dimensions, where pivots leave nearly all pairs: no query is written once a pivot."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "HELD_BLOCKS", 4, raising=False)
    monkeypatch.setattr(neighbours, "ROUND", 3, raising=False)  # 30 blocks: several rounds
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    x = np.random.default_rng(5).standard_normal((1_500, 64))
    df = session.settle(frame(spark, x), "given")
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before, peak, done = local_bytes(spark), [0], threading.Event()

    def watch():
        while not done.wait(0.2):
            peak[0] = max(peak[0], local_bytes(spark))

    watcher = threading.Thread(target=watch)
    watcher.start()
    found = neighbours.nearest(df, df, 3)
    got = {(r["query_id"], r["place"]): r["point_id"] for r in found.collect()}
    done.set()
    watcher.join()
    assert max(peak[0], local_bytes(spark)) - before < 6 * x.nbytes  # 19 times, if queries are written once a pivot
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["given", "nearest"]
    for q in range(0, len(x), 50):
        d = ((x[q] - x) ** 2).sum(axis=1)
        d[q] = np.inf
        assert [got[q, i + 1] for i in range(3)] == np.argsort(d)[:3].tolist()


def test_equal_and_missing_ids():
    """All places with the id of a row are its own; a null equals nothing."""
    rows, places = neighbours._equal_ids(pa.array([7, None, 3, 9]), pa.array([3, 3, 5, 7, None]))
    assert list(zip(rows.tolist(), places.tolist())) == [(0, 3), (2, 0), (2, 1)]


def test_blocks_are_bounded():
    layout = neighbours.cut([4, 1, 0, 2], {0: 5_000, 1: 900, 2: 3, 4: 1_000})
    assert layout == [(4, 0, 0, 1), (1, 0, 0, 1), (0, 1, 1, 3), (2, 2, 4, 1)]


def test_missing_and_uneven_vectors_are_refused():
    assert neighbours._matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).shape == (2, 2) and neighbours._matrix(pa.array([], pa.list_(pa.float64()))).size == 0
    for odd in ([[1.0, 2.0], None], [[1.0], [2.0, 3.0, 4.0]]):
        with pytest.raises(ValueError, match="vectors"):
            neighbours._matrix(pa.array(odd))
