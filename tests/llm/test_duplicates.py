"""Jaccard join, components and vector links against plain versions."""

from __future__ import annotations

import collections
import math
import pathlib
import random
import re
import sys
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from cases import ROWS, documents  # noqa: E402

from faultline.llm import jaccard, projections  # noqa: E402
from faultline.llm.components import components, contract  # noqa: E402

SMALL = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(SMALL))
    return {tuple(words[i: i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def united(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute(rows):
    """Set size and smallest id reachable, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root, least = united(len(rows), links), {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root[i]) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def ours(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def edited(draw, words, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"x{draw.randrange(10 ** 6)}"
    return " ".join(out)


def test_hand_made_cases(spark):
    assert ours(jaccard.near_duplicates(documents(spark))) == brute([(r[0], r[1]) for r in ROWS])
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0


def test_near_copies_of_all_sizes(spark):
    draw = random.Random(8)
    rows = []
    for size in [4, 5, 7, 9, 12, 20, 40, 80, 160, 400, 900]:
        base = [f"w{draw.randrange(5000)}" for _ in range(size)]
        rows += [edited(draw, base, k) for k in [0, 0, 1, 1, 1, 2, 2, 3, max(1, size // 60), max(1, size // 40), max(1, size // 30), max(1, size // 25)]]
        rows += [" ".join(base[: int(size * share)]) for share in (0.8, 0.85, 0.86, 0.9)] + [" ".join(base) + " tail" * draw.randrange(1, 9)]
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"own{i}-{j}" for j in range(draw.randrange(1, 40))) for i in range(40)]
    rows = list(enumerate(rows))
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(jaccard.near_duplicates(docs)) == brute(rows)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert ours(jaccard.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_one_row_of_each_component_stays(spark):
    docs = documents(spark)
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    expected = collections.Counter()
    for doc_id, n, component in set(brute([(r[0], r[1]) for r in ROWS])):
        expected[doc_id] += n == 0 or doc_id == component
    assert collections.Counter(str(r["doc_id"]) for r in kept.collect()) == +expected
    assert jaccard.deduplicated(documents(spark, [])).count() == 0


def test_a_shared_passage_makes_no_crowd(spark):
    draw = random.Random(17)
    shared = [f"s{i}" for i in range(104)]
    rows = []
    for i in range(20_000):
        own = [f"w{draw.randrange(10**9)}" for _ in range(100)]
        rows.append((i, " ".join(shared + own)))
        if i % 1000 == 0:  # near copies among them, two words apart
            own[50] = own[90] = f"x{i}"
            rows.append((100_000 + i, " ".join(shared + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/passage")
    docs = spark.read.parquet(path)
    compared = []

    def counted(*args):
        groups = plain(*args)
        sizes = [r["n"] for r in groups.groupBy("part").count().withColumnRenamed("count", "n").collect()]
        compared.append(sum(n * (n - 1) // 2 for n in sizes))
        return groups

    plain, jaccard.open_groups = jaccard.open_groups, counted
    try:
        result = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    finally:
        jaccard.open_groups = plain
    assert result == {i: i % 100_000 for i, _ in rows}
    assert sum(compared) < 100 * len(rows)


def test_rarest_shingles_of_similar_sets_meet():
    draw = np.random.default_rng(23)
    counts = draw.integers(0, 5, jaccard.BUCKETS)
    for _ in range(2000):
        n, percent = int(draw.integers(1, 60)), int(draw.choice([50, 80, 85, 100]))
        a = np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64))
        keep = a[draw.random(len(a)) < draw.uniform(0.7, 1.0)]
        b = np.unique(np.concatenate([keep, draw.integers(0, 1 << 62, int(draw.integers(0, 8))).astype(np.uint64)]))
        if len(b) and jaccard.similar(a, b, percent):
            assert set(jaccard.rarest(a, counts, percent).tolist()) & set(jaccard.rarest(b, counts, percent).tolist())


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_segments_never_lose_a_pair(percent):
    draw = np.random.default_rng(percent)
    for _ in range(3000):
        n = int(draw.integers(1, 120))
        base = draw.integers(0, 1 << 60, n).astype(np.uint64)
        cut = base[draw.random(n) > draw.random() * 0.5]
        other = np.concatenate([cut, draw.integers(0, 1 << 60, int(draw.integers(0, 12))).astype(np.uint64)])
        a, b = np.unique(base), np.unique(other)
        if len(b) and jaccard.similar(a, b, percent):
            assert set(jaccard.segment_keys(a, percent).tolist()) & set(jaccard.segment_keys(b, percent).tolist())


def test_components(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(draw.randrange(2000, 4000), draw.randrange(2000, 4000)) for _ in range(1500)] + [(9, 9), (5000, 5000)]
    root = united(5001, links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {n: root[n] for pair in links for n in pair}
    assert components(df.limit(0)).count() == 0
    node, least = contract(*(np.array(x) for x in zip(*links, strict=True)))
    assert dict(zip(node.tolist(), least.tolist(), strict=True)) == {n: r for n, r in got.items() if n != r}


VECTORS = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.1]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [1.0, None, 0.0]),
           (7, [0.0, 1e30, 0.0]), (8, [0.0, 3e30, 1e29]), (9, [float("inf"), 0.0, 0.0]), (10, [0.0, 0.0, 1.0]), (11, [1.0, 0.0]), (12, [1.0, 0.01])]


def test_vectors_hand_made(spark):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in VECTORS], "vec_id long, embedding array<double>, node long, root long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in projections.near_duplicates(df).collect()}
    linked = {1: (1, 1, True), 2: (1, 1, False), 7: (1, 7, True), 8: (1, 7, False), 11: (1, 11, True), 12: (1, 11, False)}
    assert got == {i: linked.get(i, (0, i, True)) for i, _ in VECTORS}
    assert projections.near_duplicates(df.limit(0)).count() == 0


def test_vectors_recall_and_counts(spark):
    draw = np.random.default_rng(6)
    parts = [draw.standard_normal((3000, 48))]
    for size, noise in [(2, 0.1), (2, 0.2), (5, 0.25), (40, 0.1), (300, 0.2), (200, 0.31)]:
        for _ in range(20 if size < 10 else 1):
            parts.append(draw.standard_normal(48) + noise * draw.standard_normal((size, 48)))
    x = np.concatenate(parts).astype(np.float32)
    order = draw.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(order, x, strict=True)], "vec_id long, embedding array<float>").repartition(6)
    got = {r["vec_id"]: r for r in projections.near_duplicates(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    counts = np.array([got[int(i)]["n_links"] for i in order])
    assert (counts <= near.sum(1)).all() and counts.sum() >= 0.9 * near.sum()


def _isolated_pairs(draw, n, pairs, size, cosine):
    """``n`` unit vectors; of the first ``2 * pairs``, i and i + pairs have the given cosine."""
    x = draw.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[:pairs], x[pairs: 2 * pairs]
    b -= (a * b).sum(1)[:, None] * a
    x[pairs: 2 * pairs] = cosine * a + math.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
    return x


def _vector_table(spark, path, ids, x):
    column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(ids), "embedding": column}), path, row_group_size=10_000)
    return spark.read.parquet(str(path))


def test_isolated_pairs_of_a_large_table_are_found(spark, tmp_path):
    pairs = 3000
    x = _isolated_pairs(np.random.default_rng(12), 100_000, pairs, 64, 0.9005)
    df = _vector_table(spark, tmp_path / "vectors.parquet", np.arange(len(x)), x)
    got = {r["vec_id"]: r for r in projections.near_duplicates(df).filter(f"vec_id < {2 * pairs}").collect()}
    recall = np.mean([got[i + pairs]["component_id"] == i and got[i]["n_links"] == 1 for i in range(pairs)])
    print(f"recall {recall:.4f} with {projections.passes_for(len(x))} passes")
    assert recall >= 0.98
    assert projections.passes_for(1_000_000) > projections.passes_for(100_000) > projections.PASSES


@pytest.mark.parametrize("common", [0.5, 0.7])
def test_a_common_direction_hides_no_pairs(spark, tmp_path, common):
    """Vectors whose cosines are ``common`` on average; of the first, i and i + pairs have the cosine 0.9005."""
    pairs, n, draw = 2000, 100_000, np.random.default_rng(14)
    rest = _isolated_pairs(draw, n, pairs, 63, (0.9005 - common) / (1 - common))
    x = np.concatenate([np.full((n, 1), math.sqrt(common)), math.sqrt(1 - common) * rest], axis=1)
    turn = np.linalg.qr(draw.standard_normal((64, 64)))[0]
    df = _vector_table(spark, tmp_path / "vectors.parquet", np.arange(n), x @ turn)
    got = {r["vec_id"]: r["component_id"] for r in projections.near_duplicates(df).filter(f"vec_id < {2 * pairs}").collect()}
    recall = np.mean([got[i + pairs] == got[i] for i in range(pairs)])
    print(f"recall {recall:.4f} at mean cosine {common}")
    assert recall >= 0.95


def test_made_partners_and_passes_for_uneven_chances():
    draw = np.random.default_rng(15)
    x = draw.standard_normal((300, 32)) + 1.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    sizes = np.full(300, 32)
    means = projections.means_of(x, sizes)
    other = projections.partners(x, sizes, means, 0.9)
    assert np.allclose((x * other).sum(1), 0.9, atol=1e-6) and np.allclose(np.linalg.norm(other, axis=1), 1)
    even = projections.passes_to_meet(draw.binomial(64, 0.2, 5000), 64, 0.99)
    assert abs(even - math.log(0.01) / math.log(0.8)) <= 2
    chance = np.where(np.arange(5000) % 2, 0.5, 0.05)
    uneven = projections.passes_to_meet(draw.binomial(64, chance), 64, 0.95)
    assert np.mean(1 - (1 - chance) ** uneven) >= 0.95
    assert projections.passes_to_meet(np.full(9, 64), 64) <= 2


def test_copies_hide_no_links(spark, tmp_path):
    pairs, copies = 500, 30
    x = _isolated_pairs(np.random.default_rng(13), 2 * pairs, pairs, 16, 0.97)
    df = _vector_table(spark, tmp_path / "vectors.parquet", np.arange(2 * pairs * copies), np.tile(x, (copies, 1)))
    unit = x.astype(np.float32).astype(float)
    near = unit @ unit.T >= 0.9 * np.outer(np.linalg.norm(unit, axis=1), np.linalg.norm(unit, axis=1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in projections.near_duplicates(df).collect()}
    root = united(len(x), np.argwhere(np.triu(near, 1)).tolist())
    expected = {i: (int(near[i % len(x)].sum()) * copies - 1, root[i % len(x)]) for i in range(len(x) * copies)}
    assert got == expected


def test_equal_ids_and_copies(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.05])]
    got = sorted(tuple(r) for r in projections.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 3, False), (5, 1, 3, False)]
