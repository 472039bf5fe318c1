"""Nearest neighbours by largest inner product: an adaptive scan of dimensions within probed lists.

*Fit.* ``SAMPLE`` rows at most give the centroids of lists (k-means); every row goes to the list of its nearest centroid. The
exact neighbours of ``TRIED`` queries at most, taken over all rows, tell how many lists a query has to probe: as many as hold
``RECALL`` of them. That share is kept as ``Model.recall``.

*Index.* Vectors are scaled, turned by one random rotation and stored by list in blocks of rows, column block by column block,
beside the original rows. A list longer than ``PART`` rows is several parts, so that a crowded list is as many units of work.

*Search.* A query goes to the parts of its lists; the nearest list comes first and gives every query the score that a row of
the other lists has to beat. With x and q rotated, the first d of D squared differences, times D / d, estimate the squared
distance, and the distance that would be needed follows from both lengths and the score to beat; where the estimate exceeds it
by more than (1 + EPSILON / sqrt(d)) squared, the hypothesis that the row can still win is rejected and its other columns are
not read. Rows that remain are scored by their original vectors in double precision.

Vectors that are null, zero or hold null or non-finite components take no part; vectors of different lengths don't compare. A
row is no candidate of its own id. Rows that share an id are one candidate with its largest score, and one query with their
common best. Ties go to the smaller id. Fewer candidates than ``k`` are all returned; an empty table gives an empty result.
Columns other than id and vector are not read. Scores beyond the range of a double are infinite.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from faultline.llm.projections import usable
from faultline.session import settle

#: Most rows the centroids are fitted on, and most values of them (rows times components).
SAMPLE, SAMPLE_VALUES = 16_384, 1 << 22
#: Most lists; smaller tables have the square root of their rows.
LISTS = 4_096
#: Most queries whose exact neighbours are looked up to choose the number of probes.
TRIED = 128
#: Share of those neighbours that the probed lists have to hold.
RECALL = 0.98
#: Rows of a stored block, of a part of a list, and queries of a turn.
BLOCK, PART, TURN = 1_024, 4_096, 16_384
#: Columns of a block and significance of the test.
COLUMNS, EPSILON = 16, 2.1
#: Queries compared with a block at once.
GROUP = 128
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SLACK = 1e-9


@dataclasses.dataclass(frozen=True)
class Model:
    """Centroids of the lists (scaled vectors), longest vector and its number of components, probes, and recall among the tried queries."""

    centroids: np.ndarray
    scale: float
    size: int
    probes: int
    recall: float


def matrix(rows: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, zeros after the last component, and their lengths."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width), sizes
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _rotation(size: int, seed: int = 23) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.Philox(key=[seed, size])).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _cluster(rows: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=[5, len(rows)]))
    centroids = rows[np.sort(rng.choice(len(rows), lists, replace=False))]
    for _ in range(rounds):
        near = _nearest(rows, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=lists)
        np.add.at(sums, near, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids ** 2).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[at: at + 1_024] @ centroids.T - half, axis=1) for at in range(0, len(rows), 1_024)] or [np.zeros(0, np.int64)])


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best rows, ties by id, an id once with its largest score."""
    order = np.lexsort((-score, ids, query))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(query[order]) != 0) | (np.diff(ids[order]) != 0)
    order = order[first]
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, equal for equal rows wherever they stand."""
    return np.concatenate([(a[at: at + 4_096] * b[at: at + 4_096]).sum(axis=1) for at in range(0, len(a), 4_096)] or [np.zeros(0)])


def _assigned(sound: DataFrame, centroids: np.ndarray, scale: float, size: int) -> DataFrame:
    kind = sound.schema["vector"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, _ = matrix(batch.column("vector"), size)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(_nearest(rows / scale, centroids).astype(np.int32))],
                                             names=["vec_id", "vector", "list"])

    return sound.mapInArrow(run, f"vec_id long, vector {kind}, list int")


def _held_by(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, sizes: np.ndarray, k: int) -> DataFrame:
    """The exact ``k`` best rows of a few queries with their lists, over all rows."""
    width = queries.shape[1]

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            wide, own = matrix(batch.column("vector"), width)
            names, lists = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy().astype(np.int64)
            for at in range(0, len(wide), 4_096):
                part = slice(at, at + 4_096)
                score = queries @ wide[part].T
                score[(sizes[:, None] != own[None, part]) | (ids[:, None] == names[None, part])] = -np.inf
                if score.shape[1] > k:
                    floor = np.partition(score, -k, axis=1)[:, -k]
                    q, r = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
                else:
                    q, r = np.nonzero(score > -np.inf)
                held = [np.concatenate(x) for x in zip(held, (q, score[q, r], names[part][r], lists[part][r]), strict=True)]
                keep = _best(held[0], held[1], held[2], k)
                held = [x[keep] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["query", "score", "vec_id", "list"])

    found = rows.mapInArrow(run, "query long, score double, vec_id long, list long")
    found = found.groupBy("query", "vec_id").agg(F.max_by("list", "score").alias("list"), F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _order(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lists of each query, the most promising first."""
    return np.argsort(-(rows @ centroids.T), axis=1, kind="stable")


def fit(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
        recall: float = RECALL) -> tuple[Model, DataFrame]:
    """The model and all usable rows with their lists (a table in the shared folder)."""
    sound = usable(vectors, id_col, vector_col)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    n, size, scale, peak = sound.agg(F.count("*"), F.max(F.size("vector")), F.max(norm), F.max(largest)).first()
    if not n:
        return Model(np.zeros((1, 1)), 1.0, 1, 1, 1.0), settle(sound.withColumn("list", F.lit(0)), "listed")
    scale = scale if np.isfinite(scale) and scale > 0 else peak * size ** 0.5
    wanted = max(1, min(SAMPLE, SAMPLE_VALUES // size))
    taken = sound.sample(min(1.0, 1.1 * wanted / n), seed=3).limit(wanted).select("vector") if n > wanted else sound.select("vector")
    rows, _ = matrix(taken.toArrow().column("vector").combine_chunks(), size)
    rows = rows / scale
    centroids = _cluster(rows, max(1, min(LISTS, round(n ** 0.5), len(rows) // 8)))
    listed = settle(_assigned(sound, centroids, scale, size), "listed")
    asked = usable(queries, id_col, vector_col)
    m = asked.count()
    tried = (asked.sample(min(1.0, 1.5 * TRIED / max(m, 1)), seed=4) if m > 1.5 * TRIED else asked).limit(TRIED).toArrow()
    if not tried.num_rows:
        return Model(centroids, scale, size, 1, 1.0), listed
    tried = tried.take(np.unique(tried.column("vec_id").to_numpy(), return_index=True)[1])
    trial, sizes = matrix(tried.column("vector").combine_chunks(), size)
    held = _held_by(listed, tried.column("vec_id").to_numpy(), trial, sizes, k).select("query", "list").toArrow()
    turn = np.argsort(_order(trial / scale, centroids), axis=1)
    needed = np.sort(turn[held.column("query").to_numpy(), held.column("list").to_numpy()])
    probes = 1 + int(needed[min(len(needed), int(np.ceil(recall * len(needed)))) - 1]) if len(needed) else 1
    return Model(centroids, scale, size, probes, float((needed < probes).mean()) if len(needed) else 1.0), listed


def build(model: Model, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored blocks of rotated columns, and the lists with their number of parts."""
    counts = settle(listed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "lists")
    size, scale = model.size, model.scale
    given = "<f4" if listed.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches):
        rotation, held, key = _rotation(size), [], None

        def block():
            ids, rows, sizes = (np.concatenate([x[c] for x in held]) for c in range(3))
            held.clear()
            turned = (rows / scale) @ rotation
            columns = [np.ascontiguousarray(turned[:, c: c + COLUMNS]).astype("<f8").tobytes() for c in range(0, size, COLUMNS)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                                               pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([columns], pa.list_(pa.binary())),
                                               pa.array([rows.astype(given).tobytes()], pa.binary())], names=["list", "part", "ids", "sizes", "columns", "originals"])

        for batch in batches:
            lists, parts, ids = (batch.column(c).to_numpy() for c in ("list", "part", "vec_id"))
            rows, sizes = matrix(batch.column("vector"), size)
            cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(parts) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if key != (lists[lo], parts[lo]):
                    if held:
                        yield block()
                    key = (lists[lo], parts[lo])
                while lo < hi:
                    room = BLOCK - sum(len(x[0]) for x in held)
                    held.append((ids[lo: min(hi, lo + room)], rows[lo: min(hi, lo + room)], sizes[lo: min(hi, lo + room)]))
                    if hi - lo >= room:
                        yield block()
                    lo += room
        if held:
            yield block()

    rows = listed.join(F.broadcast(counts), "list")  # LISTS rows at most
    rows = rows.select("list", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int").alias("part"), "vec_id", "vector")
    rows = rows.repartition("list", "part").sortWithinPartitions("list", "part", "vec_id")
    return settle(rows.mapInArrow(run, "list int, part int, ids binary, sizes binary, columns array<binary>, originals binary"), "index"), counts


class _Part:
    """One stored block as arrays."""

    def __init__(self, ids: bytes, sizes: bytes, columns: list[bytes], originals: bytes, given: str):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i4")
        self.columns = [np.frombuffer(c, "<f8").reshape(len(self.ids), -1) for c in columns]
        self.rows = np.frombuffer(originals, given).reshape(len(self.ids), -1)
        self.norms = [np.einsum("ij,ij->i", c, c) for c in self.columns]
        self.norm = sum(self.norms)


def scan(part: _Part, turned: np.ndarray, floor: np.ndarray, allowed: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (query, row) that may reach their query's ``floor``, their scores in rotated space, and the values read.

    ``turned`` are rotated queries of length 1, ``floor`` the score to beat in their terms, ``allowed`` the pairs that may count.
    """
    size = turned.shape[1]
    needed = 1 + part.norm[None, :] - 2 * floor[:, None]  # squared distance at which a row would reach the floor
    alive = allowed & (needed >= -_SLACK)
    q = r = None
    near, done, read = np.zeros_like(needed), 0, 0
    for column, norm in zip(part.columns, part.norms, strict=True):
        own = turned[:, done: done + column.shape[1]]
        if q is None and 8 * np.count_nonzero(alive) < alive.size:
            q, r = np.nonzero(alive)
            near, needed = near[q, r], needed[q, r]
        if q is None:
            near += np.einsum("ij,ij->i", own, own)[:, None] + norm[None, :] - 2 * (own @ column.T)
            read += alive.size * column.shape[1]
        else:
            for at in range(0, len(q), 65_536):
                gap = own[q[at: at + 65_536]] - column[r[at: at + 65_536]]
                near[at: at + 65_536] += np.einsum("ij,ij->i", gap, gap)
            read += len(q) * column.shape[1]
        done += column.shape[1]
        limit = 1.0 if done == size else (1 + epsilon / np.sqrt(done)) ** 2
        held = near * (size / done) <= limit * needed + _SLACK
        if q is None:
            alive &= held
        else:
            q, r, near, needed = q[held], r[held], near[held], needed[held]
    if q is None:
        q, r = np.nonzero(alive)
        near = near[q, r]
    return q, r, (1 + part.norm[r] - near) / 2, read


def _scanned(units: DataFrame, model: Model, k: int, given: str, epsilon: float) -> DataFrame:
    """Best rows of each query within each unit; blocks come before queries."""
    size, scale = model.size, model.scale

    def answer(parts, ids, queries, sizes, floors):
        length = np.sqrt(((queries / scale) ** 2).sum(axis=1))
        turned = (queries / scale / length[:, None]) @ rotation[size]
        floor = np.where(np.isnan(floors), -np.inf, floors / scale / scale / length)
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for part in parts:
            allowed = (part.ids[None, :] != ids[:, None]) & (part.sizes[None, :] == sizes[:, None])
            low = floor - np.abs(floor) * _SLACK - _SLACK
            q, r, score, _ = scan(part, turned, np.where(np.isfinite(low), low, -2.0), allowed, epsilon)
            # the k best by rotated vectors, ties within rounding included, are scored exactly
            order = np.lexsort((-score, q))
            rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            last = np.full(len(ids), -np.inf)
            last[q[order][rank == k - 1]] = score[order][rank == k - 1]
            near = score >= last[q] - _SLACK
            q, r = q[near], r[near]
            held = [np.concatenate(x) for x in zip(held, (q, _dots(queries[q], part.rows[r].astype(np.float64)), part.ids[r]), strict=True)]
            keep = _best(*held, k)
            held = [x[keep] for x in held]
            rank = np.arange(len(keep)) - np.searchsorted(held[0], held[0])
            full = rank == k - 1
            floor[held[0][full]] = np.maximum(floor[held[0][full]], held[1][full] / scale / scale / length[held[0][full]])
        return pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[2]), pa.array(held[1])], names=["query_id", "vec_id", "score"])

    rotation: dict[int, np.ndarray] = {}

    def run(batches):
        rotation[size] = _rotation(size)
        key, parts, asked = None, [], []

        def flush():
            ids, queries, sizes, floors = (np.concatenate([x[c] for x in asked]) for c in range(4))
            asked.clear()
            for at in range(0, len(ids), GROUP):
                one = slice(at, at + GROUP)
                yield answer(parts, ids[one], queries[one], sizes[one], floors[one].copy())

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "part", "turn")])
            block = batch.column("query_id").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0) | (np.diff(block.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if key != tuple(keys[:, lo]):
                    if asked:
                        yield from flush()
                    key, parts = tuple(keys[:, lo]), []
                here = batch.slice(lo, hi - lo)
                if block[lo]:
                    parts += [_Part(*row.values(), given) for row in here.select(["ids", "sizes", "columns", "originals"]).to_pylist()]
                    continue
                rows, sizes = matrix(here.column("vector"), size)
                asked.append((here.column("query_id").to_numpy(), rows, sizes, here.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)))
                if sum(len(x[0]) for x in asked) >= GROUP:
                    yield from flush()
        if asked:
            yield from flush()

    return units.mapInArrow(run, "query_id long, vec_id long, score double")


def search(model: Model, index: DataFrame, lists: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` best rows of its probed lists."""
    asked = usable(queries, id_col, vector_col).select(F.col("vec_id").alias("query_id"), "vector").filter(F.size("vector") <= model.size)
    kind = asked.schema["vector"].dataType.simpleString()
    centroids, scale, size, probes = model.centroids, model.scale, model.size, model.probes
    given = "<f4" if kind == "array<float>" else "<f8"

    def probed(first: int, last: int):
        def run(batches):
            for batch in batches:
                rows, _ = matrix(batch.column("vector"), size)
                for at in range(0, len(rows), 1_024):
                    near = _order(rows[at: at + 1_024] / scale, centroids)[:, first:last]
                    here = batch.slice(at, len(near)).take(pa.array(np.repeat(np.arange(len(near)), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([here.column("query_id"), here.column("vector"), here.column("floor"), pa.array(near.ravel().astype(np.int32))],
                                                     names=["query_id", "vector", "floor", "list"])
        return run

    def phase(rows: DataFrame, first: int, last: int) -> DataFrame:
        sent = rows.mapInArrow(probed(first, last), f"query_id long, vector {kind}, floor double, list int")
        turns = settle(sent.groupBy("list").agg(F.ceil(F.count("*") / TURN).cast("int").alias("turns")).join(F.broadcast(lists), "list"), "turns")
        sent = (sent.join(F.broadcast(turns), "list").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int"))
                .select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "turn", "query_id", "vector", "floor"))
        blocks = index.join(F.broadcast(turns.drop("parts")), "list").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        units = blocks.unionByName(sent, allowMissingColumns=True).repartition("list", "part", "turn")
        units = units.sortWithinPartitions("list", "part", "turn", F.asc_nulls_first("query_id"))
        spark = index.sparkSession
        before = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, "64")
        try:
            return settle(_scanned(units, model, k, given, epsilon), "scanned")
        finally:
            spark.conf.set(_BATCH, before)

    near = phase(asked.withColumn("floor", F.lit(None).cast("double")), 0, 1)
    if probes > 1:
        floors = _merged(near, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        near = near.unionByName(phase(asked.join(floors, "query_id", "left"), 1, probes))
    return _merged(near, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit, index and search in one: the ``k`` best rows of ``vectors`` for each row of ``queries``."""
    model, listed = fit(vectors, queries, k, id_col, vector_col)
    index, lists = build(model, listed)
    return search(model, index, lists, queries, k, id_col, vector_col)
