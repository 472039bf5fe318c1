"""Exact nearest neighbours by pivots.

Points belong to the nearest of some sampled pivots. Every pivot's number of points, largest distance (radius) and smallest
distances are known, a table as small as the pivots. From a query's distances to the pivots follow

* a bound of its k-th distance: the k-th smallest of (distance to a pivot + distance from there to one of its points);
* the pivots whose points may be nearer: the distance less the radius (triangle inequality), and the distance to the plane that
  parts their points from those of the nearest pivot, are both within the bound.

All other pairs of pivots and queries are dropped before anything is compared. Points and queries are written once, packed in
blocks of bounded size whose pivots are near each other; a query carries a bit for every group of pivots it needs. Blocks then
meet as they are read, without a shuffle, so that disk grows with the rows and not with the pairs. A task keeps the k best points
of each of its queries over all blocks it reads. No side is broadcast, no pair of rows is emitted.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql import types as T

from faultline.functions.keys import uniform
from faultline.session import settle, settled_tables

BLOCK_ROWS = 2048
#: Pivots for as many points as a block holds, and most pivots in all.
PIVOTS, MOST_PIVOTS = 8, 1024
#: Blocks of points that a task holds at once, and how many times as many meet the queries before the k best are written.
HELD_BLOCKS, ROUND = 32, 32
#: Pairs whose difference is held at once.
MEASURED = 65_536
_SLACK = 1e-9
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _blocks(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def _matrix(vectors: pa.Array) -> np.ndarray:
    if vectors.null_count or pc.count_distinct(pc.list_value_length(vectors)).as_py() > 1:
        raise ValueError("vectors must be given, and all of one length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(b.size, 1))  # keeps the difference array small
    for at in range(0, len(a), step):
        out[at: at + step] = np.sqrt(((a[at: at + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def by_pivot(points: DataFrame, pivots: np.ndarray, vector: str = "x") -> DataFrame:
    """Points with ``__part``, the number of their nearest pivot, and ``__away``, their distance from it."""
    schema = T.StructType([*points.schema, T.StructField("__part", T.IntegerType()), T.StructField("__away", T.DoubleType())])

    def place(batches):
        for batch in batches:
            away = _distances(_matrix(batch.column(vector)), pivots)
            part = np.argmin(away, axis=1) if len(away) else np.zeros(0, np.int64)
            columns = [*batch.columns, pa.array(part.astype(np.int32)), pa.array(away[np.arange(len(away)), part] if len(away) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__away"])

    return points.mapInArrow(place, schema)


class Near:
    """Which parts may hold one of the ``k`` nearest points of a query, from a row of statistics a part."""

    def __init__(self, pivots: np.ndarray, stats: Sequence[Row], k: int):
        stats = sorted(stats, key=lambda r: r["__part"])
        self.k, self.parts = k, np.array([r["__part"] for r in stats], np.int32)
        self.reach = np.array([r["radius"] for r in stats])
        # smallest distances from each pivot, filled up with infinity; one more for the query itself
        self.inner = np.full((len(stats), k + 1), np.inf)
        for row, r in enumerate(stats):
            held = sorted(r["inner"])[: k + 1]
            self.inner[row, : len(held)] = held
        self.centres = pivots[self.parts]
        self.apart = _distances(self.centres, self.centres)

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every query the place of its own pivot among ``parts``, and which parts it needs."""
        away = _distances(rows, self.centres)
        bound = (away[:, :, None] + self.inner[None, :, :]).reshape(len(away), -1)
        bound = np.partition(bound, self.k, axis=1)[:, self.k] * (1 + _SLACK) + _SLACK
        own = np.argmin(away, axis=1)
        # distance to the plane half-way between the query's own pivot and another one
        plane = (away ** 2 - away[np.arange(len(away)), own][:, None] ** 2) / np.maximum(2 * self.apart[own], 1e-300)
        return own, (away - self.reach[None, :] <= bound[:, None]) & (plane * (1 - _SLACK) - _SLACK <= bound[:, None])

    def chain(self) -> list[int]:
        """All parts, each followed by the nearest one that is left."""
        left, at, order = np.ones(len(self.parts), bool), 0, []
        for _ in range(len(self.parts)):
            left[at] = False
            order.append(int(self.parts[at]))
            at = int(np.argmin(np.where(left, self.apart[at], np.inf)))
        return order


def to_pivots(queries: DataFrame, near: Near, vector: str = "x") -> DataFrame:
    """Queries once for every pivot (``__part``) that may hold one of their nearest points."""
    schema = T.StructType([*queries.schema, T.StructField("__part", T.IntegerType())])

    def send(batches):
        for batch in batches:
            rows = _matrix(batch.column(vector))
            for at in range(0, len(rows), 256):
                query, part = np.nonzero(near(rows[at: at + 256])[1])
                here = batch.slice(at, min(256, len(rows) - at)).take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*here.columns, pa.array(near.parts[part])], names=[*batch.schema.names, "__part"])

    return queries.mapInArrow(send, schema)


def with_groups(queries: DataFrame, near: Near, groups: dict[int, int], vector: str = "x") -> DataFrame:
    """Queries with ``__part``, their own pivot, and ``__near``, a bit for every group of pivots that they need."""
    schema = T.StructType([*queries.schema, T.StructField("__part", T.IntegerType()), T.StructField("__near", T.BinaryType())])
    group = np.array([groups[int(p)] for p in near.parts])
    count = int(group.max()) + 1

    def mark(batches):
        for batch in batches:
            rows = _matrix(batch.column(vector))
            for at in range(0, len(rows), 256):
                own, needed = near(rows[at: at + 256])
                bits = np.zeros((len(own), count), bool)
                query, part = np.nonzero(needed)
                bits[query, group[part]] = True
                here, packed = batch.slice(at, len(own)), np.packbits(bits, axis=1)
                added = [pa.array(near.parts[own]), pa.array([row.tobytes() for row in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays([*here.columns, *added], names=[*batch.schema.names, "__part", "__near"])

    return queries.mapInArrow(mark, schema)


def place(points: DataFrame, k: int, vector: str = "x", seed: int = 0) -> tuple[DataFrame, Near | None, dict[int, int]]:
    """Points with ``__part``, written once, which parts a query needs (None: there is one part only), and the rows of each part."""
    n = points.count()
    wanted = 1 if n <= BLOCK_ROWS else min(MOST_PIVOTS, PIVOTS * _blocks(n))
    pivots = np.zeros((0, 1))
    if wanted > 1:
        sample = points.select(vector).sample(min(1.0, 2 * wanted / n), seed=seed).limit(wanted).toArrow()
        pivots = np.unique(_matrix(sample.column(vector).combine_chunks()), axis=0)
    if not len(pivots):
        return points.withColumn("__part", F.lit(0)), None, {0: n}
    placed = settle(by_pivot(points, pivots, vector), "pivots")
    inner = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__away"))).filter(F.col("__rank") <= k + 1)
    inner = inner.groupBy("__part").agg(F.collect_list("__away").alias("inner"))
    stats = placed.groupBy("__part").agg(F.max("__away").alias("radius"), F.count("*").alias("rows")).join(inner, "__part").collect()  # a row a pivot
    return placed.drop("__away"), Near(pivots, stats, k), {r["__part"]: r["rows"] for r in stats}


def parted(queries: DataFrame, points: DataFrame, k: int, vector: str = "x", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Queries and points with ``__part``; only rows of equal parts need to be compared. Points are written once."""
    placed, near, _ = place(points, k, vector, seed)
    return (queries.withColumn("__part", F.lit(0)) if near is None else to_pivots(queries, near, vector)), placed


def distinct_enough(points: DataFrame, k: int, id_col: str = "id", vector: str = "x") -> DataFrame:
    """Of equal vectors only the ``k + 1`` with the smallest ids: the others are never among the ``k`` nearest other points of a
    query, since ties go to smaller ids and a query passes over at most itself. Piles of copies thus neither crowd one pivot nor
    are compared with each other; the limit is applied in every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(vector).orderBy(id_col))
    return points.withColumn("__copy", rank).filter(F.col("__copy") <= k + 1).drop("__copy")


def cut(order: Sequence[int], rows: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(part, group, first block, blocks): neighbours in the order share a group of one block while it has room for them; a part
    with more rows than a block holds is a group of several blocks."""
    out, group, block, held = [], -1, 0, 0
    for part in order:
        n = rows.get(part, 0)
        if not out or held + n > BLOCK_ROWS:
            group, block, held = group + 1, block + (out[-1][3] if out else 0), 0
        out.append((part, group, block, _blocks(n)))
        held += n
    return out


def blocks_of(df: DataFrame, layout: Sequence[tuple[int, int, int, int]], id_col: str, seed: int) -> DataFrame:
    """Rows with ``__group`` and ``__block``."""
    table = F.broadcast(df.sparkSession.createDataFrame(list(layout), "__part int, __group int, __first int, __blocks int"))  # a row a pivot
    turn = F.floor(uniform(seed, F.col(id_col)) * F.col("__blocks")).cast("int")
    return df.join(table, "__part").withColumn("__block", F.col("__first") + turn).drop("__part", "__first", "__blocks")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """One list of all values."""
    values = column.combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed(df: DataFrame, prefix: str, id_col: str, vector: str, carry: Sequence[str] = ()) -> DataFrame:
    """A row a block: ids in their order, the vectors as bytes of doubles, and lists of the other columns."""
    marked = "__near" in df.columns
    listed = dict.fromkeys([id_col, *carry])
    schema = T.StructType([
        T.StructField(f"{prefix}_block", T.IntegerType()), T.StructField(f"{prefix}_rows", T.BinaryType()),
        *[T.StructField(f"{prefix}_{c}", T.ArrayType(df.schema[c].dataType)) for c in listed],
        *([T.StructField(f"{prefix}_near", T.BinaryType()), T.StructField(f"{prefix}_groups", T.ArrayType(T.IntegerType()))] if marked
          else [T.StructField(f"{prefix}_group", T.IntegerType())]),
    ])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(id_col, "ascending")], null_placement="at_end"))
        x = _matrix(rows.column(vector).combine_chunks())
        columns = [rows.column("__block")[:1], pa.array([x.tobytes()], pa.binary()), *[_whole(rows.column(c)) for c in listed]]
        if marked:
            near = b"".join(rows.column("__near").to_pylist())
            bits = np.unpackbits(np.frombuffer(near, np.uint8).reshape(len(rows), -1), axis=1).any(axis=0)
            columns += [pa.array([near], pa.binary()), pa.array([np.flatnonzero(bits).astype(np.int32)])]
        else:
            columns += [rows.column("__group")[:1]]
        return pa.Table.from_arrays(columns, names=schema.names)

    return df.groupBy("__block").applyInArrow(pack, schema)


def _equal_ids(own: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``own`` and places of ``ids`` (in their order, nulls last) with equal ids; a null equals nothing."""
    held = ids.slice(0, len(ids) - ids.null_count).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
    asked = own.drop_null().to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(held, asked, side="left"), np.searchsorted(held, asked, side="right")
    rows = np.repeat(np.arange(len(asked)), high - low)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[rows]
    return at[rows], places


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """Of ascending row numbers the first ``k`` of each."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k


def candidates(a: np.ndarray, b: np.ndarray, same: tuple[np.ndarray, np.ndarray], k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, place in ``b``, squared distance) of the ``k`` nearest of every row, without the pairs ``same`` and without those
    beyond the squared distance ``limit`` of the row.

    Rough squared distances come by one product; every point that may be among the k nearest is then measured exactly.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        a_squares, b_squares = (a * a).sum(axis=1), (b * b).sum(axis=1)
        largest = np.abs(b_squares).max(initial=0.0)
        rough = np.column_stack([-2.0 * a, np.ones(len(a))]) @ np.column_stack([b, b_squares]).T  # less the row's own square
        rough[same] = np.inf
        slack = 1e-9 * (np.abs(a_squares) + largest)  # far above the rounding of the product
        limit = limit - a_squares + slack
        if len(open_rows := np.flatnonzero(~np.isfinite(limit))):
            held = min(k, len(b)) - 1
            kth = np.partition(rough[open_rows], held, axis=1)[:, held] + slack[open_rows]
            limit[open_rows] = np.where(np.isnan(kth), np.inf, kth)
        may = rough <= limit[:, None]
        if not (a_squares.max(initial=0.0) < 1e300 and largest < 1e300):  # the product may have overflowed
            may |= ~np.isfinite(rough)
        may[same] = False
        rows, places = np.nonzero(may)
        dist = np.empty(len(rows))
        for at in range(0, len(rows), MEASURED):
            part = slice(at, at + MEASURED)
            dist[part] = ((a[rows[part]] - b[places[part]]) ** 2).sum(axis=1)
    rows, places, dist = (x[np.isfinite(dist)] for x in (rows, places, dist))
    order = np.lexsort((places, dist, rows))  # ties to the smaller id: places are in the order of the ids
    rows, places, dist = rows[order], places[order], dist[order]
    taken = _first(rows, k)
    return rows[taken], places[taken], dist[taken]


class Best:
    """The ``k`` nearest points found so far of every query of a block."""

    def __init__(self, batch: pa.RecordBatch, at: int, k: int, id_col: str, carry: Sequence[str]):
        self.k, self.id_col, self.carry = k, id_col, carry
        self.block, self.ids = batch.column("q_block")[at].as_py(), batch.column(f"q_{id_col}")[at].values
        self.x = np.frombuffer(batch.column("q_rows")[at].as_buffer()).reshape(len(self.ids), -1)
        self.near = np.unpackbits(np.frombuffer(batch.column("q_near")[at].as_buffer(), np.uint8).reshape(len(self.ids), -1), axis=1).astype(bool)
        self.limit = np.full(len(self.ids), np.inf)
        self.found: pa.Table | None = None

    def meet(self, batch: pa.RecordBatch, at: int) -> None:
        needed = np.flatnonzero(self.near[:, batch.column("p_group")[at].as_py()])
        if not len(needed):
            return
        ids = batch.column(f"p_{self.id_col}")[at].values
        points = np.frombuffer(batch.column("p_rows")[at].as_buffer()).reshape(len(ids), -1)
        same = _equal_ids(self.ids.take(pa.array(needed)), ids)
        rows, places, dist = candidates(self.x[needed], points, same, self.k, self.limit[needed])
        if not len(rows):
            return
        taken = pa.array(places)
        new = pa.table([pa.array(needed[rows]), ids.take(taken), pa.array(dist), *[batch.column(f"p_{c}")[at].values.take(taken) for c in self.carry]],
                       names=["row", "point_id", "dist", *[f"c_{c}" for c in self.carry]])
        both = new if self.found is None else pa.concat_tables([self.found, new])
        both = both.take(pc.sort_indices(both, [("row", "ascending"), ("dist", "ascending"), ("point_id", "ascending")]))
        both = both.filter(pa.array(_first(both.column("row").to_numpy(), self.k)))
        row = both.column("row").to_numpy()
        full = np.flatnonzero(np.bincount(row, minlength=len(self.ids)) >= self.k)
        last = np.searchsorted(row, full, side="right") - 1
        self.limit[full] = both.column("dist").to_numpy()[last]
        self.found = both

    def rows(self, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
        if self.found is not None:
            found = self.found
            columns = [self.ids.take(pa.array(found.column("row").to_numpy())), found.column("point_id"), pa.array(np.sqrt(found.column("dist").to_numpy())),
                       *[found.column(f"c_{c}") for c in self.carry]]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()


@contextlib.contextmanager
def _blocks_a_batch(spark: SparkSession, blocks: int = 4) -> Iterator[None]:
    """Within the block, Python workers get a few rows at a time, because a row is a block of vectors."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(blocks))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def nearest(
    queries: DataFrame, points: DataFrame, k: int, id_col: str = "id", vector: str = "x", carry: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """The ``k`` nearest other points of every query: (query_id, point_id, distance, place, carry...).

    Ties are ordered by point id. ``carry`` columns of the point come along. The result is written; the tables on the way to it
    are removed.
    """
    id_type = queries.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("query_id", id_type), T.StructField("point_id", id_type), T.StructField("distance", T.DoubleType()),
        *[points.schema[c] for c in carry],
    ])
    with settled_tables(keep_last=True):
        return _nearest(queries, points, k, id_col, vector, carry, seed, schema)


def _nearest(queries: DataFrame, points: DataFrame, k: int, id_col: str, vector: str, carry: Sequence[str], seed: int, schema: T.StructType) -> DataFrame:
    held = settle(distinct_enough(points.select(*dict.fromkeys([id_col, vector, *carry])), k, id_col, vector), "points")
    placed, near, sizes = place(held, k, vector, seed)
    order = [0] if near is None else near.chain()
    layout = cut(order, sizes)
    total = layout[-1][2] + layout[-1][3]
    p = settle(packed(blocks_of(placed, layout, id_col, seed), "p", id_col, vector, carry), "point-blocks", maxRecordsPerFile="8")
    asked = queries.select(id_col, vector)
    if near is None:
        asked = asked.withColumns({"__part": F.lit(0), "__near": F.unhex(F.lit("80"))})  # the bit of the one group
    else:
        asked = with_groups(asked, near, {part: group for part, group, _, _ in layout}, vector)
    asked = settle(asked, "queries")
    turns = cut(order, {r["__part"]: r["count"] for r in asked.groupBy("__part").count().collect()})  # a row a pivot
    q = settle(packed(blocks_of(asked, turns, id_col, seed).drop("__group"), "q", id_col, vector), "query-blocks",
               maxRecordsPerFile=str(max(1, (turns[-1][2] + turns[-1][3]) // 256)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for at in range(batch.num_rows):
                if best is None or best.block != batch.column("q_block")[at].as_py():
                    if best is not None:
                        yield from best.rows(schema.names)
                    best = Best(batch, at, k, id_col, carry)
                best.meet(batch, at)
        if best is not None:
            yield from best.rows(schema.names)

    ranked = Window.partitionBy("query_id").orderBy("distance", "point_id")
    found = None
    for at in range(0, total, HELD_BLOCKS * ROUND):
        some = p.filter(F.col("p_block").between(at, at + HELD_BLOCKS * ROUND - 1)).coalesce(-(-min(total - at, HELD_BLOCKS * ROUND) // HELD_BLOCKS))
        # every task reads its blocks from the two tables
        pairs = q.join(some.hint("shuffle_replicate_nl"), F.array_contains("q_groups", F.col("p_group")))
        new = pairs.mapInArrow(compare, schema)
        new = new if found is None else found.drop("place").unionByName(new)
        with _blocks_a_batch(queries.sparkSession):
            found = settle(new.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k), "nearest")
    return found
