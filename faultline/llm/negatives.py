"""Hard negatives by threshold joins of anchors with all rows.

An anchor's positives are its nearest rows of the same label; for each positive the hard negatives are the nearest rows of
other labels whose score lies between a share of the positive's score and that score. Scores are inner products of integer
vectors (256 times the component, rounded down), so that all comparisons are exact.

Rows are dealt into slots and stored in blocks, column group by column group, the groups of most weight first, with the norm of
each row's remaining columns (its suffixes). A join at threshold t is a pass over the groups: a row is listed under a group
only while its suffix could still reach t with the longest anchor, so columns that the suffix norm covers are left out;
partial scores are accumulated over the lists, pairs whose partial score plus the product of both remaining norms stays below
their anchor's t are dropped, and those that remain get the columns that were left out.

Thresholds start high and are lowered for anchors whose windows aren't full yet. Positives: one slot is searched in full; its
best row of the label is the first threshold for the others, its last one, which suffices by itself, the second. Negatives: the
first threshold lies half-way down the window of the last positive, the second at its end.

Rows with a null id, label or vector, or with a null or non-finite component, take no part; zero vectors do, and vectors of
different lengths aren't compared. Rows of the anchor's own id are none of its positives or negatives; other repeated rows
count one by one, and an id with several anchor rows is mined for each. Ties go to the smaller id. Scores saturate at the
range of a 64-bit integer. Columns other than id, vector and label are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.nearest import matrix
from faultline.session import settle

#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: Most rows of a slot, rows of a block, anchors of a turn, anchors compared with a block at once, columns of a group.
SLOT, BLOCK, TURN, GROUP, COLUMNS = 32_768, 1_024, 16_384, 128, 16
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOWEST, _HIGHEST = -(1 << 63) + 1, (1 << 63) - 1
_EXACT = float(1 << 52)


def sound(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` of the rows that take part."""
    given = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col).cast(given if given == "array<float>" else "array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def whole(rows: np.ndarray) -> np.ndarray:
    """256 times each component, rounded down (as doubles)."""
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * rows), -top, top)


def _suffixes(columns: list[np.ndarray]) -> np.ndarray:
    """Norm of each row's columns from every group on, and 0 after the last."""
    with np.errstate(over="ignore"):
        squares = np.stack([np.einsum("ij,ij->i", c, c) for c in columns] + [np.zeros(len(columns[0]))])
        return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


class _Block:
    """Rows of a slot: ids, labels and lengths, columns in groups of falling weight, and suffix norms."""

    def __init__(self, ids: bytes, labels: bytes, sizes: bytes, order: bytes, columns: list[bytes]):
        self.ids, self.labels, self.sizes, self.order = (np.frombuffer(x, "<i8") for x in (ids, labels, sizes, order))
        self.columns = [np.frombuffer(c, "<f8").reshape(len(self.ids), -1) for c in columns]
        self.suffix = _suffixes(self.columns)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (slot, vec_id, label, vector) as blocks, by slot and label."""
    def run(batches):
        held, key = [], None

        def block():
            ids, labels, sizes, vectors = (np.concatenate([x[c] for x in held]) for c in range(4))
            held.clear()
            with np.errstate(over="ignore"):
                order = np.argsort(-(vectors ** 2).sum(axis=0), kind="stable")
            turned = vectors[:, order]
            columns = [np.ascontiguousarray(turned[:, c: c + COLUMNS]).astype("<f8").tobytes() for c in range(0, size, COLUMNS)]
            parts = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, labels, sizes, order)]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *parts, pa.array([columns], pa.list_(pa.binary()))],
                                              names=["slot", "ids", "labels", "sizes", "order", "columns"])

        for batch in batches:
            slots, ids, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("slot", "vec_id", "label"))
            vectors, sizes = matrix(batch.column("vector"), size)
            vectors = whole(vectors)
            cuts = np.flatnonzero(np.diff(slots)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if key != slots[lo]:
                    if held:
                        yield block()
                    key = int(slots[lo])
                while lo < hi:
                    room = BLOCK - sum(len(x[0]) for x in held)
                    held.append(tuple(x[lo: min(hi, lo + room)] for x in (ids, labels, sizes, vectors)))
                    if hi - lo >= room:
                        yield block()
                    lo += room
        if held:
            yield block()

    placed = rows.repartition("slot").sortWithinPartitions("slot", "label", "vec_id")
    return placed.mapInArrow(run, "slot long, ids binary, labels binary, sizes binary, order binary, columns array<binary>")


def threshold_pairs(block: _Block, anchors: np.ndarray, low: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Allowed pairs (anchor, row) whose score reaches the anchor's ``low``, their scores, and the number of products made."""
    turned = anchors[:, block.order]
    cuts = np.cumsum([0] + [c.shape[1] for c in block.columns])
    own = [turned[:, lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    rest = _suffixes(own)
    if rest[0].max(initial=0) * block.suffix[0].max(initial=0) >= _EXACT:
        a, r = np.nonzero(allowed)
        rows = np.concatenate(block.columns, axis=1)
        score = np.array([min(max(sum(int(x) * int(y) for x, y in zip(turned[i], rows[j], strict=True)), _LOWEST), _HIGHEST)
                          for i, j in zip(a.tolist(), r.tolist(), strict=True)], np.int64)
        held = score >= low[a]
        return a[held], r[held], score[held], turned.shape[1] * len(a)
    least = low.astype(np.float64) * (1 - 1e-12 * np.sign(low)) - 0.5  # scores are integers
    part, made, a = np.zeros(allowed.shape), 0, None
    alive = allowed
    for c, (column, mine) in enumerate(zip(block.columns, own, strict=True)):
        bound = rest[c][:, None] * block.suffix[c][None, :] if a is None else rest[c][a] * block.suffix[c][r]
        if a is None:
            alive = alive & (part + bound * (1 + 1e-12) >= least[:, None])
            if 8 * np.count_nonzero(alive) < alive.size:
                a, r = np.nonzero(alive)
                part = part[a, r]
        else:
            held = part + bound * (1 + 1e-12) >= least[a]
            a, r, part = a[held], r[held], part[held]
        if a is None:
            listed = np.flatnonzero(alive.any(axis=0))  # rows whose suffix isn't covered
            if len(listed) < len(block.ids):
                part[:, listed] += mine @ column[listed].T
            else:
                part += mine @ column.T
            made += len(mine) * len(listed) * column.shape[1]
        else:
            for at in range(0, len(a), 65_536):
                one = slice(at, at + 65_536)
                part[one] += np.einsum("ij,ij->i", mine[a[one]], column[r[one]])
            made += len(a) * column.shape[1]
    if a is None:
        a, r = np.nonzero(alive)
        part = part[a, r]
    score = np.rint(part).astype(np.int64)
    held = score >= low[a]
    return a[held], r[held], score[held], made


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group, by falling score, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _joined(blocks: DataFrame, anchors: DataFrame, slots: tuple[int, int], size: int, turns: int, same: bool, k: int, keep: int) -> DataFrame:
    """For every anchor and slot the first rows of its windows: ``anchor``, ``place`` (of the window), ``vec_id``, ``score``.

    ``anchors``: anchor, anchor_id, label, vector, low and windows (upper ends; one open window where ``same``). They go to
    each of the slots from the first to the last; a slot's rows and the anchors of a turn meet in one task, the rows first.
    """
    def answer(parts, ids, labels, sizes, vectors, key, low, windows):
        wide = np.full((len(ids), keep), -1, np.int64)
        for i, w in enumerate(windows):
            wide[i, : len(w)] = w
        # (anchor * keep + window, score, id, row's anchor)
        held = [np.zeros(0, np.int64)] * 3
        for part in parts:
            mine = np.isin(part.labels, labels) if same else np.ones(len(part.ids), bool)
            if not mine.any():
                continue
            allowed = mine[None, :] & (part.ids[None, :] != ids[:, None]) & (part.sizes[None, :] == sizes[:, None])
            allowed &= (part.labels[None, :] == labels[:, None]) == same
            a, r, score, _ = threshold_pairs(part, vectors, low, allowed)
            for w in range(1 if same else keep):
                in_window = slice(None) if same else (score <= wide[a, w]) & (score >= wide[a, w] - wide[a, w] // 5)
                held = [np.concatenate(x) for x in zip(held, (a[in_window] * keep + w, score[in_window], part.ids[r[in_window]]), strict=True)]
            first = _first(*held, k)
            held = [x[first] for x in held]
        return pa.RecordBatch.from_arrays([pa.array(key[held[0] // keep]), pa.array((held[0] % keep).astype(np.int32)), pa.array(held[2]), pa.array(held[1])],
                                          names=["anchor", "place", "vec_id", "score"])

    def run(batches):
        key, parts, asked = None, [], []

        def flush():
            *arrays, windows = ([x[c] for x in asked] for c in range(7))
            arrays = [np.concatenate(x) for x in arrays]
            windows = [w for x in windows for w in x]
            asked.clear()
            for at in range(0, len(windows), GROUP):
                one = slice(at, at + GROUP)
                ids, labels, sizes, vectors, names, low = (x[one] for x in arrays)
                yield answer(parts, ids, labels, sizes, vectors, names, low, windows[one])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("slot", "turn")])
            block = batch.column("anchor").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0) | (np.diff(block.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if key != tuple(keys[:, lo]):
                    if asked:
                        yield from flush()
                    key, parts = tuple(keys[:, lo]), []
                here = batch.slice(lo, hi - lo)
                if block[lo]:
                    parts += [_Block(*row.values()) for row in here.select(["ids", "labels", "sizes", "order", "columns"]).to_pylist()]
                    continue
                vectors, sizes = matrix(here.column("vector"), size)
                ids, labels, names, low = (here.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor_id", "label", "anchor", "low"))
                asked.append((ids, labels, sizes, whole(vectors), names, low, here.column("windows").to_pylist()))
                if sum(len(x[0]) for x in asked) >= GROUP:
                    yield from flush()
        if asked:
            yield from flush()

    rows = blocks.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    sent = anchors.withColumn("slot", F.explode(F.sequence(*[F.lit(x).cast("long") for x in slots]))).withColumn("turn", F.pmod(F.xxhash64("anchor"), F.lit(turns)).cast("int"))
    units = rows.unionByName(sent, allowMissingColumns=True).repartition("slot", "turn")
    units = units.sortWithinPartitions("slot", "turn", F.asc_nulls_first("label"), "anchor")
    spark = blocks.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "64")
    try:
        return settle(units.mapInArrow(run, "anchor long, place int, vec_id long, score long"), "paired")
    finally:
        spark.conf.set(_BATCH, before)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores; ``rows`` and ``anchors`` come from ``sound``.

    A negative's score is at most its positive's and at least four fifths of it.
    """
    spark = rows.sparkSession
    n, longest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    size = max(1, longest or 0)
    room = max(BLOCK, min(SLOT, (1 << 24) // size))
    slots = max(1, -(-n // room), min(-(-n // BLOCK), 4 * spark.sparkContext.defaultParallelism))
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(slots)))
    blocks = settle(_blocks(dealt.select("slot", "vec_id", "label", "vector"), size), "blocks")
    asked = anchors.filter(F.size("vector") <= size).withColumn("anchor", F.monotonically_increasing_id())
    asked = settle(asked.select("anchor", F.col("vec_id").alias("anchor_id"), "label", "vector"), "anchors")
    turns = max(1, -(-asked.count() // TURN))

    def join(some: DataFrame, low: Column, windows: Column, first: int, last: int, same: bool) -> DataFrame:
        sent = some.select("anchor", "anchor_id", "label", "vector", low.cast("long").alias("low"), windows.cast("array<long>").alias("windows"))
        held = blocks.filter(F.col("slot").between(first, last))
        return _joined(held, sent, (first, last), size, turns, same, positives if same else negatives, positives)

    nothing, lowest = F.array(), F.lit(_LOWEST)
    near = join(asked, lowest, nothing, 0, 0, True)
    if slots > 1:
        bounds = near.groupBy("anchor").agg(F.max("score").alias("best"), F.when(F.count("*") == positives, F.min("score")).alias("last"))
        bound = settle(asked.join(bounds, "anchor", "left").select(*asked.columns, F.coalesce("best", lowest).alias("best"), F.coalesce("last", lowest).alias("last")), "bounds")
        high = join(bound, F.col("best"), nothing, 1, slots - 1, True)
        at_least = near.join(bound.select("anchor", "best"), "anchor").filter("score >= best").select("anchor")
        full = high.select("anchor").unionByName(at_least).groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= positives).select("anchor")
        lower = bound.filter("last < best").join(full, "anchor", "left_anti")
        lower = settle(lower, "lowered")
        low = join(lower, F.col("last"), nothing, 1, slots - 1, True)
        near = near.unionByName(high.join(lower.select("anchor"), "anchor", "left_anti")).unionByName(low)
    chosen = settle(_ranked(near, positives).select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    ends = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("ends"))
    windows = F.transform("ends", lambda e: F.greatest(e["positive_score"], F.lit(-1)))
    least = F.array_min(F.filter("windows", lambda p: p >= 0))
    wide = settle(asked.join(ends, "anchor").withColumn("windows", windows).withColumn("least", least).filter("least IS NOT NULL").drop("ends"), "windows")
    tenth, fifth = F.expr("least div 10"), F.expr("least div 5")
    high = join(wide, F.col("least") - tenth, F.col("windows"), 0, slots - 1, False)
    counts = high.groupBy("anchor", "place").agg(F.least(F.count("*"), F.lit(negatives)).alias("n"))
    counts = counts.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("n"))
    open_at = F.exists(F.transform("windows", lambda p, i: (p >= 0) & (p - F.call_function("div", p, F.lit(5)) < F.col("least") - tenth)
                                   & (F.coalesce(F.try_element_at("n", i), F.lit(0)) < negatives)), lambda x: x)
    lower = settle(wide.join(counts, "anchor", "left").filter(open_at).drop("n"), "lowered")
    low = join(lower, F.col("least") - fifth, F.col("windows"), 0, slots - 1, False)
    far = high.join(lower.select("anchor"), "anchor", "left_anti").unionByName(low)
    return (_ranked(far, negatives).join(chosen, ["anchor", "place"]).join(asked.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
