"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one node. A pass orders all nodes by a concatenation of random hashes (signs of projections, then the
first projection itself) and compares each with its next ``window`` neighbours in that order; pairs whose cosine reaches
the threshold are links, and links of all passes together are united to components. Hashes are taken of unit vectors less
their mean, because a direction that all vectors share would put most of them on one side of every plane. The number of
passes is measured: partners at the threshold are made for ``ANCHORS`` vectors, all nodes between each and its partner are
counted in ``TRIALS`` orders, and the passes follow that let ``RECALL`` of such pairs meet (``measured_passes``), never
fewer than an evenly split table of that size needs (``passes_for``). A dense group is joined by overlapping windows. Passes are dealt by ranges of the order itself, with the node last, so equal hashes
don't gather in one task; on large tables few passes run at a time, so that their shuffle files stay a small multiple of
the input.

The number of links within a component is then counted exactly, without writing its pairs: vectors within half the
threshold's angle of the component's centre are all linked with each other (angles add up at most), which their number
settles; only the others are compared with the members of their component, in blocks.

Null vectors, zero vectors and vectors with a null or non-finite component link with nothing. Vectors of different lengths
don't link. Repeated rows are rows of their own, but equal ids share their component and have one count, the sum over their
rows; equal vectors of one id are no link. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm.components import components
from faultline.session import settle

#: Least number of passes; larger tables take more.
PASSES = 12
#: Expected share of isolated pairs at the threshold that are found.
RECALL = 0.99
HASHES = 24
WINDOW = 128
COSINE = 0.9
CHUNK = 64
#: Rows compared with their windows at once.
ROWS = 256
#: Ordered rows (nodes times passes) of a job; a job has ROUND passes at least.
JOB_ROWS = 4_000_000
ROUND = 4
#: Distinct vectors (chosen by hash) that fit the means, and those of them which get partners.
FIT_ROWS = 2048
ANCHORS = 256
#: Orders in which the distance of partners is counted; their planes are those of no pass.
TRIALS = 64
_FIRST_TRIAL = 1 << 24
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (array of float if it was one, else of double) of the rows that can link."""
    given = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col).cast(given if given == "array<float>" else "array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter(vector.isNotNull() & sound & F.col("vec_id").isNotNull())


def _unit(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as a matrix, padded to the longest, and their lengths."""
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        out = flat.reshape(len(sizes), int(sizes[0]))
    else:
        out = np.zeros((len(sizes), int(sizes.max(initial=0))))
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out = out / np.abs(out).max(axis=1, keepdims=True, initial=0)  # large and small components square without overflow
    return out / np.sqrt((out ** 2).sum(axis=1, keepdims=True)), sizes


def _planes(number: int, size: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, (number << 32) | size])).standard_normal((size, hashes))


def _hashes(unit: np.ndarray, sizes: np.ndarray, number: int, hashes: int, seed: int, means: dict[int, np.ndarray]) -> np.ndarray:
    """Place of each unit vector in the order ``number``: signs of projections, then the first projection itself."""
    out = np.zeros(len(sizes), np.int64)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        planes = _planes(number, size, hashes, seed)
        shadow = unit[own, :size] @ planes
        if size in means:
            shadow -= means[size] @ planes
        bits = (shadow > 0) @ (1 << np.arange(hashes - 1, -1, -1))
        fine = np.clip((shadow[:, 0] + 8) * 65536, 0, (1 << 20) - 1).astype(np.int64)
        out[own] = (bits << 20) | fine
    return out


def fit_sample(vectors: DataFrame, rows: int = FIT_ROWS, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths of the ``rows`` nodes with the smallest hashes."""
    chosen = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").select("vector").limit(rows).toArrow()
    return _unit(chosen.column("vector").combine_chunks())


def means_of(unit: np.ndarray, sizes: np.ndarray) -> dict[int, np.ndarray]:
    """Mean unit vector of each length in the sample; lengths outside of it are hashed as they are."""
    return {size: unit[sizes == size, :size].mean(0) for size in np.unique(sizes).tolist()}


def partners(unit: np.ndarray, sizes: np.ndarray, means: dict[int, np.ndarray], cosine: float, seed: int = 17) -> np.ndarray:
    """For each unit vector another one at ``cosine`` that differs as the sample's vectors do: as near to the mean."""
    draw, out = np.random.default_rng(seed), np.zeros_like(unit)
    for size in np.unique(sizes).tolist():
        own, mean = np.flatnonzero(sizes == size), means[size]
        u = unit[own, :size]
        part = u[draw.permutation(len(own))] - u[draw.permutation(len(own))] + 1e-6 * draw.standard_normal(u.shape)
        ahead = mean / max(float(np.linalg.norm(mean)), 1e-12)
        level = (u @ mean)[:, None]
        keep = np.clip((cosine - level) / np.maximum(1 - level, 1e-9), 0, 1)
        base = mean + keep * (u - mean)
        across = u - (u @ ahead)[:, None] * ahead  # the part of u beside the mean's direction
        across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-12)
        part = part - (part @ ahead)[:, None] * ahead
        part -= (part * across).sum(1, keepdims=True) * across
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        v = base + np.sqrt(np.maximum(1 - (base ** 2).sum(1, keepdims=True), 0)) * part
        out[own, :size] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return out


def passes_to_meet(met: np.ndarray, trials: int, recall: float = RECALL) -> int:
    """Passes that let ``recall`` of pairs meet, of which pair i met in ``met[i]`` of ``trials`` orders.

    The chances of pairs are taken as beta distributed with the mean and the spread that the counts show, so that pairs in
    crowded places count with their own small chances.
    """
    share = (met.sum() + 0.5) / (len(met) * trials + 1)
    if share > 1 - 1e-6:
        return 1
    spread = met.var() / (trials * share * (1 - share))
    rho = min(max((spread - 1) / max(trials - 1, 1), 1e-6), 0.999)
    a, b = share * (1 / rho - 1), (1 - share) * (1 / rho - 1)

    def missed(passes: int) -> float:
        return math.exp(math.lgamma(b + passes) - math.lgamma(b) + math.lgamma(a + b) - math.lgamma(a + b + passes))

    low, high = 0, 1
    while missed(high) > 1 - recall and high < 1 << 16:
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if missed(middle) > 1 - recall else (low, middle)
    return high


def measured_passes(vectors: DataFrame, unit: np.ndarray, sizes: np.ndarray, means: dict[int, np.ndarray], cosine: float = COSINE, window: int = WINDOW,
                    recall: float = RECALL, hashes: int = HASHES, seed: int = 17) -> int:
    """Passes for ``recall``, from the number of nodes that stand between the first ``ANCHORS`` vectors of the sample and
    their ``partners``. Every node is counted, in tasks; ``TRIALS`` times twice ``ANCHORS`` sums come to the driver."""
    unit, sizes = unit[:ANCHORS], sizes[:ANCHORS]
    other = partners(unit, sizes, means, cosine, seed)
    numbers = range(_FIRST_TRIAL, _FIRST_TRIAL + TRIALS)
    ends = [np.sort(np.stack([_hashes(x, sizes, number, hashes, seed, means) for x in (unit, other)]), axis=0) for number in numbers]
    edges = [np.unique(x) for x in ends]
    width = 2 * len(sizes) + 1

    def count(batches):
        total = np.zeros((TRIALS, width), np.int64)
        for batch in batches:
            rows, lengths = _unit(batch.column("vector"))
            for trial, number in enumerate(numbers):
                at = np.searchsorted(edges[trial], _hashes(rows, lengths, number, hashes, seed, means), side="right")
                total[trial] += np.bincount(at, minlength=width)
        trial, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(trial.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[trial, cell])], names=["trial", "cell", "n"])

    counts = np.zeros((TRIALS, width), np.int64)
    for row in vectors.select("vector").mapInArrow(count, "trial int, cell int, n long").groupBy("trial", "cell").agg(F.sum("n").alias("n")).collect():
        counts[row["trial"], row["cell"]] = row["n"]
    before = np.cumsum(counts, axis=1)  # nodes ahead of each edge
    met = np.zeros(len(sizes), np.int64)
    for trial in range(TRIALS):
        low, high = (before[trial][np.searchsorted(edges[trial], x)] for x in ends[trial])
        met += high - low <= window
    return passes_to_meet(met, TRIALS, recall)


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that find ``recall`` of the isolated pairs of ``cosine`` among ``n`` vectors, ``PASSES`` at least.

    Two vectors agree in a sign with 1 - angle / pi. When they agree in so many leading signs that about ``window`` vectors
    share them, they meet in that pass.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    meet = agree ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if meet >= 1 else max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def ordered_passes(vectors: DataFrame, passes: int = PASSES, hashes: int = HASHES, seed: int = 17, first: int = 0,
                   means: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Each vector once per pass, from number ``first``: ``pass``, ``hash``, ``vec_id``, ``vector``."""
    kind = vectors.schema["vector"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            unit, sizes = _unit(batch.column("vector"))
            for number in range(first, first + passes):
                out = _hashes(unit, sizes, number, hashes, seed, means or {})
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), number, np.int32)), pa.array(out), batch.column("vec_id"), batch.column("vector")],
                                                 names=["pass", "hash", "vec_id", "vector"])

    rows = vectors.mapInArrow(run, f"pass int, hash long, vec_id long, vector {kind}")
    return rows.repartitionByRange("pass", "hash", "vec_id").sortWithinPartitions("pass", "hash", "vec_id")


def neighbour_links(ordered: DataFrame, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """Links ``a`` - ``b`` of vectors near each other in the order.

    Links found in a run are contracted to a star at once, so that a dense group gives as many rows as it has vectors.
    """
    from faultline.llm.components import contract

    def links(ids: np.ndarray, number: np.ndarray, unit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for at in range(0, len(ids), ROWS):
            i, j = np.nonzero(unit[at: at + ROWS] @ unit[at: at + ROWS + window].T >= cosine)
            i, j = i + at, j + at
            near = (j > i) & (j <= i + window) & (number[i] == number[j]) & (sizes[i] == sizes[j])
            u, v = ids[i[near]], ids[j[near]]
            if len(u) > ROWS:
                u, v = contract(u, v)
            a.append(u)
            b.append(v)
        return contract(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches):
        tail = None
        for batch in batches:
            unit, sizes = _unit(batch.column("vector"))
            now = [batch.column("vec_id").to_numpy(), batch.column("pass").to_numpy(), unit, sizes]
            if tail is not None:
                width = max(tail[2].shape[1], unit.shape[1])
                for x in (tail, now):
                    x[2] = np.pad(x[2], ((0, 0), (0, width - x[2].shape[1])))
                now = [np.concatenate([x, y]) for x, y in zip(tail, now, strict=True)]
            node, root = links(*now)
            tail = [x[-window:] for x in now]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def link_counts(vectors: DataFrame, members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id`` and ``weight``, the rows within the components of ``members`` (node, root) that are near, itself included.

    ``vectors`` has a distinct ``vec_id``, ``vector`` and ``n``, the number of rows it stands for.
    """
    kind = vectors.schema["vector"].dataType.simpleString()
    half = math.cos(math.acos(cosine) / 2 - 1e-7)
    held = settle(vectors.join(members, vectors["vec_id"] == members["node"]).select("vec_id", "vector", "n", "root"), "members")
    vector = F.col("vector").cast("array<double>")
    scaled = F.transform(vector, lambda x: x / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, y: s + y * y)))
    centre = (held.select("root", F.posexplode(scaled)).groupBy("root", "pos").agg(F.avg("col").alias("mean"))
              .groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centre")))
    centre = settle(centre, "centres")  # a row per component

    def near(batches):
        for batch in batches:
            unit, sizes = _unit(batch.column("vector"))
            middle, own = _unit(batch.column("centre"))
            same = sizes == own
            width = min(unit.shape[1], middle.shape[1])
            core = same & (np.einsum("ij,ij->i", unit[:, :width], middle[:, :width]) >= half)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("root"), pa.array(core), batch.column("vector"), batch.column("n")],
                                             names=["vec_id", "root", "core", "vector", "n"])

    placed = settle(held.join(centre, "root").select("vec_id", "root", "vector", "n", "centre")
                    .mapInArrow(near, f"vec_id long, root long, core boolean, vector {kind}, n long"), "placed")
    cores = settle(placed.filter("core").groupBy("root").agg(F.sum("n").alias("n_core")), "cores")
    outer = placed.filter("NOT core").withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)))
    sizes = outer.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).alias("n_chunks"))
    chunks = (outer.join(settle(sizes, "outer-sizes"), "root").withColumn("chunk", F.pmod("slot", F.col("n_chunks")))
              .groupBy("root", "chunk").agg(F.collect_list(F.struct("vec_id", "vector", "n")).alias("block")))
    chunks = settle(chunks, "outer")

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = [x for x in row["block"] if len(x["vector"]) == len(row["vector"]) and x["vec_id"] != row["vec_id"]]
                if not block:
                    continue
                lists = pa.list_(pa.float64())
                one, other = _unit(pa.array([row["vector"]], lists))[0], _unit(pa.array([x["vector"] for x in block], lists))[0]
                hit = [x for x, c in zip(block, (other @ one[0]).tolist(), strict=True) if c >= cosine]
                ids, n = [x["vec_id"] for x in hit], [row["n"]] * len(hit)
                if row["core"] and hit:
                    ids.append(row["vec_id"])
                    n.append(sum(x["n"] for x in hit))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["vec_id", "n"])

    spark = vectors.sparkSession
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "256")
    try:
        across = settle(placed.join(chunks, "root").select("vec_id", "vector", "n", "core", "block").mapInArrow(compare, "vec_id long, n long"), "across")
    finally:
        spark.conf.set(_BATCH, before)
    inside = placed.filter("core").join(cores, "root").select("vec_id", F.col("n_core").alias("n")).unionByName(outer.select("vec_id", "n"))
    return inside.unionByName(across).groupBy("vec_id").agg(F.sum("n").alias("weight"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and whether it is the component's smallest id (``kept``).

    Without ``passes`` their number follows from how many distinct vectors there are and how they lie.
    """
    sound = usable(vectors)
    nodes = settle(sound.groupBy("vector").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    held = settle(sound.join(nodes.select("vector", "node"), "vector").groupBy("vec_id", "node").agg(F.count("*").alias("k")), "held")
    distinct, n = nodes.select(F.col("node").alias("vec_id"), "vector", "n"), nodes.count()
    unit, sizes = fit_sample(distinct)
    means = means_of(unit, sizes)
    if passes is None:
        passes = passes_for(n, cosine, window)
        if n > window + 1:  # a single window holds smaller tables
            passes = max(passes, measured_passes(distinct, unit, sizes, means, cosine, window))
    step, links = max(ROUND, JOB_ROWS // max(n, 1)), None
    for first in range(0, passes, step):
        found = settle(neighbour_links(ordered_passes(distinct, min(step, passes - first), first=first, means=means), window, cosine), "neighbours")
        links = found if links is None else links.unionByName(found)
    several = held.groupBy("vec_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    same = held.join(several, "vec_id").select("a", F.col("node").alias("b"))
    roots = settle(components(same if links is None else links.unionByName(same)), "roots")
    weights = settle(link_counts(distinct, roots, cosine), "link-counts")
    own = nodes.select(F.col("node").alias("own"), "n")
    linked = roots.join(weights, roots["node"] == weights["vec_id"]).select("node", "root", "weight")
    placed = settle(own.join(linked, own["own"] == linked["node"], "left").select("own", F.coalesce("root", "own").alias("root"), F.coalesce("weight", "n").alias("weight")), "weights")
    member = settle(held.join(placed, held["node"] == placed["own"]).select("vec_id", "root", (F.col("k") * (F.col("weight") - F.col("k"))).alias("n")), "rows")
    least = settle(member.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least-ids")
    counts = settle(member.join(least, "root").groupBy(F.col("vec_id").alias("id")).agg(F.sum("n").alias("n_links"), F.min("component_id").alias("component_id")), "found")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    return (ids.join(counts, ids["vec_id"] == F.col("id"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
