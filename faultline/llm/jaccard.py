"""Exact Jaccard self-join of documents on sets of word shingles, by parity sketches.

Two sets of ``a`` and ``b`` shingles with a Jaccard similarity of ``t`` or more differ in at most ``(1-t)/(1+t) * (a+b)``
shingles. Shingles are dealt by their hash into segments of a bit sketch, one bit each, and equal bits cancel (XOR):
the Hamming distance of two sketches is at most the number of differing shingles. With more segments than differences
some segments are equal (pigeonhole). Sets are handled by size band: a band's sketches have the segments that the
largest pair of the band needs, and a set enters its own band and, as the larger partner, the one below. A segment is
carried as a 64-bit linear fold of its bits; sets that share one are candidates, and candidates are verified exactly.

Segments with at most one shingle are weak: common shingles meet in them. A band has spare segments, so that a set with
no more weak ones than spares leaves them out without losing a pair; a set with more keeps all of them.

Equal sets are one node, named by a 64-bit hash of the set, from the start. Of each group with a common segment, every
node is first compared with one pivot, so a group of copies costs links in proportion to its members. Groups that hang
together but fall into several components are then searched: they are cut into the groups that common rare shingles hold
together (similar sets share one of the rarest shingles of both), the sketches of their nodes are compared in blocks inside
tasks, across components only, and pairs whose Hamming distance allows the similarity are verified. Within a task groups are
cut down before the shuffle; a common segment of a third of all documents sends one row per task.

Nulls and texts without words have the empty set and link with nothing; texts of fewer words than a shingle are one
shingle. Repeated rows are equal sets. A null id takes part, but can't name a component. An empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

import contextlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from faultline.llm import lexing
from faultline.llm.components import components
from faultline.session import settle

SHINGLE = 4
PERCENT = 85
RUN_KEYS = 1 << 20
BLOCK_BYTES = 1 << 16
#: Shingles are told common or rare by counts in so many buckets; any order of shingles gives the same links.
BUCKETS = 1 << 20
_BITS = 4096
_ALL = (1 << 64) - 1
_KEYS = "key long, node long, pivot long"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CANDIDATES = "a long, b long"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    data = lexing.lower(data)
    starts, ends, first = lexing.words(data, offsets)
    words = lexing.span_hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = lexing.mix(rolled * np.uint64(31) + words[k: k + len(rolled)])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo: hi - width + 1]))
        elif hi > lo:
            whole = hi - lo
            for word in words[lo:hi].tolist():
                whole = int(lexing.mix(np.array([(whole * 31 + word) & _ALL], np.uint64))[0])
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _times(number: int, factor: int) -> np.uint64:
    return np.uint64(number * factor & _ALL)


def set_hash(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    total = np.uint64((int(lexing.mix(shingles).sum(dtype=np.uint64)) + len(shingles) * 0x9E3779B97F4A7C15) & _ALL)
    return int(lexing.mix(np.array([total])).astype(np.int64)[0])


@cache
def bands(percent: int) -> tuple[list[int], list[int], list[int]]:
    """First size of each band, and its numbers of segments and of spare ones among them.

    A partner of a set of one band is in that band or the next.
    """
    first = [1]
    while first[-1] < 1 << 40:
        first.append(first[-1] * 100 // percent + 1)
    segments, spares = [], []
    for least, after in zip(first[:-1], first[1:], strict=True):
        small = after - 1
        differ = (100 - percent) * (small + small * 100 // percent) // (100 + percent)
        keep = 1 - 1 / (differ + 1)
        weak = (differ + 1) * (keep ** least + least / (differ + 1) * keep ** (least - 1)) if differ else 0.0
        spare = min(math.ceil(weak + 3 * math.sqrt(weak)), 1 + differ // 8) if differ else 0
        segments.append(differ + 1 + spare)
        spares.append(spare)
    return first, segments, spares


@cache
def _bit_values() -> np.ndarray:
    return lexing.mix(np.arange(1, _BITS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The folded segments of a set in its own band and the one below, as 64-bit keys."""
    first, segments, spares = bands(percent)
    own = int(np.searchsorted(first, len(shingles), side="right")) - 1
    out = []
    for band in {own, max(own - 1, 0)}:
        n = segments[band]
        draw = lexing.mix(shingles + _times(band + 1, 0x8EBC6AF09C88C6E3))
        segment = ((draw >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment, minlength=n)
        heads = np.flatnonzero(counts)
        folded = np.zeros(n, np.uint64)
        at = np.cumsum(counts) - counts
        folded[heads] = np.bitwise_xor.reduceat(_bit_values()[(draw & np.uint64(_BITS - 1)).astype(np.int64)][order], at[heads])
        strong = counts > 1
        if n - int(strong.sum()) > spares[band]:
            strong[:] = True
        key = lexing.mix(folded + _times(band + 1, 0xD6E8FEB86659FD93) + np.arange(n, dtype=np.uint64) * np.uint64(0xCA5A826395121157))
        out.append(key[strong])
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def nodes(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles`` and ``node`` (null for the empty set)."""

    def run(batches):
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches):
            sets = shingle_hashes(data, offsets, width)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "text_hash", "n_shingles", "node"])

    return _identified(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _task_groups(keys: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """One row per key with its first node, and a row for each further node that names the first as its pivot."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    same = np.zeros(len(keys), bool)
    same[1:] = ~head[1:] & (owner[1:] == owner[:-1])
    pivot = owner[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
    keys, owner, head, pivot = keys[~same], owner[~same], head[~same], pivot[~same]
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owner), pa.array(pivot, mask=head)], names=["key", "node", "pivot"])


def candidates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``a`` and ``b``: nodes ``b`` that share a segment with the pivot ``a`` of its group."""

    def emit(batches):
        held, n, seen = [], 0, set()

        def flush():
            out = _task_groups(np.concatenate([x[0] for x in held]), np.concatenate([np.full(len(k), node) for k, node in held]))
            held.clear()
            seen.clear()
            return out

        for _, _, _, data, offsets in lexing.batch_blocks(batches):
            for shingles in shingle_hashes(data, offsets, width):
                if not len(shingles) or (node := set_hash(shingles)) in seen:
                    continue
                seen.add(node)
                held.append((segment_keys(shingles, percent), node))
                n += len(held[-1][0])
                if n >= RUN_KEYS:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return _pivot_pairs(docs.select("text"), emit)


def _pivot_pairs(rows: DataFrame, emit) -> DataFrame:
    """``a`` and ``b``: of the groups with a common key that ``emit`` makes of ``rows``, each node ``b`` with the pivot ``a``."""

    def pair(batches):
        last_key, last_pivot = None, None
        for batch in batches:
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            given = batch.column("pivot")
            is_head = given.is_null().to_numpy(zero_copy_only=False)
            a, b = given.fill_null(0).to_numpy()[~is_head], node[~is_head]
            key, node = key[is_head], node[is_head]
            if last_key is not None:
                key, node = np.append(last_key, key), np.append(last_pivot, node)
            if len(key):
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                pivot = node[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
                again = np.zeros(len(key), bool)
                again[1:] = ~head[1:] & (node[1:] == node[:-1])
                hit = ~head & ~again & (node != pivot)
                a, b = np.append(a, pivot[hit]), np.append(b, node[hit])
                last_key, last_pivot = key[-1], pivot[-1]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # first nodes are dealt by key, the others by node too, so that no key gathers more than a row per run
    deal = F.when(F.col("pivot").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node"))
    dealt = rows.mapInArrow(emit, _KEYS).repartition(deal).sortWithinPartitions("key", "node")
    return dealt.mapInArrow(pair, _CANDIDATES)


def _representatives(named: DataFrame) -> DataFrame:
    """For each node the row with its smallest id: ``node``, ``doc_id``, ``text_hash``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    return named.filter("node IS NOT NULL").groupBy("node").agg(first).select("node", "first.doc_id", "first.text_hash")


def _with_sets(docs: DataFrame, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """``node`` and ``shingles`` (sorted 64-bit hashes as bytes) of the rows in ``wanted`` (node, doc_id, text_hash).

    The list of wanted rows grows with the documents, so both sides are dealt by row at every size. Only where
    rows are repeated as a whole a set can come twice.
    """
    asked = wanted.select("node", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash")).hint("shuffle_hash")
    row = (F.col("text_hash") == F.col("wanted_hash")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    source = _identified(docs).join(asked, row).select("node", "text")

    def run(batches):
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches):
            asked_for = batch.column("node").slice(lo, hi - lo).to_pylist()
            found = [(node, s) for node, s in zip(asked_for, shingle_hashes(data, offsets, width), strict=True) if len(s) and set_hash(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1].tobytes() for x in found], pa.binary())], names=["node", "shingles"])

    sets = source.mapInArrow(run, "node long, shingles binary")
    return sets.dropDuplicates(["node"]) if repeated else sets


@contextlib.contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Rows that hold whole sets or blocks go to Python few at a time."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that reach the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("set_a", "set_b"))
            hit = [similar(x, y, percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    with _small_batches(pairs.sparkSession, 256):
        return settle(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "verified")


def _sketch(shingles: np.ndarray, bits: int) -> bytes:
    """One bit per shingle at a hashed place; equal bits cancel."""
    places = (lexing.mix(shingles + np.uint64(0xE7037ED1A0B428DB)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _of_several_roots(members: DataFrame) -> DataFrame:
    """The rows of ``members`` whose part holds more than one component."""
    several = members.groupBy("part").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    return members.join(settle(several.select("part"), "several"), "part")


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of ``sets`` fall into each of ``BUCKETS`` buckets by hash: a table of fixed size."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
            total += np.bincount(_bucket(held), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    found = sets.select("shingles").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(BUCKETS)).astype(np.int64)


def rarest(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of rarest buckets of a set, so many that every similar set holds one of them, among its own rarest."""
    needed = -(-percent * len(shingles) // 100)
    return shingles[np.lexsort((shingles, counts[_bucket(shingles)]))[: len(shingles) - needed + 1]]


def _finer_parts(members: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``part``: the groups of ``members`` that common rare shingles hold together. Nodes without such a partner are left out."""
    spark = members.sparkSession
    with _small_batches(spark, 1000):
        shared = spark.sparkContext.broadcast(_bucket_counts(members))

    def emit(batches):
        held, n = [], 0

        def flush():
            out = _task_groups(np.concatenate([x[0] for x in held]), np.concatenate([np.full(len(k), node) for k, node in held]))
            held.clear()
            return out

        for batch in batches:
            for part, node, raw in zip(batch.column("part").to_numpy(), batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
                rare = rarest(np.frombuffer(raw.as_py(), np.uint64), shared.value, percent)
                held.append((lexing.mix(rare ^ lexing.mix(np.array([part]).astype(np.uint64))), node))
                n += len(rare)
                if n >= RUN_KEYS:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    pairs = _pivot_pairs(members.select("part", "node", "shingles"), emit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    with _small_batches(spark, 1000):
        pairs = settle(pairs.distinct(), "rare-pairs")
    return components(pairs).select("node", F.col("root").alias("part"))


def open_groups(found: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes that may have links beyond their component: ``part``, ``node``, ``root``, ``size``, ``shingles``.

    The pairs of ``found`` hold groups together. Those of several components are cut again by their rarest shingles, as a passage
    that many sets share makes groups of them, but is not among the rarest of sets that hold enough else.
    """
    groups = components(found.select("a", "b")).select("node", F.col("root").alias("part"))
    rooted = settle(groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    with_sets = _of_several_roots(rooted).join(sets, "node").withColumn("size", F.length("shingles") / 8)
    wide = settle(with_sets.select("part", "node", "root", "size", "shingles"), "wide-groups")
    if wide.isEmpty():
        return wide
    finer = settle(_finer_parts(wide, percent), "finer-parts")
    return settle(_of_several_roots(wide.drop("part").join(finer, "node")).select("part", "node", "root", "size", "shingles"), "open-members")


def _across(found: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components of ``roots`` within the open groups, as far as their sketches allow the similarity.
    Sketches have four bits or more a shingle of the group's largest set."""
    open_members = open_groups(found, roots, sets, percent)
    if open_members.isEmpty():
        return found.select("a", "b").limit(0)
    scale = open_members.groupBy("part").agg(F.count("*").alias("n"), F.max("size").alias("largest"))
    bits = F.least(F.greatest(F.pow(2.0, F.ceil(F.log2(4 * F.col("largest")))), F.lit(1024.0)), F.lit(65536.0)).cast("int")
    scale = settle(scale.select("part", bits.alias("bits"), F.ceil(F.col("n") * bits / (8 * BLOCK_BYTES)).alias("n_blocks")), "scale")

    def sketch(batches):
        for batch in batches:
            bits_, raw = batch.column("bits").to_pylist(), batch.column("shingles").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "block", "node", "root", "size")), pa.array([_sketch(np.frombuffer(x, np.uint64), n) for x, n in zip(raw, bits_, strict=True)], pa.binary())],
                names=["part", "block", "node", "root", "size", "sketch"])

    with_block = open_members.join(scale, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    with _small_batches(found.sparkSession, 1000):
        sketched = settle(with_block.select("part", "block", "node", "root", F.col("size").cast("long").alias("size"), "bits", "shingles")
                          .mapInArrow(sketch, "part long, block long, node long, root long, size long, sketch binary"), "sketches")
    blocks = settle(sketched.groupBy("part", "block").agg(F.collect_list(F.struct("node", "root", "size", "sketch")).alias("held")), "blocks")

    def unpack(held) -> tuple[np.ndarray, ...]:
        node, root, size = (np.array([h[c] for h in held], np.int64) for c in ("node", "root", "size"))
        return node, root, size, np.frombuffer(b"".join(h["sketch"] for h in held), np.uint64).reshape(len(held), -1)

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                one, other = unpack(row["held"]), unpack(row["other"])
                for node, root, size, bits_ in zip(*one, strict=True):
                    most = (100 - percent) * (size + other[2]) // (100 + percent)
                    hit = (other[1] != root) & (np.bitwise_count(other[3] ^ bits_).sum(axis=1) <= most)
                    hit &= other[0] > node if row["same"] else other[0] != node
                    if hit.any():
                        b = other[0][hit]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b, node)), pa.array(np.maximum(b, node))], names=["a", "b"])

    others = blocks.select("part", F.col("block").alias("other_block"), F.col("held").alias("other"))
    both = blocks.join(others, "part").filter("block <= other_block").select("held", "other", (F.col("block") == F.col("other_block")).alias("same"))
    with _small_batches(found.sparkSession, 8):
        return settle(both.mapInArrow(compare, "a long, b long"), "near-pairs")


def _groups(source: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their set (``doc_id``, ``n_shingles``, ``node``), and sets with their component (``node``, ``doc_id``, ``root``)."""
    named = settle(nodes(source, width), "sets-by-document")
    representatives = settle(_representatives(named), "representatives")
    found = settle(candidates(source, width, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = settle(found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(representatives, "node"), "wanted")
    repeated = not named.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    sets = settle(_with_sets(source, wanted, width, repeated), "sets")
    links = _verified(found, sets, percent)
    roots = settle(components(links), "roots")
    rest = _across(found, roots, sets, percent)
    if not rest.isEmpty():
        roots = settle(components(links.unionByName(_verified(rest, sets, percent))), "roots")
    rooted = representatives.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    return named, settle(rooted, "rooted")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    named, rooted = _groups(docs.select("doc_id", "text"), width, percent)
    least = settle(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    ids = settle(rooted.select("node", "root").join(least, "root").select("node", "component_id"), "component-ids")
    return (named.join(ids, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, in its columns: of each component one row with the smallest id (null ids last), and
    every row with an empty set."""
    _, rooted = _groups(docs.select("doc_id", "text"), width, percent)
    chosen = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first"))
    chosen = settle(chosen.select(F.col("first.doc_id").alias("__first_id"), F.col("first.node").alias("__first_node")), "chosen")
    schema = T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType())])

    def name(batches):
        for batch, lo, hi, data, offsets in lexing.batch_blocks(batches):
            found = [set_hash(x) if len(x) else None for x in shingle_hashes(data, offsets, width)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=[*part.schema.names, "__node"])

    named = docs.mapInArrow(name, schema)
    first = F.col("doc_id").cast("long").eqNullSafe(F.col("__first_id")) & (F.col("__node") == F.col("__first_node"))
    stays = named.filter("__node IS NOT NULL").join(chosen, first, "left_semi").dropDuplicates(["doc_id", "__node"])
    return stays.unionByName(named.filter("__node IS NULL")).select(docs.columns)
