"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every task first contracts runs of its own links to stars, so that a dense group costs each task a star, and links are
gathered into as many tasks as they fill runs until that no longer makes them fewer. When they fit one run, that is the result;
otherwise rounds join links with the smallest neighbour of each node until every component is a star around its
smallest node. Nothing is collected; each round is a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.session import settle

RUN_LINKS = 1 << 20
_LINK = "node long, root long"


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the smallest of their component among these links, and those smallest ones."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, further := new[new]):
            new = further
        if np.array_equal(new, label):
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]
        label = new


def _contracted(links: DataFrame) -> DataFrame:
    def run(batches):
        held, n = [], 0

        def flush():
            u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            node, root = contract(u, v)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= RUN_LINKS:
                yield flush()
                n = 0
        if held:
            yield flush()

    return links.mapInArrow(run, _LINK)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of the links (two long columns; a node
    may be linked with itself, links may repeat and go either way)."""
    u, v = links.columns[:2]
    given = links.select(F.col(u).alias("node"), F.col(v).alias("root")).filter("node IS NOT NULL AND root IS NOT NULL")
    edges = settle(_contracted(given.filter("node <> root")), "links")
    n, fits = edges.count(), False
    while not fits:
        runs = -(-max(n, 1) // RUN_LINKS)
        edges = settle(_contracted(edges.coalesce(runs)), "links")
        fewer, fits = edges.count(), runs == 1
        if not fits and fewer > 0.7 * n:
            break
        n = fewer
    before = None
    while not fits:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = settle(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least")), "least")
        # large star: larger neighbours of a node move to its smallest neighbour
        large = settle(both.filter("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct(), "large-star")
        # small star: smaller neighbours of a node, and the node, move to the smallest of them
        least = settle(large.groupBy("node").agg(F.min("root").alias("least")), "least")
        small = (large.join(least, "node").filter("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
                 .unionByName(least.select("node", F.col("least").alias("root"))).distinct())
        edges = settle(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    alone = given.filter("node = root").select("node").distinct().join(edges.select("node"), "node", "left_anti").withColumn("root", F.col("node"))
    return edges.unionByName(edges.select(F.col("root").alias("node"), "root").distinct()).unionByName(alone).distinct()
