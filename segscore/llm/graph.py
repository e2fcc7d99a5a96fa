"""Connected components of a link table, by hooking and contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, tidy

#: Links that one task can finish: 2 million are 32 MB.
LOCAL = 2_000_000


def roots(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def finished(links: DataFrame) -> DataFrame:
    """(node, comp) of at most LOCAL links (hi, lo), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches if b.num_rows]
        if own:
            nodes, comp = roots(*(np.concatenate(x) for x in zip(*own, strict=True)))
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(comp[i : i + (1 << 16)])], names=["node", "comp"])

    return links.select("hi", "lo").repartition(1).mapInArrow(tidy(run), "node long, comp long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of a link; comp is the least node of its component.

    While there are more links than one task can take, each round every component hooks to its least neighbour if that
    is smaller, chains of hooks are shortened by pointer jumping, and links inside components go; rounds grow with the
    logarithm of the longest chain, and each ends in a table on shared storage. The links that are left, at most LOCAL,
    are finished in one task. Repeated links and links of a node to itself count for nothing; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo")
    labels = None
    while edges.count() > LOCAL:
        edges = saved(edges.distinct(), "edges")
        if labels is None:
            nodes = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
            labels = saved(nodes.withColumn("comp", F.col("node")), "labels")
        hooks = saved(edges.groupBy("hi").agg(F.min("lo").alias("to")), "hooks")
        while True:  # to <- to's own hook, until no hook leads to a node that has one
            further = hooks.select(F.col("hi").alias("to"), F.col("to").alias("next"))
            if hooks.join(further, "to", "left_semi").isEmpty():
                break
            hooks = saved(hooks.join(further, "to", "left").select("hi", F.coalesce("next", "to").alias("to")), "hooks", (hooks,))
        labels = saved(labels.join(hooks.withColumnRenamed("hi", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels", (labels,))
        left, right = (hooks.select(F.col("hi").alias(c), F.col("to").alias(f"{c}_to")) for c in ("hi", "lo"))
        moved = edges.join(left, "hi", "left").join(right, "lo", "left").select(F.coalesce("hi_to", "hi").alias("x"), F.coalesce("lo_to", "lo").alias("y"))
        edges = saved(moved.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges", (edges, hooks))
    last = saved(finished(edges), "components")
    if labels is None:
        return last
    return labels.join(last.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
