"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_ROUNDS = 60
#: Edges that one task contracts.
PART = 1 << 20
#: Tasks that the edges of one node are dealt to.
SALTS = 32


def _least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least neighbour of u. The minimum is taken before the join, and the join is salted
    by v, so that the edges of a hub are dealt to SALTS tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    return near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the least of its component, for links a - b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the edges of a partition, never holding more than twice PART of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) > 2 * PART:
            held = [stars(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))]
            if len(held[0][0]) > PART:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["u", "v"])
                held = []
    if held:
        u, v = stars(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component.

    Edges are contracted to stars in parts of PART edges, one task each. While there is more than one part, star steps
    over all edges follow. Each round writes its edges to the shared folder, so lineage stays short and lost executors
    cost one round. The rounds grow with the logarithm of the largest component. Null ends and loops are ignored; no
    edges give no rows.
    """
    now = checkpointed(edges.where("u != v").select("u", "v"))
    parts = max(1, -(-now.count() // PART))
    now = checkpointed(now.coalesce(parts).mapInArrow(_contract, "u bigint, v bigint"))
    state = None
    for _ in range(MAX_ROUNDS):
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) if parts > 1 else state
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = after
        now = checkpointed(_small_star(_large_star(now)))
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
