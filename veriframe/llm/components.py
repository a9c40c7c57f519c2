"""Connected components by a distributed union-find.

Each round first runs a union-find inside every partition of the links, which
leaves a forest of stars, and then merges the stars of different partitions by
the large-star and small-star steps of Kiveris et al. (2014).  Rounds end when
the links no longer change.  Links and labels stay distributed; only two
numbers a round reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that the union-find in a partition holds at once.
FOREST_ROWS = 1_000_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that isn't the smallest of its tree, with that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        node, low = _stars(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= FOREST_ROWS:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of all nodes that have a link.

    ``a`` and ``b`` are columns of 64-bit integers.  Links to itself and links
    with a null end have no effect; repeated links and either direction are
    fine.  No links give an empty result.  Roots themselves are included.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    stars = cut(pairs.mapInArrow(_forest, "u long, v long"), "forest")
    before = None
    for _ in range(max_rounds):
        # large-star: all larger neighbours of u move to the smallest of u and its neighbours
        near = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small-star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = cut(small, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
