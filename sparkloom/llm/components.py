"""Connected components of a link table by alternating large-star and small-star steps.

A table of SMALL links or fewer needs no steps: one task of that bounded size joins them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task joins; 16 bytes each.
SMALL = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _joined(batches):
    """(node, root) of all links together."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(i) for i in up], pa.int64())], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, root) for every node that an edge names; root is the smallest node of its component.

    edges: columns u, v. Self links, repeats and either direction are allowed; an empty table gives an
    empty table. Links stay distributed: each round is two joins whose hot nodes AQE splits, and its
    result is checkpointed, so a lost executor repeats one round at most.
    """
    kept = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    kept = cut(kept)
    if kept.count() <= small:
        return kept.select(F.col("u").cast("long"), F.col("v").cast("long")).repartition(1).mapInArrow(_joined, "node long, root long")
    before = _state(kept)
    for _ in range(max_rounds):
        if not before[0]:
            break
        kept = cut(_small_star(_large_star(kept).distinct()).distinct())
        after = _state(kept)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
