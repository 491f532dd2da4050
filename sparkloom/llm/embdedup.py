"""Embedding near-duplicates: a subspace pigeonhole join, verified exactly.

Unit vectors with cosine >= t differ by a squared distance of at most 2 - 2t. A seeded rotation spreads that
over all coordinates; cut into m blocks of BLOCK coordinates, one block at least lies within a 1/m share of the
budget. Each block is range-joined on its own: a grid over its first coordinates deals vectors to cells, a vector
is compared with the home rows of every cell its ball touches, pairs within the block's share are candidates, and
each candidate is verified by its cosine in double precision on the original components. A pair counts in the
first block that finds it, so the union over blocks counts every link once.

Rows with equal vectors are one class, compared once and counted as many. Classes that share a cell are compared
in tasks of at most 2 * CELL rows; a fuller cell is cut into chunks that are all compared with each other. Tasks
return link counts and a spanning forest of their links, never pairs. The grid's dimensions grow with the table.

Defined cases: rows without id, label or usable vector (null, zero, a null or non-finite component) have no links
and are their own component; vectors of different length never link; rows that share an id and a vector link as
any other; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable, usable_vector
from .common import cut, with_partitions
from .components import components

THRESHOLD = 0.98
BLOCK = 8
CELL = 4096
STRIP = 256
SEED = 11


def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, d)))[0]


def _blocks(d: int) -> list[slice]:
    m = max(1, d // BLOCK)
    edges = [round(i * d / m) for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _members(grid: int, budget: float):
    """For each class and block: the cells its ball touches, and whether a cell is its home."""

    turns: dict[int, np.ndarray] = {}

    def cells_of(labels: np.ndarray, reps: np.ndarray, raw: np.ndarray):
        d = raw.shape[1]
        if d not in turns:
            turns[d] = rotation(d)
        turned = (raw / np.linalg.norm(raw, axis=1)[:, None]) @ turns[d]
        blocks = _blocks(d)
        radius = math.sqrt(budget / len(blocks)) * (1 + 1e-9)
        side = 6 * radius
        for b, block in enumerate(blocks):
            at, home = np.arange(len(reps)), np.ones(len(reps), dtype=bool)
            cell = np.empty((len(reps), 0), dtype=np.int64)
            for c in turned[:, block].T[:grid]:
                lo, own, hi = (np.floor((c[at] + x) / side).astype(np.int64) for x in (-radius, 0, radius))
                two = hi > lo  # a ball is narrower than a cell
                at, own = np.concatenate([at, at[two]]), np.concatenate([own, own[two]])
                here = np.concatenate([lo, hi[two]])
                cell = np.column_stack([np.concatenate([cell, cell[two]]), here])
                home = np.concatenate([home, home[two]]) & (here == own)
            names = [f"{label}/{d}/{b}/" + ",".join(map(str, x)) for label, x in zip(labels[at].tolist(), cell.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(reps[at], pa.int64()), pa.array(names, pa.string()), pa.array(home)], ["rep", "cell", "home"])

    def run(batches):
        for batch in batches:
            label, rep, v = batch.columns
            lengths = v.value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == d))
                yield from cells_of(label.take(at).to_numpy(zero_copy_only=False), rep.take(at).to_numpy(), matrix(v.take(at)))

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (r != self.up[r]).any():
            r = self.up[r]
        return r

    def join(self, at: np.ndarray):
        """Join all; yields the pairs that were apart."""
        roots = np.unique(self.roots(at))
        for r in roots[1:]:
            self.up[r] = roots[0]
            yield roots[0], r


def _compare(threshold: float, grid: int):
    budget = 2 - 2 * threshold

    def run(table: pa.Table) -> pa.Table:
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        build, probe = (np.flatnonzero(table[c].to_numpy()) for c in ("build", "probe"))
        b = int(table["cell"][0].as_py().split("/")[-2])
        raw = matrix(table["v"])
        norm = np.linalg.norm(raw, axis=1)
        turned = (raw / norm[:, None]) @ rotation(raw.shape[1])
        blocks = _blocks(raw.shape[1])
        share = budget / len(blocks) * (1 + 1e-9)
        # rows in the order of a coordinate that the grid leaves open, so that a strip meets a range of them only
        line = turned[:, blocks[b]][:, min(grid, blocks[b].stop - blocks[b].start - 1)]
        build, probe = build[np.argsort(line[build], kind="stable")], probe[np.argsort(line[probe], kind="stable")]
        reach = math.sqrt(share) + 1e-9

        def apart(block: slice, at: np.ndarray, to: np.ndarray) -> np.ndarray:
            x, y = turned[at, block], turned[to, block]
            return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T

        links, forest, edges = np.zeros(len(rep), dtype=np.int64), _Forest(len(rep)), []
        for s in range(0, len(probe), STRIP):
            at = probe[s : s + STRIP]
            to = build[slice(*np.searchsorted(line[build], [line[at[0]] - reach, line[at[-1]] + reach]))]
            near = apart(blocks[b], at, to) <= share
            near &= rep[at][:, None] != rep[to][None, :]
            rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(rows):
                continue
            near, at, to = near[np.ix_(rows, cols)], at[rows], to[cols]
            for block in blocks[:b]:
                near &= apart(block, at, to) > share
            near &= (raw[at] @ raw[to].T) / (norm[at][:, None] * norm[to][None, :]) >= threshold
            links[at] += near @ copies[to]
            for i in np.flatnonzero(near.any(1)):
                edges += forest.join(np.append(to[near[i]], at[i]))
        some = np.flatnonzero(links)
        u, v = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
        return pa.table({
            "a": pa.array(np.concatenate([rep[some], rep[u]]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), rep[v]]), pa.int64()),
            "links": pa.array([int(x) for x in links[some]] + [None] * len(u), pa.int64()),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    good = usable(rows).filter(F.col("label").isNotNull()).withColumn("v", F.transform("v", lambda x: x + 0.0))
    good = good.select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    classes = cut(good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min_by("v", "vec_id").alias("v")))
    # a class is named by a number of its own, as rows may share an id
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = min(BLOCK, max(1, math.ceil(math.log(max(n, 1) / cell, 2.2)))) if n else 1
    budget = 2 - 2 * threshold
    members = classes.select(F.col("label").cast("string"), "rep", "v").mapInArrow(_members(grid, budget), "rep long, cell string, home boolean")
    members = cut(members)
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).filter("n > 1 and homes > 0")
    sizes = sizes.select("cell", F.ceil(F.col("n") / cell).cast("int").alias("chunks"))
    dealt = members.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # (i, j): probes of chunk i meet home rows of chunk j; the row of both roles goes to its (own, own) once
    where = F.expr(
        "explode(concat("
        "array(named_struct('i', own, 'j', own, 'build', home, 'probe', true)),"
        "transform(filter(sequence(0, chunks - 1), x -> x <> own), x -> named_struct('i', own, 'j', x, 'build', false, 'probe', true)),"
        "transform(filter(sequence(0, chunks - 1), x -> home and x <> own), x -> named_struct('i', x, 'j', own, 'build', true, 'probe', false))))"
    )
    dealt = dealt.select("rep", "cell", where.alias("w")).select("rep", "cell", "w.*")
    full = dealt.join(classes.select("rep", "copies", "v"), "rep")
    found = cut(full.groupBy("cell", "i", "j").applyInArrow(lambda t: _compare(threshold, grid)(t), "a long, b long, links long"))
    names = components(found.filter("links is null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = found.filter("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_class = classes.select("rep", "label", "h1", "h2", "first", "copies").join(names, F.col("rep") == F.col("node"), "left").drop("node").join(links, "rep", "left")
    of_class = of_class.withColumn("root", F.coalesce("root", "rep")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    of_class = cut(of_class)
    lowest = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(lowest, "root").select("label", "h1", "h2", "links", "component_id")
    linked = good.select("vec_id", "label", "h1", "h2").join(of_class, ["label", "h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    apart = ~usable_vector(F.col("embedding").cast("array<double>")) | F.col("vec_id").isNull() | F.col("label").isNull()
    alone = rows.filter(apart).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
