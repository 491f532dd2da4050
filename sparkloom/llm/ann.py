"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Codes: vectors are lifted by one component so that the largest inner product is the smallest angle, turned by
rotations learned on a sample (principal axes, then iterative quantization, from several starts) and cut to signs:
BITS bits. An index shard keeps the codes' substrings in bucket tables of their own, of 8 bits each or, from LONG_FROM
rows, 16. A query probes, by the pigeonhole rule, in each substring the buckets within its share of the radius, so every
code within the radius is met (once most of a shard's codes are, the others' are read too); those that are within it
are reranked by the float vectors in double precision. The radius is the sample's QUANTILE of code distances from queries to their true nearest, which are farther in a sample than
in the whole table. Where a shard has fewer than k codes within it, the query's radius grows by a bit in each substring
until k codes are proven, or all rows of the shard are met.

Queries are dealt in blocks and rows in shards, both by hash of the row; each pair of a block and a shard of vectors
of one length is a task of at most about QUERY_BLOCK queries and INDEX_ROWS rows, which returns the k best of its shard
for each query, and a ranked window merges them. Scores are summed alike for every row, so equal vectors tie whatever
shard or place they have. How much the probing leaves out hangs on the vectors: near-random ones have their nearest
almost as far as any others, and no radius that holds them spares buckets; see the README.

Defined cases: null or zero vectors and vectors with null or non-finite components take no part, neither do rows
without id; vectors are compared with those of their length only; rows that share the query's id are its own; a table
with fewer than k candidates gives them all; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 256
SAMPLE = 4096
QUERY_BLOCK = 8192
#: Rows of a shard that are indexed at once.
INDEX_ROWS = 1 << 17
#: Rows below which no further shard is made for the sake of more tasks.
LEAST_ROWS = 4096
#: Rows of a shard from which substrings have 16 bits.
LONG_FROM = 1 << 15
QUANTILE = 0.97
SEED = 7
OUT = "query_row long, query_id long, vec_id long, score double"


def usable_vector(v: Column) -> Column:
    """Whether a vector (array<double>) can be compared; never null."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that can be compared, with the vector as array<double> named v."""
    return vectors.withColumn("v", F.col(vector).cast("array<double>")).filter(F.col("vec_id").isNotNull() & usable_vector(F.col("v")))


def itq(x: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """A rotation under which signs lose little of x."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


class Codes:
    """Learned codes: lift, rotate, cut to signs."""

    def __init__(self, sample: np.ndarray, largest: float, k: int, bits: int = BITS):
        rng = np.random.default_rng(SEED)
        self.largest = largest
        x = self._lift(sample)
        axes = np.linalg.eigh(x.T @ x)[1]
        turns = []
        while sum(t.shape[1] for t in turns) < bits:
            turns.append(axes @ itq(x @ axes, rng))
        self.turn = np.concatenate(turns, axis=1)[:, :bits]
        self.radius = self._learned_radius(sample, k)

    def _lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
        x = x / self.largest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], axis=1)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.packbits(self._lift(x, query) @ self.turn >= 0, axis=1)

    def _learned_radius(self, sample: np.ndarray, k: int) -> int:
        queries = sample[:256]
        near = queries @ sample.T
        near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return self.turn.shape[1]
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(self.encode(queries, True)[:, None, :] ^ self.encode(sample)[best]).sum(-1, dtype=np.int64)
        return int(np.quantile(apart, QUANTILE))


class MultiIndex:
    """One shard: a bucket table for each substring of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = np.ascontiguousarray(codes).view(np.uint64) if codes.shape[1] % 8 == 0 else codes
        self.bits = 16 if len(codes) >= LONG_FROM and codes.shape[1] % 2 == 0 else 8
        self.parts = self._parts(codes)
        self.order = np.argsort(self.parts, axis=0, kind="stable")
        self.starts = np.stack([np.searchsorted(self.parts[self.order[:, j], j], np.arange((1 << self.bits) + 1)) for j in range(self.parts.shape[1])])
        #: What differs from a substring by few bits first; of[s]: how many by s bits or fewer.
        values = np.arange(1 << self.bits, dtype=np.int64)
        self.flips = values[np.argsort(np.bitwise_count(values), kind="stable")]
        self.of = np.cumsum(np.bincount(np.bitwise_count(values)))

    def _parts(self, codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint16) if self.bits == 16 else codes

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions of every code within the radius, their distances, and how many codes were met."""
        met = np.zeros(len(self.codes), dtype=bool)
        own = self._parts(code.reshape(1, -1))[0].astype(np.int64)
        share, rest = divmod(radius, len(own))
        for j, value in enumerate(own):
            # distances sum to at most radius: one of the first rest + 1 parts is within share, or one of the others within share - 1
            s = min(share if j <= rest else share - 1, self.bits)
            if s < 0:
                continue
            buckets = self.flips[: self.of[s]] ^ value
            lo, n = self.starts[j, buckets], self.starts[j, buckets + 1] - self.starts[j, buckets]
            full = n > 0
            lo, n = lo[full], n[full]
            met[self.order[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n), j]] = True
            if 2 * np.count_nonzero(met) > len(met):  # reading the others' codes is less work than probing on
                met[:] = True
                break
        found = np.flatnonzero(met)
        away = np.bitwise_count(self.words[found] ^ code.view(self.words.dtype)).sum(1, dtype=np.int64)
        near = away <= radius
        return found[near], away[near], len(found)

    def nearest(self, code: np.ndarray, radius: int, k: int) -> np.ndarray:
        """Positions of every code within the radius, and of the k nearest codes and those as near, if that is farther."""
        asked, k = radius, min(k, len(self.codes))
        while True:
            found, away, _ = self.within(code, radius)
            if len(found) >= k:
                return found[away <= max(asked, np.partition(away, k - 1)[k - 1] if k else 0)]
            radius += self.parts.shape[1]


def nearest(vectors: DataFrame, is_query, k: int = 20, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, index_rows: int = INDEX_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, its k nearest by inner product."""
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("q"), F.size("v").alias("d"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("m"), F.max(norm).alias("largest")).filter("m > 0").collect()
    learned, plan, tasks = {}, [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    for size in sizes:
        of_size = rows.filter(F.col("d") == size["d"])
        seen = of_size.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).select("v").toPandas()["v"]
        learned[size["d"]] = Codes(np.stack([np.asarray(x, dtype=np.float64) for x in seen]), size["largest"], k)
        blocks, shards = -(-size["m"] // query_block), max(-(-size["n"] // index_rows), min(tasks, -(-size["n"] // LEAST_ROWS)))
        plan.append((size["d"], blocks, shards))
    sent = spark.sparkContext.broadcast(learned)
    dealt = rows.join(F.broadcast(spark.createDataFrame(plan, "d int, blocks int, shards int")), "d")
    place = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    indexed = dealt.select("d", every("blocks").alias("block"), place(1, "shards").alias("shard"), F.lit(False).alias("q"), "row", "vec_id", "v")
    asked = dealt.filter("q").select("d", place(2, "blocks").alias("block"), every("shards").alias("shard"), "q", "row", "vec_id", "v")
    found = indexed.unionByName(asked).groupBy("d", "block", "shard").applyInArrow(_searcher(sent, k), OUT)
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _searcher(sent, k: int):
    def search(table: pa.Table) -> pa.Table:
        codes = sent.value[table["d"][0].as_py()]
        is_query = table["q"].to_numpy()
        row, vec_id = table["row"].to_numpy(), table["vec_id"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        ids, x = vec_id[~is_query], v[~is_query]
        out: list[tuple] = []
        if len(ids):
            index, longest = MultiIndex(codes.encode(x)), np.sqrt((x * x).sum(1).max())
            for query_row, query_id, query in zip(row[is_query].tolist(), vec_id[is_query].tolist(), v[is_query]):
                # rows that share the query's id are its own and don't count among the k
                own = int((ids == query_id).sum())
                at = index.nearest(codes.encode(query[None, :], True)[0], codes.radius, k + own)
                at = at[ids[at] != query_id]
                if len(at) > k:  # rough products, rounded by place, then the same sum for every row, so that copies tie
                    rough = x[at] @ query
                    slack = 1e-12 * longest * np.linalg.norm(query)
                    at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - slack]
                score = (x[at] * query).sum(1)
                best = np.lexsort((ids[at], -score))[:k]
                out.append((np.full(len(best), query_row), np.full(len(best), query_id), ids[at][best], score[best]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        cols = [np.concatenate([o[i] for o in out]) if out else [] for i in range(4)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_row", "query_id", "vec_id", "score"])

    return search
