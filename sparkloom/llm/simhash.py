"""SimHash near-duplicates: BK-trees over shards of fingerprints.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles; two texts are linked if
their fingerprints differ in at most `radius` bits. Equal fingerprints are one entry. Entries go to shards of about
FILL so that every pair within the radius meets in some shard. A shard's entries form a BK-tree, whose children are
keyed by the integer Hamming distance to their parent, and a search follows only edges within the radius of the
query's distance. The trees hold all fingerprints, which must never meet on the driver, so a tree isn't broadcast
through it: it lives in the task where its shard's queries are dealt. A shard over SHARD entries is cut into chunks,
and each chunk's tree is asked by every chunk. Shards return a spanning forest of their links, by distance and
fingerprint, so that reruns agree; connected components are found on those.
Where an exact similarity is asked for, fingerprints are of distinct shingles, entries are sets of shingles, and
every link is confirmed by its sets. That first pass may lose links; an exact one follows. Two sets of n and m
shingles with a similarity of t or more share at least a = ceil(t (n + m) / (1 + t)). With the shingles of all sets in
one order (rare ones first), j of those, and j may be any number up to a, are among the first n - a + j of the one and
the first m - a + j of the other. Entries that share MEET shingles there (a, if that is less) and are not yet in one
component are confirmed like the others, so every pair of that similarity ends in one component. Each entry's most
promising pairs are confirmed first, as most others then lie within a component and need no reading.

Shards: with 64 bits and a small radius the bits are cut into `radius + e` blocks and a shard is named by bits of e
of them, which agree for every pair within the radius (pigeonhole, exact); e grows with the table. Wide fingerprints
with a wide radius are sharded by seeded samples of bit positions instead, as many that a pair `sure` bits apart
meets with probability RECALL or more; farther pairs meet less often, and the exact pass finds what is missed.

Defined cases: null texts and texts without words have fingerprint 0 and are linked as any other; texts with
fewer words than a shingle give one shingle of all their words; rows that share an id are rows of their own, in
the component of the smallest id linked; a null id stays null and names no component but its own fingerprint's;
an empty table gives an empty table. Long texts are hashed in runs of RUN shingles.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hits, row_key, tidied, with_partitions
from .components import components

SEED = 42
RUN = 1 << 15
SHARD = 4096
#: Links that are held before all but a spanning forest of them go.
LINKS = 200_000
RECALL = 0.9
#: Mean entries of a shard, at least; of shards named by samples of bits.
FILL = 1024
FILL_SAMPLED = 256
#: Shingles that two sets have to share at the front.
MEET = 3
#: Rounds that confirm only the most promising pair of each entry, before all that are left are.
PICKS = 2
#: Places of trees that are visited at once.
VISITS = 1 << 20
#: One of so many rows is read for frequent shingles, which come so often there; no more than COMMON are told apart.
SAMPLE = 32
OFTEN = 4
COMMON = 50_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | bytes | None, words: int, seed: int = SEED):
    """XXH64 of each shingle of the text, A-Z lower-cased, in arrays of at most RUN."""
    data = (text.encode() if isinstance(text, str) else text or b"").translate(LOWER)
    parts = data.split()
    if not parts:
        return
    data, n = b" ".join(parts), len(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, n)
    lo, hi = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, len(lo), RUN):
        yield np.array([hash64(data[a:b], seed) for a, b in zip(lo[at : at + RUN], hi[at : at + RUN])], dtype=np.uint64)


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(np.concatenate([*shingle_hashes(text, words)] or [np.zeros(0, dtype=np.uint64)]))


def fingerprint(text: str | bytes | None, words: int = 3, width: int = 1) -> list[int]:
    """width unsigned numbers of 64 bits; those after the first come from remixed hashes."""
    return _bits(shingle_hashes(text, words), width)


def _bits(runs, width: int) -> list[int]:
    counts, n = np.zeros((width, 64), dtype=np.int64), 0
    for hashes in runs:
        n += len(hashes)
        for w in range(width):
            if w:
                hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for at in range(0, len(bits), 255):  # sums of up to 255 fit a byte
                counts[w] += bits[at : at + 255].sum(0, dtype=np.uint8)
    return [int(np.packbits(c * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0 for c in counts]


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1) -> DataFrame:
    """doc_id, row_key, fp: array of `width` longs with the fingerprint's bits."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, words, width) for t in batch.column(2).to_pylist()]
            flat = np.array(found, dtype=np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("binary").alias("text")).mapInArrow(tidied(run), "doc_id long, row_key long, fp array<long>")


def frequent_shingles(docs: DataFrame, words: int) -> list[int]:
    """Shingles of several documents of a sample, the most frequent first. Results don't hang on them, only time does."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], ["s"])

    some = docs.filter(F.pmod(row_key(), F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary").alias("text"))
    counts = some.mapInArrow(tidied(run), "s long").groupBy("s").count().filter(F.col("count") >= OFTEN)
    return [r["s"] for r in counts.orderBy(F.desc("count"), "s").limit(COMMON).collect()]


def prefix(found: np.ndarray, common: np.ndarray, places: np.ndarray, similarity: float) -> np.ndarray:
    """The least shingles of a set, rare ones first: of sets that are so similar the least share MEET, or all that they share."""
    size = len(found) - math.ceil(similarity * len(found) - 1e-9) + MEET
    at = np.searchsorted(common, found)
    known = np.zeros(len(found), dtype=np.int64)
    if len(common):
        at = np.minimum(at, len(common) - 1)
        known = np.where(common[at] == found, places[at], 0)
    return found[np.lexsort((found, known))[:size]]


def shingle_sets(docs: DataFrame, words: int, width: int, similarity: float) -> DataFrame:
    """doc_id, row_key, fp of the distinct shingles, n of them, their prefix, s1 and s2: 128 bits that name the set; row: a number."""
    often = np.array(frequent_shingles(docs, words), dtype=np.int64).view(np.uint64)
    order = np.argsort(often)
    common, places = often[order], len(often) - order

    def run(batches):
        for batch in batches:
            flat, n, names, least = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, words)
                flat += _bits((found[i : i + RUN] for i in range(0, len(found), RUN)), width)
                n.append(len(found))
                least.append(prefix(found, common, places, similarity))
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), pa.array(np.array(flat, dtype=np.uint64).view(np.int64)))
            starts = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *least]).view(np.int64)))
            s = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(n, pa.int32()), prefixes, pa.array(s[:, 0]), pa.array(s[:, 1])], ["doc_id", "row_key", "fp", "n", "prefix", "s1", "s2"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(tidied(run), "doc_id long, row_key long, fp array<long>, n int, prefix array<long>, s1 long, s2 long")
    return found.withColumn("row", F.monotonically_increasing_id())


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKTrees:
    """A BK-tree for each group of entries, in flat arrays that are built a level at a time.

    values: rows of 64-bit words; roots: the first entry of each entry's group. An entry goes down from its root:
    where no child stands at its distance it becomes that child, else it goes on from there.
    """

    def __init__(self, values: np.ndarray, roots: np.ndarray):
        self.values, self.span = values, 64 * values.shape[1] + 1
        keys, nodes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        todo = np.flatnonzero(roots != np.arange(len(roots)))
        at = roots[todo]
        while len(todo):
            key = at * self.span + _apart(values[todo], values[at])
            taken, first, of = np.unique(key, return_index=True, return_inverse=True)
            child = todo[first]
            keys.append(taken)
            nodes.append(child)
            more = np.ones(len(todo), dtype=bool)
            more[first] = False
            at, todo = child[of][more], todo[more]
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(key)
        #: An edge is named by its parent and its distance.
        self.key, self.node = key[order], node[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of all entries of the trees at roots, one for each query, within the radius."""
        found = []
        asked, at = np.arange(len(queries)), roots
        while len(asked):
            d = _apart(queries[asked], self.values[at])
            hit = d <= radius
            found.append((asked[hit], at[hit], d[hit]))
            base = at * self.span
            lo = np.searchsorted(self.key, base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, base + np.minimum(d + radius, self.span - 1), side="right") - lo
            asked = np.repeat(asked, n)
            at = self.node[np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3


def _links(values: np.ndarray, group: np.ndarray, build: np.ndarray, probe: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """A spanning forest of the links between entries of a group to build and to probe, least distances first: (distance, place, place).

    Rows are sorted by group. A forest of several blocks of queries is one of the forests of those before it and theirs.
    """
    built = np.flatnonzero(build)
    if not len(built):
        return []
    owner = group[built]
    starts = np.searchsorted(owner, owner)
    trees = BKTrees(values[built], starts)
    asked = np.flatnonzero(probe)
    root = np.searchsorted(owner, group[asked])
    there = np.minimum(root, len(owner) - 1)
    asked, root = (x[owner[there] == group[asked]] for x in (asked, there))
    largest = int(np.bincount(starts).max())
    kept: list[tuple[int, int, int]] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, VISITS // largest)
    for at in range(0, len(asked), step):
        q, e, d = trees.within(values[asked[at : at + step]], root[at : at + step], radius)
        i, j = asked[at : at + step][q], built[e]
        # where both search and stand in the tree, a link is found from either end
        own = (i > j) | (i < j) & ~(build[i] & probe[j])
        held.append((d[own], i[own], j[own]))
        if sum(len(x[0]) for x in held) > LINKS:
            kept, held = _forest(kept, held, len(values)), []
    return _forest(kept, held, len(values))


def _forest(kept: list[tuple[int, int, int]], more: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int, int]]:
    """A minimum spanning forest of (distance, place, place)."""
    up, out = list(range(n)), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    links = [*kept, *(link for d, i, j in more for link in zip(d.tolist(), i.tolist(), j.tolist()))]
    for d, i, j in sorted(links):
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            out.append((d, i, j))
    return out


def _scan(radius: int, width: int):
    """Search the shards of a partition that is sorted by shard; those of a batch, or one that goes on, are held."""

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = pa.concat_tables([rest, table]) if table is not None else rest
            if table is None or not table.num_rows:
                continue
            place = np.rec.fromarrays([table[c].to_numpy() for c in ("kind", "key", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
            if batch is not None:  # the last shard may go on
                rest, starts = table.slice(starts[-2]).combine_chunks(), starts[:-1]
            whole = table.slice(0, starts[-1]).combine_chunks()
            if not whole.num_rows:
                continue
            entry, build, probe = (whole[c].to_numpy(zero_copy_only=False) for c in ("entry", "build", "probe"))
            values = whole["fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, width)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            # by fingerprint, so that the forest doesn't hang on the order in which rows came
            order = np.lexsort((*values.T, group))
            links = np.array(_links(values[order], group, build[order], probe[order], radius), dtype=np.int64).reshape(-1, 3)
            u, v = (entry[order[links[:, k]]] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links[:, 0], pa.int64())], ["u", "v", "d"])

    return run


def block_masks(n: int, radius: int) -> list[list[int]]:
    """Bit positions of each shard kind, so that any pair of 64 bits within the radius agrees on one kind.

    No more bits than leave FILL entries in a shard, so that trees are large and shards few.
    """
    want = max(0, math.ceil(math.log2(max(n, 1) / FILL)))
    if not want:
        return [[]]  # one tree for all
    for e in range(1, 6):
        blocks = radius + e
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        of_block = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
        if e * min(map(len, of_block)) >= want:
            break
    return [sorted(itertools.chain(*(of_block[b][: -(-want // e)] for b in chosen))) for chosen in itertools.combinations(range(blocks), e)]


def sampled_masks(n: int, radius: int, width: int) -> list[list[int]]:
    """Bit positions of each shard kind: seeded samples of which a pair at the radius shares one with probability RECALL."""
    bits = 64 * width
    size = max(4, math.ceil(math.log2(max(n, 1) / FILL_SAMPLED + 1)))
    agree = math.prod((bits - radius - i) / (bits - i) for i in range(size))
    kinds = math.ceil(math.log(1 - RECALL) / math.log(1 - agree))
    rng = np.random.default_rng(SEED)
    return [sorted(rng.choice(bits, size, replace=False).tolist()) for _ in range(kinds)]


def linked(entries: DataFrame, n: int, radius: int, width: int, exact: bool, shard: int = SHARD, shards_for: int | None = None) -> DataFrame:
    """u, v, d: a forest of the links between entries (entry, fp), whose fingerprints all differ."""
    masks = block_masks(n, radius) if exact else sampled_masks(n, shards_for or radius, width)

    def key(mask: list[int]):
        words: dict[int, int] = {}
        for bit in mask:
            words[bit // 64] = words.get(bit // 64, 0) | 1 << bit % 64
        parts = [F.element_at("fp", w + 1).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for w, m in sorted(words.items())] or [F.lit(0).cast("long")]
        return parts[0] if len(parts) == 1 else F.xxhash64(*parts)

    keys = F.posexplode(F.array(*map(key, masks))).alias("kind", "key")
    dealt = entries.select("entry", "fp", keys)
    hot = cut(dealt.groupBy("kind", "key").count().filter(F.col("count") > shard))
    one = F.lit(0)
    if hot.isEmpty():
        dealt = dealt.select("kind", "key", one.alias("i"), one.alias("j"), F.lit(True).alias("build"), F.lit(True).alias("probe"), "entry", "fp")
    else:
        dealt = dealt.join(hot, ["kind", "key"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("count") / shard), F.lit(1)).cast("int"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int"))
        # chunk i asks the tree of chunk j <= i
        where = F.expr(
            "explode(concat(transform(sequence(0, own), x -> named_struct('i', own, 'j', x, 'build', x = own, 'probe', true)),"
            "transform(filter(sequence(0, chunks - 1), x -> x > own), x -> named_struct('i', x, 'j', own, 'build', true, 'probe', false))))"
        )
        dealt = dealt.select("kind", "key", "entry", "fp", where.alias("w")).select("kind", "key", "w.*", "entry", "fp")
    placed = with_partitions(dealt, "kind", "key", "i", "j").sortWithinPartitions("kind", "key", "i", "j")
    return placed.mapInArrow(tidied(_scan(radius, width)), "u long, v long, d long")


def similar(edges: DataFrame, entries: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The edges (u, v) whose texts' sets of shingles have at least that Jaccard similarity.

    entries: entry, first, key: the row that an entry stands for. Only texts of the edges' ends are shuffled.
    """

    def read(batches):
        for batch in batches:
            found = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *found])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["entry", "s"])

    ends = edges.select(F.col("u").alias("entry")).union(edges.select(F.col("v").alias("entry"))).distinct()
    wanted = cut(ends.join(entries, "entry").select("entry", "first", "key"))
    rows = docs.select(_id("doc_id").alias("first"), row_key().alias("key"), F.col("text").cast("binary").alias("text"))
    rows = hits(rows, wanted, ["first", "key"], wanted.count()).filter("hit").join(wanted, ["first", "key"])
    # rows that share id and text are one
    rows = rows.groupBy("first", "key", "entry").agg(F.first("text").alias("text"))
    sets = cut(rows.select("entry", "text").mapInArrow(tidied(read), "entry long, s array<long>"))
    both = edges.join(sets.select(F.col("entry").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("entry").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _meetings(similarity: float):
    """Of rows sorted by token, the pairs of a token's entries that no links join and whose sizes allow the similarity."""

    def pairs(entry, root, n, at):
        order = np.lexsort((entry, n))
        entry, root, n, at = entry[order], root[order], n[order], at[order]
        ends = np.searchsorted(n, n / similarity + 1e-9, side="right")
        for i, end in enumerate(ends.tolist()):
            share = np.ceil((n[i] + n[i + 1 : end]) * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)
            spare = np.minimum(MEET, share) - share
            to = np.flatnonzero((root[i + 1 : end] != root[i]) & (at[i] < n[i] + spare) & (at[i + 1 : end] < n[i + 1 : end] + spare))
            if len(to):
                share, to = share[to], to + i + 1
                yield np.stack([np.full(len(to), entry[i]), entry[to], np.minimum(MEET, share)])

    def out(found):
        rows, times = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True) if found else (np.zeros((3, 0), dtype=np.int64), [])
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows), pa.array(times, pa.int64())], ["u", "v", "least", "times"])

    def run(batches):
        rest, found, held = None, [], 0
        for batch in itertools.chain(batches, [None]):
            cols = [batch.column(i).to_numpy() for i in range(5)] if batch is not None else [np.zeros(0, dtype=np.int64)] * 5
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            token = cols[0]
            if not len(token):
                continue
            starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
            ends = np.append(starts[1:], len(token))
            if batch is not None:  # the last token may go on
                rest = [c[starts[-1] :] for c in cols]
                starts, ends = starts[:-1], ends[:-1]
            if not len(starts):
                continue
            whole = cols[2][: ends[-1]]
            apart = np.minimum.reduceat(whole, starts) != np.maximum.reduceat(whole, starts)
            for a, b in zip(starts[apart].tolist(), ends[apart].tolist()):
                for x in pairs(*(c[a:b] for c in cols[1:])):
                    found.append(x)
                    held += x.shape[1]
                    if held > LINKS:
                        yield out(found)
                        found, held = [], 0
        yield out(found)

    return run


def met(entries: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """u, v, times: entries (entry, n, prefix) that no component of names (node, root) joins and that share enough shingles at the front."""
    of = entries.join(names, F.col("entry") == F.col("node"), "left").withColumn("root", F.coalesce("root", "entry"))
    tokens = of.select(F.posexplode("prefix").alias("at", "token"), "entry", "root", "n").select("token", "entry", "root", F.col("n").cast("long"), F.col("at").cast("long"))
    placed = with_partitions(tokens, "token").sortWithinPartitions("token")
    found = placed.mapInArrow(tidied(_meetings(similarity)), "u long, v long, least long, times long")
    return found.groupBy("u", "v", "least").agg(F.sum("times").alias("times")).filter("times >= least").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "times")


def promising(pairs: DataFrame) -> DataFrame:
    """u, v: of pairs (u, v, times), those that share most, one for each entry."""
    best = lambda a, b: pairs.groupBy(a).agg(F.max(F.struct("times", b)).alias("best")).select(a, F.col(f"best.{b}")).select("u", "v")
    return best("u", "v").union(best("v", "u")).distinct()


def apart(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (u, v, ...) that no component of names (node, root) joins."""
    roots = lambda c: names.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
    both = pairs.join(roots("u"), "u", "left").join(roots("v"), "v", "left")
    return both.filter("coalesce(of_u, u) <> coalesce(of_v, v)").select(*pairs.columns)


NO_ID = -(1 << 63) + 1


def _id(name: str) -> Column:
    """An id that stands for null too."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, width: int = 1, sure: int | None = None, similarity: float = 0.0) -> DataFrame:
    """doc_id, row_key, fp, component_id, component: one row for each row of docs (doc_id, text).

    With width 1 every pair within the radius is linked; wider fingerprints that are `sure` bits apart meet with
    probability RECALL at least. With `sure`, fingerprints are of distinct shingles, texts with the same set of
    shingles are one entry, and links count only if the sets have that Jaccard similarity. Pairs that the shards
    miss, or that a forest left out for links which then failed, meet by a shingle of their prefixes: none is lost.
    """
    key = F.min(F.struct(_id("doc_id").alias("first"), F.col("row_key").alias("key"))).alias("of")
    if sure is None:
        by, rows = ["fp"], cut(fingerprints(docs, words, width))
        entries = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("entry", F.monotonically_increasing_id()))
    else:
        by, rows = ["s1", "s2"], cut(shingle_sets(docs, words, width, similarity))
        entries = cut(rows.groupBy(*by).agg(F.min("row").alias("entry"), F.min("doc_id").alias("first"), key, F.first("fp").alias("fp")))
    edges = linked(entries.select("entry", "fp"), entries.count(), radius, width, width == 1, shards_for=sure).select("u", "v")
    if sure is not None:
        of = entries.select("entry", "of.*")
        edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        edges = cut(similar(edges, of, docs, words, similarity))
        firsts = rows.select(F.col("row").alias("entry"), "n", "prefix").join(entries.select("entry"), "entry", "left_semi")
        names = components(edges)
        more = cut(met(firsts, names, similarity))
        for turn in range(PICKS + 1):
            if more.isEmpty():
                break
            tried = cut(promising(more)) if turn < PICKS else more.select("u", "v")
            edges = cut(edges.union(similar(tried, of, docs, words, similarity)))
            names = components(edges)
            more = cut(apart(more.join(tried, ["u", "v"], "left_anti"), names)) if turn < PICKS else more
    else:
        names = components(edges)
    of = entries.join(names, F.col("entry") == F.col("node"), "left").withColumn("root", F.coalesce("root", "entry"))
    of = cut(of.select(*by, "first", "root"))
    lowest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rows.select("doc_id", "row_key", *dict.fromkeys(["fp", *by])).join(of.join(lowest, "root").select(*by, "component_id", F.col("root").alias("component")), by)
    return found.select("doc_id", "row_key", "fp", "component_id", "component")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 52, width: int = 4, sure: int = 40, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component, that of the smallest id, with its columns as they were.

    Only rows that go, and rows that are repeated whole, are shuffled.
    """
    found = cut(near_duplicates(docs, words, radius, width, sure, similarity).select(_id("doc_id").alias("id"), F.col("row_key").alias("key"), "component"))
    # rows that share id and text are in one component; ids come before none
    each = found.groupBy("id", "key").agg(F.min("component").alias("component"), F.count("*").alias("n"))
    first = each.groupBy("component").agg(F.min(F.struct((F.col("id") == NO_ID).alias("none"), "id", "key")).alias("least"))
    # joined by row, as a component may hold a third of them
    first = first.select("least.id", "least.key", F.lit(True).alias("stays"))
    some = each.join(first, ["id", "key"], "left").select("id", "key", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    some = cut(some.filter("n > 1 or not stays"))
    # a row's columns travel as one, apart from its key
    keyed = docs.select(_id("doc_id").alias("id"), row_key().alias("key"), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"))
    keyed = hits(keyed, some, ["id", "key"], some.count())
    same = keyed.filter("hit").join(some, ["id", "key"], "left")
    once = same.filter("stays").dropDuplicates(["id", "key"])
    kept = keyed.filter("not hit").select("row").unionByName(same.filter("stays is null").select("row")).unionByName(once.select("row"))
    return kept.select(*[F.col(f"row.`{n}`") for n in docs.columns])


def hexed(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
