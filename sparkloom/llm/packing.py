"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A genome is a partition of documents into bins. Crossover injects a run of whole well-filled bins of one parent
into the other, removes the other's bins that hold a duplicate, and best-fits the displaced documents; mutation
dissolves poorly filled bins and best-fits their documents. Fitness is the mean squared fill, fewer bins first.

Documents are dealt by hash to shards of about SHARD pieces. Each shard evolves on ISLANDS islands with seeds of
their own; after an epoch every island gets the elites of all of them, and evolves again; the best genome wins.
Bins that are filled to KEEP stay; the others' documents go into the next round's shards, so that each shard's
last poor bins are packed again with those of other shards, until one shard is left or nothing improves. Every
island seeds a whole population and evolves it, also where a seed has the least possible number of bins; an epoch ends
after GENERATIONS, or STALE of them without a better genome.

Only documents longer than a sequence are cut; full pieces are sequences of their own. Defined cases: a null or
empty text is its end token alone; rows that share an id are packed each on its own; an empty table gives an
empty table. A task holds one shard's lengths, never texts.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidied

CAPACITY = 4096
END = 1
SHARD = 2000
ISLANDS = 3
POPULATION = 4
GENERATIONS = 12
#: Generations without a better genome after which an epoch ends.
STALE = 3
KEEP = 0.985
ROUNDS = 4
#: Words whose ids a task remembers.
CACHE = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words:
    """A tokenizer that remembers words. It drops white space, so that a text's ids are those of its words.

    It also parts letters from marks, so a mark that ends a word is encoded by itself. A word of letters alone is one
    pre-token; many of those are encoded at once by the same model behind a plainer splitter at white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.whole.model)
        self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[bytes, bytes] = {}
        # tokens that end a word
        self.last = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        suffix = self.whole.model.end_of_word_suffix
        for token, i in self.whole.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)

    def _each(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 4096):
            for w, e in zip(words[a : a + 4096], self.whole.encode_batch_fast([w.decode() for w in words[a : a + 4096]], add_special_tokens=False)):
                self.cache[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 64 * 256):
            group = [words[a : a + 64] for a in range(at, min(at + 64 * 256, len(words)), 64)]
            for ws, e in zip(group, self.plain.encode_batch_fast([b" ".join(ws).decode() for ws in group], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                edges = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
                if len(edges) != len(ws) + 1 or edges[-1] != len(ids):
                    self._each(ws)
                    continue
                data = ids.tobytes()
                for w, a, b in zip(ws, edges, edges[1:]):
                    self.cache[w] = data[4 * a : 4 * b]

    def _learn(self, new: list[bytes]) -> None:
        cores: list[tuple[bytes, bytes, bytes]] = []
        rest, letters = [], set()
        for w in new:
            if w.isalpha():  # ASCII letters
                letters.add(w)
                continue
            m = _core.fullmatch(w)
            if m:
                core, mark = m.groups()
                if core.isalpha() or ((t := core.decode()).isalpha() and t.lower().isalpha()):
                    letters.add(core)
                    if mark:
                        cores.append((w, core, mark))
                    continue
            rest.append(w)
        rest += {mark for _, _, mark in cores if mark not in self.cache}
        self._each(rest)
        self._letters([w for w in letters if w not in self.cache])
        for w, core, mark in cores:
            self.cache[w] = self.cache[core] + self.cache[mark]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and the places where each text's begin and the last one's end."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        # letters' case makes no difference but in special tokens
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        known = words.dictionary.cast(pa.binary()).to_pylist()
        new = [w for w in known if w not in self.cache]
        if new:
            self._learn(new)
        found = [*map(self.cache.__getitem__, known)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = b"".join(found)
        at = words.indices
        lists = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)), pa.py_buffer(flat)])
        ids = np.frombuffer(_values(lists.take(at)), dtype="<u4")
        ends = np.concatenate([[0], np.cumsum(size[at.to_numpy()])])
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def _values(array: pa.BinaryArray) -> memoryview:
    """All bytes of an array without nulls."""
    edges = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    return memoryview(array.buffers()[2])[edges[0] : edges[-1]] if len(array) and array.buffers()[2] else memoryview(b"")


#: A word of letters and the marks at its end, which the tokenizer parts.
_core = re.compile(rb"([A-Za-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")
#: Bytes of texts that are encoded at once.
SLICE = 2 << 20


def _slices(texts: pa.Array):
    """Ranges of texts of about SLICE bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, side="right")))
        yield start, end
        start = end


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document's ids and `end`, cut at capacity."""

    def run(batches):
        words = Words(tokenizer_path)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            texts, docs = pc.fill_null(batch.column(1), ""), batch.column(0).to_pylist()
            for a, b in _slices(texts):
                cols: list[list] = [[], [], [], [], [], []]
                ids, places = words.encode(texts.slice(a, b - a))
                for doc_id, lo, hi in zip(docs[a:b], places.tolist(), places[1:].tolist()):
                    data = ids[lo:hi].tobytes() + last
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        for c, x in zip(cols, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                            c.append(x)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    flat = np.frombuffer(b"".join(cols[5]), dtype="<u4").astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)


class Genome:
    """Bins of item positions, with their free space; best fit by a sorted list of (free, bin)."""

    __slots__ = ("bins", "free")

    def __init__(self, bins: list[list[int]], free: list[int]):
        self.bins, self.free = bins, free

    def best_fit(self, items, sizes: list[int], capacity: int) -> None:
        room = sorted((f, b) for b, f in enumerate(self.free))
        for i in items:
            at = bisect_left(room, (sizes[i], -1))
            if at < len(room):
                f, b = room.pop(at)
            else:
                f, b = capacity, len(self.bins)
                self.bins.append([])
                self.free.append(capacity)
            self.bins[b].append(i)
            self.free[b] = f - sizes[i]
            insort(room, (f - sizes[i], b))

    def without(self, gone: set[int]) -> "Genome":
        kept = [b for b in range(len(self.bins)) if b not in gone]
        return Genome([list(self.bins[b]) for b in kept], [self.free[b] for b in kept])

    def score(self, capacity: int) -> tuple[int, float]:
        """Less is better."""
        return len(self.bins), -sum((1 - f / capacity) ** 2 for f in self.free) / max(1, len(self.bins))


def crossover(a: Genome, b: Genome, sizes: list[int], capacity: int, rng) -> Genome:
    """b with some whole well-filled bins of a."""
    ranked = sorted(range(len(a.bins)), key=a.free.__getitem__)[: max(1, len(a.bins) // 2)]
    first = int(rng.integers(len(ranked)))
    chosen = ranked[first : first + max(1, len(a.bins) // 4)]
    injected = {i for c in chosen for i in a.bins[c]}
    hit = {n for n, items in enumerate(b.bins) if any(i in injected for i in items)}
    child = b.without(hit)
    displaced = [i for n in hit for i in b.bins[n] if i not in injected]
    child.bins += [list(a.bins[c]) for c in chosen]
    child.free += [a.free[c] for c in chosen]
    child.best_fit(sorted(displaced, key=lambda i: -sizes[i]), sizes, capacity)
    return child


def mutate(g: Genome, sizes: list[int], capacity: int, rng) -> Genome:
    """Dissolve the emptiest bin and a few others, and best-fit what they held."""
    if len(g.bins) < 2:
        return g
    gone = {max(range(len(g.bins)), key=g.free.__getitem__)} | set(rng.integers(len(g.bins), size=max(1, len(g.bins) // 20)).tolist())
    items = [i for n in gone for i in g.bins[n]]
    child = g.without(gone)
    child.best_fit(sorted(items, key=lambda i: -sizes[i] * (1 + 0.2 * rng.random())), sizes, capacity)
    return child


def evolve(sizes: list[int], seed: list[int], elites: list[list[list[int]]], capacity: int = CAPACITY) -> Genome:
    """One island's epoch, started from the elites that migrated to it."""
    rng = np.random.default_rng(seed)
    people = [Genome(bins, [capacity - sum(sizes[i] for i in items) for items in bins]) for bins in elites]
    order = np.array(sizes, dtype=float)
    while len(people) < POPULATION:
        g = Genome([], [])
        noise = rng.random(len(sizes)) * (0.0 if not people else 0.3)
        g.best_fit(np.argsort(-order * (1 - noise), kind="stable").tolist(), sizes, capacity)
        people.append(g)
    key = lambda g: g.score(capacity)
    people.sort(key=key)
    stale = 0
    for _ in range(GENERATIONS):
        a, b = (people[int(i)] for i in rng.choice(len(people), 2, replace=False))
        child = mutate(crossover(a, b, sizes, capacity, rng), sizes, capacity, rng)
        stale = 0 if key(child) < key(people[0]) else stale + 1
        people = sorted([*people, child], key=key)[:POPULATION]
        if stale == STALE:
            break
    return people[0]


ISLAND = "shard long, island int, item long, length long, bin int, bins int, fitness double"


def _epoch(epoch: int, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        shard, island = table["shard"][0].as_py(), table["island"][0].as_py()
        item, length, origin, bins = (table[c].to_numpy() for c in ("item", "length", "origin", "bin"))
        names, first = np.unique(item, return_index=True)
        sizes = length[first].tolist()
        at = np.searchsorted(names, item)
        elites = []
        for o in np.unique(origin[origin >= 0]):
            own = origin == o
            genome: dict[int, list[int]] = {}
            for i, b in zip(at[own].tolist(), bins[own].tolist()):
                genome.setdefault(b, []).append(i)
            elites.append([sorted(genome[b]) for b in sorted(genome)])
        best = evolve(sizes, [epoch, island, shard], elites, capacity)
        of = np.zeros(len(names), dtype=np.int32)
        for b, items in enumerate(best.bins):
            of[items] = b
        n, fitness = best.score(capacity)
        return pa.table({
            "shard": pa.array(np.full(len(names), shard), pa.int64()), "island": pa.array(np.full(len(names), island), pa.int32()), "item": pa.array(names, pa.int64()),
            "length": pa.array(sizes, pa.int64()), "bin": pa.array(of, pa.int32()), "bins": pa.array(np.full(len(names), n), pa.int32()), "fitness": pa.array(np.full(len(names), fitness), pa.float64()),
        })

    return run


def _islands(items: DataFrame, shards: int, turn: int, capacity: int) -> DataFrame:
    """item, length, bin (unique in this round): the best of all islands of each shard."""
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(shards)))
    start = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "item", "length", F.lit(-1).alias("origin"), F.lit(-1).alias("bin"))
    lived = cut(start.groupBy("shard", "island").applyInArrow(_epoch(0, capacity), ISLAND))
    moved = lived.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("to"), "item", "length", F.col("island").alias("origin"), "bin")
    lived = cut(moved.withColumnRenamed("to", "island").groupBy("shard", "island").applyInArrow(_epoch(1, capacity), ISLAND))
    best = lived.groupBy("shard").agg(F.min(F.struct("bins", "fitness", "island")).alias("best")).select("shard", F.col("best.island").alias("island"))
    return cut(lived.join(best, ["shard", "island"]).select("item", "length", ((F.col("shard") * (1 << 20) + F.col("bin")) * 8 + turn).alias("sequence_id")))


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """item, sequence_id for each of items (item unique, length 1 to capacity); sequences hold at most capacity."""
    full = items.filter(F.col("length") >= capacity).select("item", (F.col("item") * 8 + 7).alias("sequence_id"))
    todo, done, before = cut(items.filter(F.col("length") < capacity).select("item", "length")), [full], None
    for turn in range(ROUNDS):
        n = todo.count()
        if not n:
            break
        shards = -(-n // shard)
        placed = _islands(todo, shards, turn, capacity)
        fills = placed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        if shards == 1 or turn == ROUNDS - 1 or n == before:
            done.append(placed.select("item", "sequence_id"))
            break
        kept = placed.join(fills.filter(F.col("fill") >= int(KEEP * capacity)).select("sequence_id"), "sequence_id", "left_semi")
        done.append(kept.select("item", "sequence_id"))
        todo, before = cut(placed.join(fills.filter(F.col("fill") < int(KEEP * capacity)).select("sequence_id"), "sequence_id", "left_semi").select("item", "length")), n
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of docs (doc_id, text)."""
    parts = cut(pieces(docs, tokenizer_path, capacity, end, keep_ids=False).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(parts.select("item", "length"), capacity)
    order = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(placed, "item").withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("item")


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed token sequences themselves, each at most capacity ids long."""
    parts = cut(pieces(docs, tokenizer_path, capacity, end).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(parts.select("item", "length"), capacity)
    rows = parts.join(placed, "item").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("item", "doc_id", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
