"""Suffix-array dedup: remove every byte that a LENGTH-byte string covers which also starts elsewhere.

A window is a string of LENGTH bytes. Its anchor is its GRAM-byte string of least hash, the leftmost on ties;
equal windows have equal anchors at equal places, so a window has to be compared only with windows of the same
anchor. Consecutive windows that share an anchor are a run, and the bytes they span are the run's context.

1. Runs of all documents are dealt by anchor. Runs with equal contexts repeat as a whole. Anchors whose runs all
   are equal, or that are alone, are settled, which leaves one run for each different context where they differ.
2. The contexts of those are compared through a logarithmic index family: contexts come in batches, a batch
   gets a suffix array of its windows, which is merge-scanned against the suffix arrays of the levels for
   suffixes that agree on LENGTH bytes; equal-sized levels merge, so their sizes grow geometrically.
   Anchors with more than HOT different contexts would fill a task; their windows are counted by hash instead.
3. Each document's repeated windows are merged to spans, and the spans are cut out.

Of texts only those are shuffled whose contexts have to be compared (2) or that lose something (3). Defined cases: a null text is empty; rows that share an id are
rows of their own, and a repeated row is a repetition; a text shorter than LENGTH loses nothing; long texts are
read in runs of CHUNK windows; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hits, tidied, with_partitions

LENGTH = 400
GRAM = 128
CHUNK = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: Different contexts of an anchor beyond which its windows are counted by hash.
HOT = 2000
#: Contexts of a batch.
BATCH = 64
#: Runs or contexts that a task gives at once; contexts are below LENGTH * 2 bytes.
ROWS = 1 << 14
#: Contexts that a task remembers to have dealt.
SEEN = 150_000
SEED = 3
#: Stands for a null id while rows are matched.
NO_ID = -(1 << 63) + 1
RUNS = "doc_id long, row_key long, anchor long, context long, lo int, n int, known boolean"
_rng = np.random.default_rng(SEED)
_SYMBOLS = _rng.integers(1 << 63, size=256, dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _MULTIPLIER)]))
            down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
        _powers[size] = up, down
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of each string of `gram` bytes."""
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_SYMBOLS[data] * up[: len(data)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(sums) - gram]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    table = padded.reshape(rows, w)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first window, windows, anchor, context) of each run, anchor and context as signed 64-bit hashes."""
    windows = len(text) - length + 1
    for at in range(0, windows, CHUNK):
        part = text[at : at + CHUNK + length - 1]
        h = gram_hashes(np.frombuffer(part, dtype=np.uint8), gram)
        best = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & PLACE
        starts = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]])
        anchors = h[best[starts[:-1]].astype(np.int64)].view(np.int64).tolist()
        edges = starts.tolist()
        for a, b, anchor in zip(edges, edges[1:], anchors):
            context = xxhash.xxh3_64_intdigest(part[a : b + length - 1])
            yield at + a, b - a, anchor, context - (1 << 63)


def _find_runs(length: int, gram: int):
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()]

    def told_runs(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "row_key", "anchor", "context", "lo", "n", "known"])

    def find(batches):
        # a task deals each context of an anchor twice at most: more only tell that they repeat, and go anywhere
        once: set[int] = set()
        twice: set[int] = set()
        part, told = TaskContext.get().partitionId(), 0
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            ids, keys, texts = batch.columns
            for row in range(batch.num_rows):
                doc_id, key = ids[row].as_py(), keys[row].as_py()
                for lo, n, anchor, context in runs(texts[row].as_py() or b"", length, gram):
                    both, known = hash((anchor, context)), False
                    if both in twice:
                        told, known = told + 1, True
                        anchor = xxhash.xxh64_intdigest(b"%d %d" % (part, told)) - (1 << 63)
                    elif both in once:
                        twice.add(both)
                    else:
                        once.add(both)
                    for c, x in zip(cols, (doc_id, key, anchor, context, lo, n, known)):
                        c.append(x)
                    if len(cols[0]) == ROWS:
                        yield told_runs(cols)
                        cols = [[], [], [], [], [], [], []]
                if len(once) > SEEN:
                    once.clear()
                    twice.clear()
            yield told_runs(cols)

    return find


SETTLED = RUNS + ", repeated boolean, differs boolean"


def _settle(batches):
    """Of rows sorted by anchor and context: those whose context is repeated, and the first of each context of an
    anchor that has several. One row and its state are carried from batch to batch."""
    names = ["doc_id", "row_key", "anchor", "context", "lo", "n", "known"]
    carried, told_repeat, told_differs, several = None, False, False, False
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        table = table if carried is None else pa.concat_tables([carried, table])
        n = table.num_rows
        anchor, context = table["anchor"].to_numpy(), table["context"].to_numpy()
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_context = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
        group = np.cumsum(new_context) - 1
        size = np.bincount(group)
        owner = np.cumsum(new_anchor) - 1
        contexts = np.bincount(owner, weights=new_context).astype(np.int64)
        if carried is not None and several:
            contexts[0] += 1
        repeated = (size[group] > 1) | table["known"].to_numpy()
        if carried is not None and told_repeat:
            repeated[group == 0] = True
        differs = new_context & (contexts[owner] > 1)
        emit_repeat, emit_differs = repeated.copy(), differs.copy()
        if carried is not None:
            emit_repeat[0] &= not told_repeat
            emit_differs[0] &= not told_differs
        kept = emit_repeat | emit_differs
        at = np.flatnonzero(kept)
        if len(at):
            out = table.take(pa.array(at)).append_column("repeated", pa.array(emit_repeat[at])).append_column("differs", pa.array(emit_differs[at]))
            yield from out.combine_chunks().to_batches()
        # the first row of the last context goes on, with what has been told of it
        first = int(np.flatnonzero(group == group[-1])[0])
        carried = table.slice(first, 1).select(names).combine_chunks()
        told_repeat, told_differs, several = bool(repeated[first]), bool(differs[first]), bool(contexts[owner[-1]] > 1)


class SuffixLevels:
    """A logarithmic family of suffix arrays over one text, the contexts end to end.

    A level is an array of the places in that text where windows start, in the order of the windows. A batch's array
    is scanned against each level's, then becomes a level; levels of equal size merge. repeats has a one for each
    place whose window starts elsewhere too.
    """

    def __init__(self, length: int):
        self.length, self.levels = length, []
        self.text, self.repeats, self.contexts = b"", bytearray(), []

    def _window(self, place: int) -> bytes:
        return self.text[place : place + self.length]

    def _sorted(self, places: list[int]) -> array:
        """The suffix array of places; neighbours that agree on the whole length repeat."""
        places.sort(key=self._window)
        before, window = -1, None
        for place in places:
            last, window = window, self._window(place)
            if window == last:
                self.repeats[before] = self.repeats[place] = 1
            before = place
        return array("i", places)

    def _scan(self, level: array, batch: array) -> None:
        """Walk along both arrays, leaping in the longer; what repeats in one of them is marked already."""
        at = 0
        for place in batch:
            window = self._window(place)
            at = bisect.bisect_left(level, window, at, key=self._window)
            if at == len(level):
                break
            if self._window(level[at]) == window:
                self.repeats[place] = self.repeats[level[at]] = 1

    def add(self, contexts: list[tuple[int, bytes, int]]) -> None:
        """A batch of (name, bytes, windows)."""
        starts = itertools.accumulate((len(data) for _, data, _ in contexts), initial=len(self.text))
        named = [(start, name, windows) for start, (name, _, windows) in zip(starts, contexts)]
        self.contexts += named
        self.text += b"".join(data for _, data, _ in contexts)
        self.repeats.extend(bytes(len(self.text) - len(self.repeats)))
        batch = self._sorted([start + i for start, _, windows in named for i in range(windows)])
        for _, level in self.levels:
            self._scan(level, batch)
        self.levels.append((1, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, array("i", heapq.merge(a, b, key=self._window))))

    def found(self):
        """(name, first window, windows) of each run of windows that start elsewhere too."""
        for start, name, windows in self.contexts:
            first = self.repeats.find(1, start, start + windows)
            while first >= 0:
                end = self.repeats.find(0, first, start + windows)
                end = start + windows if end < 0 else end
                yield name, first - start, end - first
                first = self.repeats.find(1, end, start + windows)

    @property
    def matched(self) -> set[tuple[int, int]]:
        return {(name, i) for name, first, n in self.found() for i in range(first, first + n)}


def _compare(length: int):
    """Windows that contexts of the same anchor share; of partitions sorted by anchor."""

    def settle(rows: list[tuple]):
        family = SuffixLevels(length)
        for at in range(0, len(rows), BATCH):
            family.add([(name, rows[name][5], rows[name][4]) for name in range(at, min(at + BATCH, len(rows)))])
        for name, first, n in family.found():
            doc_id, key, _, lo, _, _, repeated = rows[name]
            if not repeated:
                yield doc_id, key, lo + first, n

    def run(batches):
        group: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][2] != row[2]:
                    out += settle(group) if len(group) > 1 else ()
                    group = []
                group.append(row)
            if out:
                yield _spans(out)
                out = []
        if len(group) > 1 and (out := [*settle(group)]):
            yield _spans(out)

    return run


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "row_key", "lo", "n"])


SPAN = "doc_id long, row_key long, lo int, n int"


CONTEXT = "doc_id long, row_key long, anchor long, lo int, n int, data binary, repeated boolean"


def _contexts(length: int, hot: bool):
    """The bytes of each wanted run of a row whose anchor is a full one, or is not."""

    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary(), pa.bool_()]
    names = ["doc_id", "row_key", "anchor", "lo", "n", "data", "repeated"]

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            ids, keys, texts, lists = batch.columns
            for row in range(batch.num_rows):
                some = [w for w in lists[row].as_py() if w["hot"] == hot]
                doc_id, key, text = ids[row].as_py(), keys[row].as_py(), texts[row].as_py() if some else b""
                for w in some:
                    out.append((doc_id, key, w["anchor"], w["lo"], w["n"], text[w["lo"] : w["lo"] + w["n"] + length - 1], w["repeated"]))
                    if len(out) == ROWS:
                        yield told(out)
                        out = []
            yield told(out)

    return run


HASHED = "doc_id long, row_key long, lo int, h long, g long, repeated boolean, known boolean"


def _window_hashes(length: int):
    """Hashes of all windows of the wanted runs of full anchors; one function from texts on, as each Python step of a
    stage has workers of its own."""
    contexts = _contexts(length, True)

    def run(batches):
        # a task deals each hash twice at most: more only tell that they repeat, and go anywhere
        seen: dict[int, int] = {}
        part, told = TaskContext.get().partitionId(), 0
        for batch in contexts(batches):
            for doc_id, key, _, lo, n, data, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                h = [xxhash.xxh3_128_intdigest(data[i : i + length]) for i in range(n)]
                known = [False] * n
                for i, x in enumerate(h):
                    seen[x] = times = seen.get(x, 0) + 1
                    if times > 2:
                        told += 1
                        known[i], h[i] = True, xxhash.xxh3_128_intdigest(b"%d %d" % (part, told))
                if len(seen) > SEEN:
                    seen.clear()
                halves = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in h), dtype=np.int64).reshape(-1, 2)
                at = np.arange(lo, lo + n, dtype=np.int32)
                arrays = [pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(at), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([repeated] * n), pa.array(known)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "lo", "h", "g", "repeated", "known"])

    return run


def _again(batches):
    """Of rows sorted by hash, the places that are not known to repeat as a part of their context and whose hash comes again; one row is carried."""
    rest, told = None, False
    for batch in itertools.chain(batches, [None]):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = pa.concat_tables([rest, table]) if table is not None else rest
        if table is None or not table.num_rows:
            continue
        h, g, repeated, known = (table[c].to_numpy() for c in ("h", "g", "repeated", "known"))
        same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        again = np.concatenate([[told], same]) | np.concatenate([same, [False]]) | known
        end = len(h)
        if batch is not None:  # the last row's hash may go on
            end, told = end - 1, bool(same[-1]) if len(same) else told
            rest = table.slice(end, 1).combine_chunks()
        found = table.slice(0, end).filter(pa.array((again & ~repeated)[:end])).combine_chunks()
        one = pa.array(np.ones(found.num_rows, dtype=np.int32))
        yield from pa.table({"doc_id": found["doc_id"], "row_key": found["row_key"], "lo": found["lo"], "n": one}).to_batches()


def spans_to_cut(windows: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes that runs of windows cover."""
    spans: list[list[int]] = []
    for lo, n in sorted((w["lo"], w["n"]) for w in windows):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], lo + n - 1 + length)
        else:
            spans.append([lo, lo + n - 1 + length])
    return [(a, b) for a, b in spans]


ROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(length: int, characters: bool, passage: int):
    """Replace a row's text and windows by what is cut and what is left; other columns pass."""

    def run(batches):
        for batch in batches:
            at, names = 0, batch.schema.names
            texts, windows, shorter = (batch.column(names.index(c)) for c in ("text", "windows", "shorter"))
            while at < batch.num_rows:
                start, held, cols = at, 0, [[], [], [], [], [], []]
                while at < batch.num_rows and held < 8 << 20:
                    text = texts[at].as_py()
                    spans, parts, end = spans_to_cut(windows[at].as_py() or [], length), [], 0
                    for a, b in spans:
                        parts.append(text[end:a])
                        end = b
                    kept = b"".join([*parts, text[end:]]) if spans else text
                    if characters and spans:
                        kept = kept.decode("utf-8", "ignore").encode()
                    passages = sum(b - a for a, b in spans_to_cut(shorter[at].as_py() or [], passage))
                    row = len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest(), passages
                    for c, x in zip(cols, row):
                        c.append(x)
                    held += len(text)
                    at += 1
                kinds = [pa.int64(), pa.int64(), ROW, pa.binary(), pa.string(), pa.int64()]
                passed = [batch.column(names.index(c)).slice(start, at - start) for c in ("doc_id", "rest")]
                yield pa.RecordBatch.from_arrays([*passed, *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "rest", "n_bytes", "n_removed", "spans", "kept", "kept_sha256", "passage_bytes"])

    return run


KEY = ["doc_id", "row_key"]


def repeated_windows(base: DataFrame, length: int, gram: int, hot: int = HOT) -> DataFrame:
    """doc_id, row_key, lo, n: runs of windows of base (doc_id, row_key, text) that also start elsewhere."""
    found = base.filter(F.octet_length("text") >= length).mapInArrow(tidied(_find_runs(length, gram)), RUNS)
    settled = cut(with_partitions(found, "anchor").sortWithinPartitions("anchor", "context", "doc_id", "row_key", "lo").mapInArrow(tidied(_settle), SETTLED))
    wanted = settled.filter("differs")
    full = cut(wanted.groupBy("anchor").count().filter(F.col("count") > hot).select("anchor"))
    # an anchor that is taken for a full one by chance is only counted the other way
    wanted = hits(wanted, full, ["anchor"], full.count()).withColumnRenamed("hit", "hot")
    lists = cut(wanted.groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "lo", "n", "repeated", "hot")).alias("wanted")))
    # rows that share id and text are one here: their runs are alike
    texts = hits(base, lists, KEY, lists.count()).filter("hit").groupBy(*KEY).agg(F.first("text").alias("text"))
    wanted = texts.join(lists, KEY).select(*KEY, "text", "wanted")
    contexts = wanted.mapInArrow(tidied(_contexts(length, False)), CONTEXT)
    cool = with_partitions(contexts, "anchor").sortWithinPartitions("anchor").mapInArrow(tidied(_compare(length)), SPAN)
    windows = wanted.mapInArrow(tidied(_window_hashes(length)), HASHED)
    warm = with_partitions(windows, "h").sortWithinPartitions("h", "g").mapInArrow(tidied(_again), SPAN)
    return settled.filter("repeated").select(*KEY, "lo", "n").unionByName(cool).unionByName(warm)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, carry: list[str] | None = None, characters: bool = False, passage: int = 0, passage_gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept, kept_sha256, passage_bytes, rest: one row for each row of docs (doc_id, text).

    spans are byte positions of the input; kept is what is left, without the rest of
    characters that a cut splits if `characters`; rest is a struct of the columns to carry. With `passage`, a length
    below `length`, passage_bytes counts the bytes that strings of that length cover which also start elsewhere;
    they are found alike, but not cut.
    """
    rest = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.lit(0)
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), key.alias("row_key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), rest.alias("rest"))
    rows = base.select(*KEY, "text")
    # copies of a row name the same windows, once
    lists = lambda found, name: found.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "n")).alias(name))
    if passage:
        shorter = cut(lists(repeated_windows(rows, passage, passage_gram, hot), "shorter"))
        # what repeats a longer string repeats a shorter one
        some = hits(rows, shorter, KEY, shorter.count()).filter("hit").drop("hit")
        of_row = lists(repeated_windows(some, length, gram, hot), "windows").join(shorter, KEY, "full")
    else:
        of_row = lists(repeated_windows(rows, length, gram, hot), "windows").withColumn("shorter", F.lit(None).cast("array<struct<lo:int,n:int>>"))
    of_row = cut(of_row.select(*KEY, "windows", "shorter"))
    told = hits(base, of_row, KEY, of_row.count())
    schema = f"doc_id long, rest {base.schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string, passage_bytes long"
    done = told.filter("hit").join(of_row, KEY, "left").select("doc_id", "rest", "text", "windows", "shorter").mapInArrow(tidied(_cut(length, characters, passage)), schema)
    none = F.lit(0).cast("long")
    whole = told.filter("not hit").select("doc_id", "rest", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.col("text").alias("kept"), F.sha2("text", 256).alias("kept_sha256"), none.alias("passage_bytes"))
    return whole.unionByName(done).withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID})"))


def without_repeats(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs with repeats cut from text; a character that a cut splits goes whole; n_chars, if there, counts again."""
    names = docs.columns
    done = remove_repeats(docs, length, gram, carry=[c for c in names if c != "text"], characters=True)
    changed = {"text": F.decode("kept", "UTF-8")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.length(changed["text"])).cast("long")
    return done.select(*[(changed[c] if c in changed else F.col(f"rest.`{c}`")).alias(c) for c in names])
