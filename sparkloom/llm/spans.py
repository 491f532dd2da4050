"""Substring dedup by sliding sentence spans.

A text is read as sentences: pieces that end at `.`, `!` or `?` before white space, or at a line break. Only a
sentence of more than LONG words is cut further, after each word whose hash is the least of some CUT words of it in a
row (the last of equal ones), so that a shared passage without marks is cut alike whatever stands before or after it.
A span is a run of consecutive sentences, SPAN of them and as many more as it takes to hold WORDS words; the span that
starts at each sentence is hashed (96 bits). Spans of all documents are dealt by hash and sorted by id and place; every
span but the first of its hash is repeated, and the sentences it covers are removed. White space between words doesn't
count for equality, but for line breaks, which end sentences.

Only hashes are dealt for that, and a task that meets a very frequent span streams over its rows; of texts only those
that lose something are shuffled. Defined cases: a null text is empty and stays; rows that share an id are rows of
their own, and of rows that share both id and text one, whichever, counts as the first, and is read once for all; a
text with fewer than WORDS words or SPAN sentences loses nothing, be it a copy or not; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hits, tidied, with_partitions

SPAN = 3
WORDS = 20
CUT = 12
#: Words of the longest sentence that is never cut.
LONG = 16
#: Words whose rank a worker remembers.
CACHE = 300_000
NO_ID = -(1 << 63) + 1
PLACED = "doc_id long, row_key long, at int, n int, h long, g int, known boolean"
#: Spans whose least place a task remembers.
SEEN = 100_000
RESULT = "doc_id long, n_removed int, removed_bytes long, text string, times long"
_space = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _rank(word: bytes) -> int:
    """0 for a word that ends a sentence, else 32 bits of its hash."""
    return 0 if word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?") else xxhash.xxh64_intdigest(word) >> 32 | 1


def sentences(text: bytes, cache: dict[bytes, int]) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence, as bytes positions."""
    words = text.split()
    if not words:
        return []
    ranks = list(map(cache.get, words))
    if None in ranks:
        if len(cache) >= CACHE:
            cache.clear()
        for i, r in enumerate(ranks):
            if r is None:
                ranks[i] = cache[words[i]] = _rank(words[i])
    points = np.frombuffer(text, dtype=np.uint8)
    gap = np.concatenate([[True], _space[points], [True]])
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turns[::2], turns[1::2]
    rank = np.array(ranks, dtype=np.uint64)
    lines = np.flatnonzero((points == 10) | (points == 13))
    rank[:-1][np.searchsorted(lines, starts[1:]) > np.searchsorted(lines, ends[:-1])] = 0
    last = rank == 0
    last[-1] = True
    ends_at = np.flatnonzero(last)
    long = np.diff(ends_at, prepend=-1) > LONG
    if long.any():
        # the least of each CUT words, with the place in the lower bits, backwards
        least, size = rank << np.uint64(32) | np.arange((1 << 32) - 1, (1 << 32) - 1 - len(words), -1, dtype=np.uint64), 1
        while size < CUT:
            step = min(size, CUT - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        found = (1 << 32) - 1 - (least & np.uint64((1 << 32) - 1)).astype(np.int64)
        last[found[long[np.searchsorted(ends_at, found)]]] = True
    to = np.flatnonzero(last) + 1
    at = np.concatenate([[0], to[:-1]])
    return [(s, e, words[a:b]) for s, e, a, b in zip(starts[at].tolist(), ends[to - 1].tolist(), at.tolist(), to.tolist())]


def span_ends(counts: list[int], span: int, least: int):
    """Where the span that starts at each sentence ends; counts are the sentences' words."""
    last, held = 0, 0
    for i, n in enumerate(counts):
        while last < len(counts) and (held < least or last - i < span):
            held += counts[last]
            last += 1
        if held < least or last - i < span:
            return
        yield last
        held -= n


def _hashed(span: int, least: int):
    def run(batches):
        cache: dict[bytes, int] = {}
        # a span that comes after another of its hash in the task is not the first, and goes anywhere
        least_place: dict[int, tuple[int, int, int]] = {}
        part, told = TaskContext.get().partitionId(), 0
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = sentences(text, cache)
                joined = [b" ".join(p[2]) for p in parts]
                for i, last in enumerate(span_ends([len(p[2]) for p in parts], span, least)):
                    digest = xxhash.xxh3_128_intdigest(b" ".join(joined[i:last]))
                    place = doc_id, key, i
                    known = (before := least_place.get(digest)) is not None and before < place
                    if known:
                        told += 1
                        digest = xxhash.xxh3_128_intdigest(b"%d %d" % (part, told))
                    else:
                        least_place[digest] = place
                    for c, x in zip(cols, (doc_id, key, i, last - i, (digest & (1 << 64) - 1) - (1 << 63), (digest >> 96) - (1 << 31), known)):
                        c.append(x)
                if len(least_place) > SEEN:
                    least_place.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "row_key", "at", "n", "h", "g", "known"])

    return run


def _repeated(batches):
    """Of rows sorted by hash and place, all but those at the first place of each hash."""
    last, first = None, (0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, *place = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("h", "g", "doc_id", "row_key", "at"))
        new = np.concatenate([[last != (h[0], g[0])], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        # where each row's hash begins; 0 is the place that came with the batches before
        begins = np.maximum.accumulate(np.where(new, np.arange(1, len(h) + 1), 0))
        starts = [np.concatenate([[f], p])[begins] for f, p in zip(first, place)]
        apart = np.logical_or.reduce([p != s for p, s in zip(place, starts)])
        last, first = (h[-1], g[-1]), tuple(s[-1] for s in starts)
        known = batch.column(batch.schema.get_field_index("known")).to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(apart | known))


def _rest(span: int, least: int):
    """What is left of a row, and of its copies, which are repeated in whole."""

    def run(batches):
        cache: dict[bytes, int] = {}
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, copies, found in zip(*(c.to_pylist() for c in batch.columns)):
                parts = sentences(text, cache) if found or copies > 1 else []
                gone = np.zeros(len(parts), dtype=bool)
                for f in found or []:
                    gone[f["at"] : f["at"] + f["n"]] = True
                all_gone = gone.copy()
                for i, last in enumerate(span_ends([len(p[2]) for p in parts], span, least) if copies > 1 else ()):
                    all_gone[i:last] = True
                for which, times in ((gone, 1), (all_gone, copies - 1)):
                    if not times:
                        continue
                    kept, at = [], 0
                    for i in np.flatnonzero(which):
                        kept.append(text[at : parts[i][0]])
                        at = parts[i][1]
                    rest = b"".join([*kept, text[at:]])
                    rows.append((doc_id, int(which.sum()), len(text) - len(rest), rest.decode("utf-8", "replace"), times))
                    held += len(rest)
                if held > 8 << 20:
                    yield _results(rows)
                    rows, held = [], 0
            if rows:
                yield _results(rows)

    return run


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_removed", "removed_bytes", "text", "times"])


def remove_repeated_spans(docs: DataFrame, span: int = SPAN, words: int = WORDS) -> DataFrame:
    """doc_id, n_removed (sentences), removed_bytes, text (what is left): one row for each row of docs (doc_id, text)."""
    key = ["doc_id", "row_key"]
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    spans = base.mapInArrow(tidied(_hashed(span, words)), PLACED)
    spans = with_partitions(spans, "h").sortWithinPartitions("h", "g", "doc_id", "row_key", "at")
    found = spans.mapInArrow(tidied(_repeated), PLACED).groupBy(*key).agg(F.collect_set(F.struct("at", "n")).alias("found"))
    twice = base.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")
    wanted = cut(found.join(twice, key, "full").select(*key, "found"))
    rows = hits(base, wanted, key, wanted.count())
    some = rows.filter("hit").groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    rest = some.join(wanted, key, "left").select("doc_id", "text", "copies", "found").mapInArrow(tidied(_rest(span, words)), RESULT)
    rest = rest.withColumn("turn", F.explode(F.sequence(F.lit(1), "times"))).drop("turn", "times")
    whole = rows.filter("not hit").select("doc_id", F.lit(0).alias("n_removed"), F.lit(0).cast("long").alias("removed_bytes"), F.col("text").cast("string").alias("text"))
    return whole.unionByName(rest).withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID})"))
