"""Language identification by hyperdimensional profiles.

Each letter has a seeded random vector of DIMENSIONS signs. A trigram's vector binds (multiplies) its letters'
vectors, the first permuted (rolled) twice and the second once; a text's vector bundles (adds) the vectors of all
its trigrams, a language's prototype those of all texts it is learned from. A text gets the language whose
prototype has the largest cosine with its own vector; ties go to the smaller name.

Letters are Unicode letters, lower-cased, hashed to LETTERS; runs of anything else are one separator. Counts are
whole numbers, so sums don't depend on their order. What reaches the driver is one vector for each language.

Defined cases: null texts and texts without a letter get `und` and score 0, as do all when nothing is learned;
rows without language are not learned from; long texts are read in runs of RUN characters; a null id is held out
as the empty text's crc32 is divisible; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

DIMENSIONS = 1024
LETTERS = 191
SEED = 5
RUN = 1 << 20
#: Trigram vectors that a worker remembers.
CACHE = 1 << 14
#: Trigrams that a training task gathers before it bundles them.
FLUSH = 1 << 21
#: Distinct keys whose vectors are looked up at once.
KEYS = 1 << 10
BASE = LETTERS + 1
UNDETERMINED = "und"


def letter_codes() -> np.ndarray:
    """0 for what is no letter, else 1 to LETTERS, by code point."""
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x32400)), dtype=bool, count=0x32400)
    return np.where(alpha, 1 + np.arange(0x32400) % LETTERS, 0).astype(np.int32)


class Profiles:
    """Trigram keys of texts and the vectors of keys."""

    def __init__(self):
        self.codes = letter_codes()
        self.letters = np.where(np.random.default_rng(SEED).random((BASE, DIMENSIONS)) < 0.5, -1, 1).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.rows = np.full(BASE**3, -1, dtype=np.int32)
        self.vectors = np.empty((256, DIMENSIONS), dtype=np.float32)
        self.n = 0

    def keys(self, text: str):
        """Arrays of trigram keys; none if the text has no letter."""
        last = np.zeros(1, dtype=np.int32)
        for at in range(0, len(text), RUN):
            points = np.frombuffer(text[at : at + RUN].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            ids = self.codes[np.minimum(points, len(self.codes) - 1)]
            if at + RUN >= len(text):
                ids = np.append(ids, 0).astype(np.int32)
            ids = np.concatenate([last, ids])
            ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])]
            if len(ids) > 2:
                yield (ids[:-2] * BASE + ids[1:-1]) * BASE + ids[2:]
            last = ids[-2:]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of distinct keys, at most CACHE at once."""
        new = keys[self.rows[keys] < 0]
        if len(new):
            if self.n + len(new) > CACHE:
                self.clear()
                new = keys
            while len(self.vectors) < self.n + len(new):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            a, b, c = new // BASE**2, new // BASE % BASE, new % BASE
            self.vectors[self.n : self.n + len(new)] = np.roll(self.letters, 2, axis=1)[a] * np.roll(self.letters, 1, axis=1)[b] * self.letters[c]
            self.rows[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.vectors[self.rows[keys]]

    def bundle(self, keys: np.ndarray) -> np.ndarray:
        """The sum of all keys' vectors, exact."""
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(keys), FLUSH):  # sums of fewer than 2 ** 24 signs are exact in single precision
            distinct, counts = np.unique(keys[at : at + FLUSH], return_counts=True)
            for a in range(0, len(distinct), KEYS):
                total += counts[a : a + KEYS].astype(np.float32) @ self.of(distinct[a : a + KEYS])
        return total


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """language: its prototype; learned from all rows of docs (text, lang)."""

    def learn(batches):
        profiles, sums, held = Profiles(), {}, {}

        def flush(lang: str) -> None:
            sums[lang] = sums.get(lang, 0) + profiles.bundle(np.concatenate(held.pop(lang)))

        waiting: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.columns
            for text, lang in zip(texts, langs.to_pylist()):  # texts one by one, as a batch's are large
                for keys in profiles.keys(text.as_py()):
                    held.setdefault(lang, []).append(keys)
                    waiting[lang] = waiting.get(lang, 0) + len(keys)
                    if waiting[lang] >= FLUSH:
                        flush(lang)
                        waiting[lang] = 0
        for lang in list(held):
            flush(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(total, pa.float64())], ["lang", "at", "x"])

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    rows = known.mapInArrow(tidied(learn), "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", F.col("v.x").alias("x")).collect()
    return {r["lang"]: np.array(r["x"]) for r in sorted(rows, key=lambda r: r["lang"]) if any(r["x"])}


def _judge(learned: dict[str, np.ndarray]):
    """A function from texts to (languages, scores), to be made once a task."""
    names = sorted(learned)
    table = np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]) if names else np.zeros((0, DIMENSIONS))

    def make():
        profiles = Profiles()

        def judge(texts: pa.Array) -> tuple[list[str], list[float]]:
            langs, scores = [], []
            for text in texts:
                total, some = np.zeros(DIMENSIONS), False
                for keys in profiles.keys(text.as_py() or ""):
                    total += profiles.bundle(keys)
                    some = True
                size = np.linalg.norm(total)
                if not some or not names:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                cosines = table @ total / (size or 1.0)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            return langs, scores

        return judge

    return make


def predict(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    make = _judge(learned)

    def run(batches):
        judge = make()
        for batch in batches:
            langs, scores = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is found, with their columns as they were; nothing is shuffled.

    Those are the rows with a letter, whatever their language and score, also when nothing could be learned.
    """
    learned = prototypes(docs.filter(~held_out()).select("text", "lang"))
    make = _judge(learned)
    at = docs.columns.index("text")

    def run(batches):
        judge = make()
        for batch in batches:
            texts = batch.column(at)
            if learned:
                some = [x != UNDETERMINED for x in judge(texts)[0]]
            else:
                some = [any(c.isalpha() for c in t.as_py() or "") for t in texts]
            yield batch.filter(pa.array(some, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(doc_id="doc_id", folds: int = 5):
    """Whether a row is kept from learning: crc32 of its id as text, modulo folds, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    learned = prototypes(docs.filter(~held_out()).select("text", "lang"))
    return predict(docs, learned).withColumn("held_out", held_out())
