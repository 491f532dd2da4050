"""Toxicity by classifier chains.

Categories are predicted one after another: each is a logistic model on a text's words and on the probabilities
of the categories before it. For training, those probabilities are out-of-fold predictions, so a later model sees
earlier ones as unsure as they are on new texts; the models used for prediction are fitted on the whole sample.

Words are lower-cased (A-Z) and stripped of marks at their ends; each, and its first PREFIX characters, is hashed
to FEATURES columns and counts once a text. The models are fitted on the driver
on at most SAMPLE labelled rows, those of least hash of the id; prediction covers whole texts of all rows. The
only thing sent to executors is one weight for each column and category.

Defined cases: a null text has no words; rows whose label is null are left out of that category's model only; a
category without both values in the sample predicts its share; rows that share an id are rows of their own; without
labels every probability is 0; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied

FEATURES = 1 << 18
SAMPLE = 8000
FOLDS = 4
STEPS = 60
PREFIX = 4
PENALTY = 1.0
#: Texts of the sample that a column must occur in.
FREQUENT = 8
#: Words whose column a worker remembers.
CACHE = 300_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_EDGES = b".,;:!?\"'()[]"


def columns(text: bytes | None, cache: dict[bytes, tuple[int, int]]) -> list[int]:
    """The columns of a text's distinct words and their beginnings."""
    words = set((text or b"").translate(LOWER).split())
    if len(cache) + len(words) > CACHE:
        cache.clear()
    out = set()
    for w in words:
        c = cache.get(w)
        if c is None:
            bare = w.strip(_EDGES)
            head = bare.decode("utf-8", "replace")[:PREFIX].encode()
            c = cache[w] = xxhash.xxh64_intdigest(bare) % FEATURES, xxhash.xxh64_intdigest(head, PREFIX) % FEATURES
        out.update(c)
    return sorted(out)


class Rows:
    """A sparse 0/1 matrix with a few dense columns behind it."""

    def __init__(self, features: list[np.ndarray], dense: np.ndarray):
        self.n, self.dense = len(features), dense
        self.row = np.repeat(np.arange(len(features)), [len(f) for f in features])
        flat = np.concatenate(features) if features else np.zeros(0, dtype=np.int64)
        frequent = np.flatnonzero(np.bincount(flat, minlength=FEATURES) >= FREQUENT)
        kept = np.isin(flat, frequent)
        self.row, self.used, self.col = self.row[kept], frequent, np.searchsorted(frequent, flat[kept])

    def times(self, w: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + self.dense @ d


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(features: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights by column, weights of the dense columns, bias) of a penalised logistic model, by Adam."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return np.zeros(FEATURES, dtype=np.float32), np.zeros(dense.shape[1]), float(np.log(share / (1 - share)))
    x = Rows(features, dense)
    k, m = len(x.used), dense.shape[1]
    # columns weigh as much as their odds tell the classes apart
    with_it, of_it = np.bincount(x.col, weights=y[x.row], minlength=k), np.bincount(x.col, minlength=k)
    scale = np.log((with_it + 1) / (y.sum() + 2)) - np.log((of_it - with_it + 1) / ((1 - y).sum() + 2))
    theta = np.zeros(k + m + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        off = sigmoid(x.times(theta[:k] * scale, theta[k : k + m]) + theta[-1]) - y
        g = np.concatenate([np.bincount(x.col, weights=off[x.row], minlength=k) * scale, dense.T @ off, [off.sum()]])
        g[:-1] += PENALTY * theta[:-1]
        g /= len(y)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(FEATURES, dtype=np.float32)
    weights[x.used] = theta[:k] * scale
    return weights, theta[k : k + m], float(theta[-1])


def score(model, features: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    weights, d, bias = model
    return sigmoid(np.array([weights[f].sum(dtype=np.float64) for f in features]) + dense @ d + bias)


def fit_chain(features: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[tuple]:
    """One model for each column of labels (NaN: unknown), each fed with the out-of-fold probabilities before it."""
    dense, models = np.zeros((len(features), 0)), []
    fold = np.arange(len(features)) % folds
    for c in range(labels.shape[1]):
        known = ~np.isnan(labels[:, c])
        some = lambda keep: ([features[i] for i in np.flatnonzero(keep)], dense[keep])
        models.append(fit(*some(known), labels[known, c]))
        guessed = np.zeros(len(features))
        if c + 1 < labels.shape[1]:
            for f in range(folds):
                inside = known & (fold != f)
                guessed[fold == f] = score(fit(*some(inside), labels[inside, c]), *some(fold == f))
        dense = np.column_stack([dense, guessed])
    return models


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> list[tuple]:
    """Fit a chain on at most `sample` labelled rows of docs (doc_id, text) and labels (doc_id, ...)."""
    chosen = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(categories.values())])
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).drop("doc_id")

    def read(batches):
        cache: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            found = [columns(t, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names[1:], "features"])

    n = len(categories)
    got = rows.mapInArrow(tidied(read), "id long, " + ", ".join(f"c{i} double" for i in range(n)) + ", features array<int>").toPandas().sort_values("id", kind="stable")
    features = [np.asarray(f, dtype=np.int64) for f in got["features"]]
    return fit_chain(features, got[[f"c{i}" for i in range(n)]].to_numpy(dtype=np.float64).reshape(-1, n)) if len(got) else []


def predict(docs: DataFrame, models: list[tuple], names: list[str]) -> DataFrame:
    """doc_id and a probability for each category, for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        cache: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            features = [np.array(columns(t, cache), dtype=np.int64) for t in batch.column(1).to_pylist()]
            dense = np.zeros((len(features), 0))
            for c in range(len(names)):
                p = score(sent.value[c], features, dense) if sent.value else np.zeros(len(features))
                dense = np.column_stack([dense, p])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(dense[:, c]) for c in range(len(names)))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, " + ", ".join(f"`{n}` double" for n in names))
