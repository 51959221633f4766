"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of those of its hashed subwords (the word itself and its n-grams of 3 to 6 UTF-8 bytes, with edge
signs), a text's the mean of its words'; a linear layer and softmax follow. Every subword cell that the sample holds has a vector:
vectors start at zero and are trained with the layer by accelerated proximal steps, whose penalty on a vector's length (in units of
the cell's own noise) keeps those at zero that tell nothing. As both layers are linear, a trained model reduces to one number
for each cell, which is all that scoring needs.

Fitted on a bounded sample (``per_class`` rows and ``class_bytes`` bytes of each label), scored on all rows; the labels weigh alike in
the fit, so that a score of 0.5 is the even point between them. Defined results: with one label alone in the sample every score is that
label (0 or 1); without any labelled row nothing is known to be toxic and every score is 0; null, empty and wordless texts get the
score of an empty bag; rows that repeat are scored alike; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as t
from .learn import CLASS_BYTES, ROWS_PER_CLASS, labelled_sample, remainder, sigmoid, word_grams
from .shared import shipped

CELLS_BITS, SIZES, DIMENSIONS = 19, (3, 4, 5, 6), 4
#: Rounds over all cells, steps on the cells at work in each, and the penalty in standard errors of a cell's gradient.
ROUNDS, STEPS, PENALTY, DECAY = 16, 12, 1.8, 1e-3
#: In the last rounds no cell joins, and the penalty is this share of itself, as it also holds back those that tell something.
LAST, RELAXED = 4, 0.25


def _bags(column: pa.Array, most: int = t.CHUNK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """By step: (hashes of the distinct words, cells of their subwords, their word, the word of each place, the rows' offsets into the places)."""
    hasher, (_, alnum, _) = t.Hasher(), t.byte_classes()
    data, offsets = t.text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for i, j in t.steps(offsets, most):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, at = t.word_ranges(part, own, alnum)
        words, first, which = np.unique(hasher.ranges(part, starts, ends), return_index=True, return_inverse=True)
        grams = word_grams(hasher.table[part], starts[first], ends[first], hasher, SIZES, 1, 2)
        word = np.concatenate([np.arange(len(words)), *(w for w, _ in grams.values())])
        cells = np.concatenate([words, *(h for _, h in grams.values())])
        yield words, (cells & t.U64((1 << CELLS_BITS) - 1)).astype(np.int64), word, which, at


class _Entries:
    """A sparse matrix as (row, column, value), without an order."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> None:
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, x[self.columns] * self.values, self.shape[0])

    def back(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, y[self.rows] * self.values, self.shape[1])

    def of_columns(self, chosen: np.ndarray) -> _Entries:
        """The columns where chosen holds, numbered anew."""
        keep = chosen[self.columns]
        return _Entries(self.rows[keep], (np.cumsum(chosen) - 1)[self.columns[keep]], self.values[keep], (self.shape[0], int(chosen.sum())))


def _matrices(texts: list[str]) -> tuple[np.ndarray, _Entries, _Entries]:
    """(cells that occur, share of each word in a text, share of each cell in a word): their product is the texts' bags."""
    words, rows, places, shares, cells, owners, done, base = [], [], [], [], [], [], 0, 0
    known = np.zeros(0, t.U64)  # a word's subwords are entered with its first step
    for w, cell, word, which, at in _bags(pa.array(texts, pa.string())):
        row = t.rows_of(at)
        words.append(w)
        rows.append((row + done).astype(np.int32))
        places.append((which + base).astype(np.int32))
        shares.append((1 / np.diff(at)[row]).astype(np.float32))
        new = ~np.isin(w, known, assume_unique=True)
        known = np.concatenate([known, w[new]])
        new = new[word]
        cells.append(cell[new].astype(np.int32))
        owners.append((word[new] + base).astype(np.int32))
        done, base = done + len(at) - 1, base + len(w)
    keys, which = np.unique(np.concatenate([*words, np.zeros(0, t.U64)]), return_inverse=True)
    owner, cell = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (owners, cells))
    del words, owners, cells
    which = which.astype(np.int32)
    owner, present = which[owner], np.zeros(1 << CELLS_BITS, bool)
    present[cell] = True
    used, cell = np.flatnonzero(present).astype(np.int32), (np.cumsum(present) - 1).astype(np.int32)[cell]
    row, place, share = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (rows, places, shares))
    del rows, places, shares
    pair, inverse = np.unique(row.astype(np.int64) * max(len(keys), 1) + which[place], return_inverse=True)
    of_text = _Entries((pair // max(len(keys), 1)).astype(np.int32), (pair % max(len(keys), 1)).astype(np.int32), np.bincount(inverse, share), (done, len(keys)))
    size = np.bincount(owner, minlength=len(keys))
    return used, of_text, _Entries(owner, cell, (1 / np.maximum(size, 1))[owner], (len(keys), len(used)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, penalty: float = PENALTY) -> Model:
        """Cross-entropy with a group penalty: a round finds the cells whose vectors are or want to be off zero, and steps on these."""
        weights, n = np.zeros(1 << CELLS_BITS, np.float32), len(texts)
        if len(set(labels.tolist())) < 2:
            return cls(weights, np.inf if n and labels[0] else -np.inf)
        used, of_text, of_word = _matrices(texts)
        # a cell's noise: the spread of its share among texts if words fell by chance
        square = _Entries(of_text.rows, of_text.columns, of_text.values**2, of_text.shape).back(np.ones(n))
        noise = np.sqrt(_Entries(of_word.rows, of_word.columns, of_word.values**2, of_word.shape).back(square) / n)
        importance = (0.5 / np.bincount(labels, minlength=2))[labels]
        rng = np.random.default_rng(5)
        vectors, layer, bias = np.zeros((len(used), DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), 0.0
        limit = penalty * 0.5 / np.sqrt(n)
        logit = np.zeros(n)
        for k in range(rounds + LAST):
            if k == rounds:
                limit *= RELAXED
            along = layer[:, 1] - layer[:, 0]
            error = (sigmoid(logit + bias) - labels) * importance
            gradient = of_word.back(of_text.back(error)) / noise
            work = (np.abs(vectors).sum(1) > 0) | ((k < rounds) & (np.abs(gradient) > limit))
            if not work.any():
                break
            w = of_word.of_columns(work)
            near = np.bincount(w.rows, minlength=w.shape[0]) > 0  # words that hold any of these cells
            x = of_text.of_columns(near)
            number = np.cumsum(near) - 1
            w = _Entries(number[w.rows], w.columns, w.values / noise[work][w.columns], (int(near.sum()), w.shape[1]))
            # the greatest curvature on these cells, by power iteration
            u, curve = np.ones(w.shape[1]) / np.sqrt(w.shape[1]), 0.0
            for _ in range(8):
                bag = x.times(w.times(u))
                u = w.back(x.back((bag - bag.mean()) * importance))
                curve = float(np.linalg.norm(u)) or 1.0
                u /= curve
            now = vectors[work]
            ahead, momentum = now.copy(), 1.0
            for _ in range(steps):
                along = layer[:, 1] - layer[:, 0]
                size = float(along @ along)
                rate = 4 / (1.1 * curve * size)
                error = (sigmoid(x.times(w.times(ahead @ along)) + bias) - labels) * importance
                new = ahead - rate * w.back(x.back(error))[:, None] * along
                length = np.linalg.norm(new, axis=1, keepdims=True)
                new *= np.maximum(0, 1 - rate * limit * np.sqrt(size) / np.maximum(length, 1e-300))
                following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
                ahead, now, momentum = new + (momentum - 1) / following * (new - now), new, following
                bias -= error.sum()
            vectors[work] = now
            along = layer[:, 1] - layer[:, 0]
            logit = x.times(w.times(now @ along))
            # the layer's own step, jointly with the vectors
            error = (sigmoid(logit + bias) - labels) * importance
            bags = np.stack([x.times(w.times(now[:, d])) for d in range(DIMENSIONS)], 1)
            step = bags.T @ error / max(float((bags * bags).sum(1) @ importance), 1e-12)
            layer -= np.stack([-step, step], 1) + DECAY * layer
            logit = bags @ (layer[:, 1] - layer[:, 0])
        weights[used] = vectors @ (layer[:, 1] - layer[:, 0]) / noise
        return cls(weights, float(bias))

    def score(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for words, cell, word, which, at in _bags(column):
            mean = np.bincount(word, self.weights[cell], len(words)) / np.maximum(np.bincount(word, minlength=len(words)), 1)
            out.append(np.bincount(t.rows_of(at), mean[which], len(at) - 1) / np.maximum(np.diff(at), 1))
        return sigmoid(np.concatenate(out) + self.bias) if np.isfinite(self.bias) else np.full(len(column), float(self.bias > 0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = ROWS_PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    rows = labelled_sample(docs, labels, label, remainder("doc_id", 5) == 0, per_class, class_bytes)
    return Model.fit([r[1] for r in rows], np.array([int(r[2]) for r in rows], np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns and the score, under a name that must be free."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {name} exists")
    held = shipped(docs.sparkSession, model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(text)), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
