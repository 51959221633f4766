"""Quality: a sparse rule ensemble (Friedman and Popescu's RuleFit) over statistics of the text.

Shallow trees are boosted on a bounded sample; the path to each of their nodes becomes a rule, a conjunction of bounds on
statistics; a lasso logistic regression keeps few of the rules. The rules and weights compile to one Spark column
expression over the statistics, so a fitted model is plain SQL. The statistics of whole texts come from byte counts.

Fitted on a bounded sample (``per_class`` rows and ``class_bytes`` bytes of each label), applied to all rows. Defined results: a null
text has the statistics of an empty one; with one label or none in the sample the score is that label's share (0.5 without rows);
rows that repeat are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .learn import ROWS_PER_CLASS, labelled_sample, remainder, sigmoid

STATISTICS = ("n_words", "word_bytes", "upper", "digit", "mark", "bang", "pipe", "symbol", "line_words", "fresh", "top_word", "repeat_next", "repeat_line", "non_ascii")
TREES, DEPTH, BINS, SHRINK, LASSO = 40, 3, 32, 0.3, 2e-3
#: The sample has long texts too, as statistics of short texts do not tell of them.
CLASS_BYTES, BLOCK_WORDS = 8 << 20, 64


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text: counts, and shares of bytes, words or lines."""
    hasher, (ws, _, _) = t.Hasher(), t.byte_classes()
    data, offsets = t.text_buffers(column)
    out = np.zeros((len(column), len(STATISTICS)))
    for i, j in t.steps(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[own])
        starts, ends, at = t.word_ranges(part, own, ws)
        words, n, row = hasher.ranges(part, starts, ends), np.diff(at), t.rows_of(at)
        some, bytes_ = np.maximum(n, 1), np.maximum(np.diff(own), 1)
        by = np.lexsort((words, row))
        new = np.concatenate([[True], (words[by][1:] != words[by][:-1]) | (row[by][1:] != row[by][:-1])])[: len(words)]
        first = np.flatnonzero(new)
        top = np.zeros(j - i)
        # distinct words by blocks: over a whole text their share would fall with its length
        block = (np.arange(len(words)) - at[row]) // BLOCK_WORDS
        parts = t.mix(words + t.mix((row << 32 | block).astype(t.U64)))
        once = np.unique(parts, return_index=True)[1]
        fresh = np.bincount(row[once], minlength=j - i)
        np.maximum.at(top, row[by][first], np.diff(np.concatenate([first, [len(words)]])))
        again = np.concatenate([words[1:] == words[:-1], [False]])[: len(words)] & np.concatenate([row[1:] == row[:-1], [False]])[: len(words)]
        l_starts, l_ends, l_at = t.word_ranges(part, own, np.arange(256) != 10)
        lines, l_row = hasher.ranges(part, l_starts, l_ends), t.rows_of(l_at)
        l_some, l_pairs = np.maximum(np.diff(l_at), 1), np.unique(np.stack([l_row.astype(t.U64), lines], 1), axis=0)
        letters = np.maximum(count(((part | 32) >= 97) & ((part | 32) <= 122)), 1)
        columns = (
            n, count(ws[part]) / some, count((part >= 65) & (part <= 90)) / letters, count((part >= 48) & (part <= 57)) / bytes_,
            count(np.isin(part, np.frombuffer(b".,;:?", np.uint8))) / some, count(part == 33) / some, count(part == 124) / some, count(np.isin(part, np.frombuffer(b"#$%&*@<>{}[]=\\^~_", np.uint8))) / some,
            n / l_some, fresh / some, top / some, np.bincount(row, again, j - i) / some,
            1 - np.bincount(l_pairs[:, 0].astype(np.int64), minlength=j - i) / l_some * (np.diff(l_at) > 0) - (np.diff(l_at) == 0), count(part >= 128) / bytes_,
        )
        out[i:j] = np.stack(columns, 1)
    return out


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, lowest value, highest value); lowest excluded, highest included."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, low, high in self.bounds:
            out &= (x[:, k] > low) & (x[:, k] <= high)
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for k, low, high in self.bounds:
            c = F.col(prefix + STATISTICS[k])
            if low > -np.inf:
                out &= c > F.lit(float(low))
            if high < np.inf:
                out &= c <= F.lit(float(high))
        return out


def _tree(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> tuple[np.ndarray, list[Rule]]:
    """One regression tree on binned statistics: its prediction, and a rule for each node but the root."""
    out, rules = np.zeros(len(x)), []

    def grow(rows: np.ndarray, bounds: dict, level: int) -> None:
        if bounds:
            rules.append(Rule(tuple((k, low, high) for k, (low, high) in sorted(bounds.items()))))
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, -1, 0)
        if level < depth and len(rows) >= 8:
            for k, edge in enumerate(edges):
                gl = np.cumsum(np.bincount(binned[rows, k], gradient[rows], len(edge) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, k], hessian[rows], len(edge) + 1))[:-1]
                n = np.cumsum(np.bincount(binned[rows, k], minlength=len(edge) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(n < 3) | (n > len(rows) - 3)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] < 0:
            out[rows] = -g / (h + 1)
            return
        _, k, b = best
        low, high = bounds.get(k, (-np.inf, np.inf))
        left = binned[rows, k] <= b
        grow(rows[left], bounds | {k: (low, edges[k][b])}, level + 1)
        grow(rows[~left], bounds | {k: (edges[k][b], high)}, level + 1)

    grow(np.arange(len(x)), {}, 0)
    return out, rules


class Model:
    def __init__(self, rules: list[Rule], weights: np.ndarray, bias: float) -> None:
        self.rules, self.weights, self.bias = rules, weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
        if len(set(y.tolist())) < 2:
            share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
            return cls([], np.zeros(0), float(np.log(share / (1 - share))))
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
        weight = 0.5 / np.bincount(y, minlength=2)[y] * len(y)
        z, rules = np.zeros(len(y)), {}
        for _ in range(trees):
            p = sigmoid(z)
            step, own = _tree(x, edges, binned, (p - y) * weight, p * (1 - p) * weight, depth)
            z += SHRINK * step
            rules |= dict.fromkeys(own)
        rules = list(rules)
        a = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
        spread = np.maximum(a.std(0), 1e-3)
        a = (a - a.mean(0)) / spread
        # proximal gradient with momentum (FISTA) on the weighted logistic loss
        rate = 4 / (np.linalg.norm(a * np.sqrt(weight[:, None] / len(y)), 2) ** 2 + 1)
        w, b, v, c, q = np.zeros(len(rules)), 0.0, np.zeros(len(rules)), 0.0, 1.0
        for _ in range(400):
            d = (sigmoid(a @ v + c) - y) * weight / len(y)
            new = v - rate * (a.T @ d)
            new, nb = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0), c - rate * d.sum()
            nq = (1 + np.sqrt(1 + 4 * q * q)) / 2
            v, c = new + (q - 1) / nq * (new - w), nb + (q - 1) / nq * (nb - b)
            w, b, q = new, nb, nq
        raw, mean = w / spread, np.stack([r.holds(x) for r in rules], 1).mean(0)
        used = np.flatnonzero(w)
        return cls([rules[k] for k in used], raw[used], float(b - (raw * mean).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(sum((w * r.holds(x) for r, w in zip(self.rules, self.weights, strict=True)), np.full(len(x), self.bias)))

    def column(self, prefix: str = "") -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights.tolist(), strict=True):
            total = total + F.when(r.column(prefix), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = ROWS_PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    rows = labelled_sample(docs, labels, label, remainder("doc_id", 4) == 2, per_class, class_bytes)
    return Model.fit(statistics(pa.array([r[1] for r in rows], pa.string())), np.array([int(r[2]) for r in rows], np.int64))


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a column for each statistic."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc_id", *STATISTICS])

    return own.mapInArrow(run, ", ".join([f"doc_id {dict(own.dtypes)['doc_id']}", *(f"{s} double" for s in STATISTICS)]))


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = with_statistics(docs).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
