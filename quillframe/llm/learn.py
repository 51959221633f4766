"""Bounded samples of labelled rows, and character n-grams of words, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from .fm import interval_rows

#: Bounds of a sample: rows of each class, and bytes of all texts of a class.
ROWS_PER_CLASS, CLASS_BYTES = 1000, 3 << 20


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def _drawn(rows: DataFrame, label: str, per_class: int, seed: int, *by: str) -> DataFrame:
    """About per_class rows of each class, by a hash of the columns named (__at): the same at every run."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per_class / n))) for k, n in sorted(counts.items())]) if counts else F.lit(0.0)
    at = F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 40))
    return rows.withColumn("__at", at).where(F.col("__at") / float(1 << 40) < share).limit(2 * per_class * max(1, len(counts)))


def labelled_sample(docs: DataFrame, labels: DataFrame | None, label: str, skip: Column, per_class: int = ROWS_PER_CLASS, class_bytes: int = CLASS_BYTES, seed: int = 3) -> list[tuple]:
    """(doc_id, text, label) of a bounded sample on the driver, in a fixed order; rows where skip holds never.

    A class has at most 2 * per_class rows and class_bytes bytes: its rows are taken in the order of a hash as long as their whole texts
    fit, so that long texts are learned from in their proportion. An id that repeats with a label counts once, with its least text.
    """
    texts = docs.select("doc_id", "text", *([label] if labels is None else [])).where(F.col("text").isNotNull() & ~skip)
    if labels is None:
        rows = _drawn(texts.where(F.col(label).isNotNull()), label, per_class, seed, "doc_id", "text").dropDuplicates(["doc_id", "text", label])
    else:
        own = labels.select("doc_id", label).where(F.col(label).isNotNull() & ~skip).dropDuplicates(["doc_id", label])
        drawn = F.broadcast(_drawn(own, label, per_class, seed, "doc_id"))  # the draw bounds what is broadcast, and the groups below
        rows = texts.join(drawn, "doc_id").groupBy("doc_id", label, "__at").agg(F.min("text").alias("text"))
    before = Window.partitionBy(label).orderBy("__at", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum(F.octet_length("text")).over(before)).where(F.col("__upto") <= class_bytes)
    return sorted((r["doc_id"], r["text"], r[label]) for r in rows.select("doc_id", "text", label).toLocalIterator())


def word_grams(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: t.Hasher, sizes: tuple[int, ...], left: int, right: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each n: (word, hash) of all n-grams of the words, with an edge sign on either side; values are hashes of characters."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n + 2)])
    text = np.empty(at[-1], t.U64)
    _, inner = interval_rows(at[:-1] + 1, at[:-1] + 1 + n)
    _, source = interval_rows(starts, ends)
    text[inner] = values[source]
    text[at[:-1]], text[at[1:] - 1] = t.U64(left), t.U64(right)
    out = {}
    for size in sizes:
        word, place = interval_rows(at[:-1], np.maximum(at[:-1], at[1:] - size + 1))
        grams = hasher.grams(text, size)
        out[size] = (word, grams[place] if len(place) else np.zeros(0, t.U64))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
