"""Language ID, word first: known words score by their log frequency in each language; an unseen word falls back to its
character n-grams, from the longest length of which any is known down to single characters.

Words are runs of letters, lower-cased. A text's languages get the sum over its words, turned into probabilities; the best
one is returned, with its probability (ties: the first in alphabetical order).

Fitted on a bounded sample of rows with a language (``per_class`` rows and ``class_bytes`` bytes of each), whose words and n-grams all
are in the tables; applied to all whole texts. Defined results: ``und`` and score 0 where the text is null or has no letter, or no
language was learned; rows that repeat are treated alike; a text's score does not depend on its neighbours; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .learn import labelled_sample, remainder, word_grams
from .shared import shipped

SIZES = (1, 2, 3, 4, 5)
#: Bounds of the sample, and bytes of text that a step of the fit works on.
ROWS_PER_CLASS, CLASS_BYTES, FIT_BYTES = 500, 1 << 20, 1 << 18
UNDETERMINED = "und"


def letters() -> np.ndarray:
    """A bit for each code point."""
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def _words(column: pa.Array, letter: np.ndarray, hasher: t.Hasher, most: int = t.CHUNK_BYTES) -> Iterator[tuple]:
    """By step: (hashes of characters, starts and ends of the words, the rows' offsets into the words)."""
    data, offsets = t.text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for i, j in t.steps(offsets, most):
        part = data[offsets[i] : offsets[j]]
        points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        own = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets[i : j + 1] - offsets[i]]
        flag = letter[points]
        # the word splitter works on bytes with a table of bytes: here a letter is 1 and all else 0
        starts, ends, at = t.word_ranges(flag.view(np.uint8), own, np.arange(256) == 1)
        yield t.mix(points.astype(t.U64) + t.U64(97)), starts, ends, at


class Model:
    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]], letter: np.ndarray) -> None:
        """tables: for each n-gram length, and 0 for words, the sorted hashes and a row of log frequencies for each."""
        self.languages, self.tables, self.packed = languages, tables, letter

    @classmethod
    def fit(cls, texts: list[str], languages: list[str]) -> Model:
        names, label = np.unique(np.array(languages, dtype=object).astype(str), return_inverse=True) if languages else (np.array([], str), np.zeros(0, np.int64))
        packed, hasher = letters(), t.Hasher()
        letter = np.unpackbits(packed).astype(bool)
        counted: dict[int, tuple[np.ndarray, np.ndarray]] = {n: (np.zeros(0, t.U64), np.zeros((0, len(names)))) for n in (0, *SIZES)}

        def add(n: int, hashes: np.ndarray, row: np.ndarray) -> None:
            old, counts = counted[n]
            keys, which = np.unique(np.concatenate([old, hashes]), return_inverse=True)
            own = which[len(old) :]
            total = np.bincount(own * len(names) + row, minlength=len(keys) * len(names)).reshape(len(keys), len(names)).astype(np.float64)
            total[which[: len(old)]] += counts
            counted[n] = keys, total

        done = 0
        for values, starts, ends, at in _words(pa.array(texts, pa.string()), letter, hasher, FIT_BYTES):
            row = label[t.rows_of(at) + done]
            add(0, hasher.spans(values, starts, ends), row)
            for n, (word, grams) in word_grams(values, starts, ends, hasher, SIZES, 1, 2).items():
                add(n, grams, row[word])
            done += len(at) - 1
        tables = {}
        for n, (keys, counts) in counted.items():
            tables[n] = (keys, np.log((counts + 0.1) / (counts.sum(0) + 0.1 * len(keys))).astype(np.float32))
        return cls(names.tolist(), tables, packed)

    def _look_up(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, rows = self.tables[n]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros((len(hashes), len(self.languages)), np.float32)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, rows[at]

    def word_scores(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: t.Hasher) -> np.ndarray:
        known, score = self._look_up(0, hasher.spans(values, starts, ends))
        score[~known] = 0
        left = np.flatnonzero(~known)
        grams = word_grams(values, starts[left], ends[left], hasher, SIZES, 1, 2)
        open_ = np.ones(len(left), bool)
        for n in reversed(SIZES):
            word, hashes = grams[n]
            use = open_[word]
            word, hashes = word[use], hashes[use]
            ok, rows = self._look_up(n, hashes)
            count = np.bincount(word[ok], minlength=len(left))
            for k in range(len(self.languages)):
                score[left, k] += np.bincount(word[ok], rows[ok, k], len(left)) / np.maximum(count, 1)
            open_ &= count == 0
        return score

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        hasher, letter = t.Hasher(), np.unpackbits(self.packed).astype(bool)
        names, scores = [], []
        for values, starts, ends, at in _words(column, letter, hasher):
            n = len(at) - 1
            if not len(starts) or not self.languages:
                names += [UNDETERMINED] * n
                scores.append(np.zeros(n))
                continue
            _, first, which = np.unique(hasher.spans(values, starts, ends), return_index=True, return_inverse=True)
            word = self.word_scores(values, starts[first], ends[first], hasher).astype(np.float64)
            row = t.rows_of(at)
            total = np.stack([np.bincount(row, word[which, k], n) for k in range(word.shape[1])], 1)
            best = total.argmax(1)
            probability = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            some = np.diff(at) > 0
            names += [self.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, probability, 0.0))
        return names, np.concatenate([*scores, np.zeros(0)])


def train(docs: DataFrame, per_class: int = ROWS_PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    rows = labelled_sample(docs, None, "lang", remainder("doc_id", 5) == 0, per_class, class_bytes)
    return Model.fit([r[1] for r in rows], [r[2] for r in rows])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = shipped(docs.sparkSession, model)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for b in batches:
            names, scores = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, lang_pred string, score double")


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
