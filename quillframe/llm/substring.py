"""Substring dedup: matching statistics of streamed documents against an FM-index per shard.

A window is 20 consecutive words; a window that starts earlier elsewhere is a repeat, and words under a repeat go.
A corpus against every shard would cost documents times shards. So shards are cut by content: a window goes by its
anchor (the least hash among its 8-word sequences), which equal windows share; a run of windows with one anchor is a
fragment. Identical fragments are told apart by their first occurrence alone, inside a task before the shuffle and
across tasks after it. Only anchors with several different fragments need words: these meet in one shard, whose
FM-index gives by backward search, for the end of each window, the longest piece (to 20 words) that occurs at least
twice; the places of those that reach the threshold are located, and all but the first are reported.

A sequence that is frequent in the corpus (by a sketch over all documents) is taken as an anchor only where a window
holds none that is not. A window that reaches over the edge of a common passage thus has an anchor at that edge, and an
anchor within the passage has only the few fragments that the window length allows. A sequence that the sketch does not mark
has at most 4 / 2**18 of all places, which is no more than a task's share among 65,536. An anchor that still has more than
``CROWDED`` different fragments is not indexed: its windows are dealt one by one, by their own words, and the first place
of each is found by a sum that combines before it shuffles; so no index grows with the corpus.

A row is known by a 64-bit hash of its id and text: rows equal in both share their result, as neither is earlier than the other.

Defined results: null text has no words; a document of fewer than 20 words loses nothing; order is by doc_id (a null
id comes first), then by place; rows of one doc_id at the same place are not earlier than each other, and all rows without id
are one document in this; ids are integers, others are refused; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .fm import FMIndex, interval_rows
from .shared import CELLS_BITS, gram_sketch, written

WINDOW, ANCHOR = 20, 8
BLOCK_WORDS = 1 << 20
SHARD_WORDS = 1 << 20
#: Different fragments of an anchor that are still indexed together; beyond, n has this bit.
CROWDED, CROWD_BIT = 4096, 1 << 30
#: Low bits of the order key hold the place, so that ties go to the left.
_PLACE = np.uint64((1 << 28) - 1)
NO_ID = -(1 << 63)

MARKS = "key bigint, frag bigint, doc bigint, row bigint, pos int, n int"
_NAMES = ("key", "frag", "doc", "row", "pos", "n")


def _hot(counts: np.ndarray) -> np.ndarray:
    """Cells with a frequent sequence: well above what all others put into a cell."""
    return counts > max(64, 4 * int(counts.sum()) // len(counts))


def fragments(words: np.ndarray, at: np.ndarray, hot: np.ndarray, hasher: t.Hasher, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first word, windows) of the maximal runs of windows that share an anchor."""
    places = t.inside(at, window)
    if not len(places):
        return tuple(np.zeros(0, x) for x in (t.U64, t.U64, np.int64, np.int64))
    grams = hasher.grams(words, anchor)
    cell = (grams & t.U64((1 << CELLS_BITS) - 1)).astype(np.int64)
    order = (hot[cell].astype(t.U64) << t.U64(63)) | ((grams >> t.U64(1)) & ~_PLACE) | np.arange(len(grams)).astype(t.U64)
    width, span, least = window - anchor + 1, 1, order
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    chosen = (least[places] & _PLACE).astype(np.int64)
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (places[1:] != places[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(places)]]))
    starts = places[first]
    return grams[chosen[first]], hasher.spans(words, starts, starts + n + window - 1), starts, n


def _runs(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window ranges of rows, sorted and with those joined that touch."""
    by = np.lexsort((start, row))
    row, start, end = row[by], start[by], (start + n)[by]
    if not len(by):
        return row, start, end
    same = row[1:] == row[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    # the furthest end so far within a group
    far = np.maximum.accumulate(end + group * (1 << 32)) - group * (1 << 32)
    new = np.concatenate([[True], ~same | (start[1:] > far[:-1])])
    i = np.flatnonzero(new)
    return row[i], start[i], np.maximum.reduceat(end, i) - start[i]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == t.U64 else x.astype(np.int64), pa.int64()) for x in columns[:4]]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(x.astype(np.int32)) for x in columns[4:])], names=list(_NAMES))


def _first_marks(hot_raw: bytes, window: int):
    """Map side: a row for each fragment whose like no earlier place of the task's block holds; the others as ranges (n < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (ws, _, _) = t.Hasher(), t.byte_classes()
        hot = np.unpackbits(np.frombuffer(hot_raw, np.uint8)).astype(bool)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            anchor, frag, doc, row, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((row, start, doc, frag))
            anchor, frag, doc, row, start, n = (x[by] for x in (anchor, frag, doc, row, start, n))
            new = np.concatenate([[True], frag[1:] != frag[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(frag)), 0))
            later = (doc != doc[lead]) | (start != start[lead])
            # equal rows say the same
            again = np.concatenate([[False], ~new[1:] & (row[1:] == row[:-1]) & (start[1:] == start[:-1])])
            r, s, m = _runs(row[later], start[later], n[later])
            k = ~later & ~again
            spread, none = t.mix(r.view(t.U64) ^ (s.astype(t.U64) << t.U64(20))), np.zeros(len(r), np.int64)
            return _batch(np.concatenate([anchor[k], spread]), np.concatenate([frag[k], spread]), np.concatenate([doc[k], none]), np.concatenate([row[k], r]), np.concatenate([start[k], s]), np.concatenate([n[k], -m]))

        size = 0
        for b in batches:
            doc_ids, rows = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("doc", "row"))
            data, offsets = t.text_buffers(b.column("text"))
            for i, j in t.steps(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, at = t.word_ranges(part, own, ws)
                words = hasher.ranges(part, starts, ends)
                anchor, frag, start, n = fragments(words, at, hot, hasher, window)
                of = np.searchsorted(at, start, "right") - 1
                held.append((anchor, frag, doc_ids[i:j][of], rows[i:j][of], start - at[of], n))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _tell_apart(crowded: int):
    """After the shuffle by anchor, rows sorted: later places of a fragment become ranges (n < 0), and the first ones go on (n > 0)
    where an anchor has several fragments. Keeps one anchor's first places at a time, up to the number that makes a crowd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in _NAMES]  # first places of the last anchor
        crowd: int | None = None  # the anchor whose first places are no longer held

        def settle(rows: list[np.ndarray], end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, crowd
            key, frag, doc, row, pos, n = rows
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (frag[1:] != frag[:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            later = (n > 0) & ((doc != doc[lead]) | (pos != pos[lead]))
            again = np.concatenate([[False], ~new[1:] & (row[1:] == row[:-1]) & (pos[1:] == pos[:-1])]) & ~later
            settled = [x[(n < 0) | later] for x in rows]
            settled[5] = -np.abs(settled[5])
            firsts = [x[(n > 0) & ~later & ~again] for x in rows]
            k, f = firsts[0], firsts[1]
            last = (k == key[-1]) & (not end) if len(k) else np.zeros(0, bool)
            out = [settled]
            if len(k):
                head = np.concatenate([[True], k[1:] != k[:-1]])
                group = np.cumsum(head) - 1
                size = np.bincount(group)[group]
                several = np.bincount(group, np.concatenate([[False], f[1:] != f[:-1]]) & ~head)[group] > 0
                many = (size > crowded) | (k == crowd if crowd is not None else False)
                # of the last anchor, more may follow; a crowd goes on at once
                go = (~last & several) | many
                done = [x[go] for x in firsts]
                done[5] = np.where(many[go], done[5] | CROWD_BIT, done[5])
                out.append(done)
                crowd = int(k[-1]) if last[-1] and many[-1] else None
                # the last fragment stays as the measure of what follows, even when its own row has gone on
                stay = last & ~many
                held = [x[stay] for x in firsts]
                if crowd is not None:
                    lead_only = np.flatnonzero(last & (f == f[-1]))
                    held = [x[lead_only] for x in firsts]
                    held[5] = np.zeros(len(lead_only), np.int64)  # gone already
            else:
                held = [x[:0] for x in firsts]
            yield _batch(*(np.concatenate(x) for x in zip(*out, strict=True)))

        for b in batches:
            if b.num_rows:
                rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
                yield from settle(rows, False)
        if len(held[0]):
            yield from settle(held, True)

    return run


def _with_words(window: int):
    """Adds to each fragment that goes on its words' hashes; one of a crowd becomes its windows, known by a hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (ws, _, _) = t.Hasher(), t.byte_classes()
        before: int | None = None
        for b in batches:
            ids = b.column("row").to_numpy(zero_copy_only=False)
            # of equal rows, which the join's order brings together, one will do
            fresh = np.concatenate([[before is None or ids[0] != before], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
            before = int(ids[-1]) if len(ids) else before
            b = b.filter(pa.array(fresh))
            data, offsets = t.text_buffers(b.column("text"))
            marks, doc_ids, ids = b.column("marks"), b.column("doc").to_numpy(zero_copy_only=False), ids[fresh]
            for i, j in t.steps(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, at = t.word_ranges(part, own, ws)
                words = hasher.ranges(part, starts, ends)
                mine = marks.slice(i, j - i)
                of = np.repeat(np.arange(j - i), pa.compute.list_value_length(mine).to_numpy(zero_copy_only=False).astype(np.int64))
                flat = mine.flatten()
                key, pos, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("key", "pos", "n"))
                crowd = n >= CROWD_BIT
                n = np.where(crowd, n - CROWD_BIT, n)
                one, start = interval_rows(pos[crowd], (pos + n)[crowd])
                first = at[of[crowd]][one] + start
                key = np.concatenate([key[~crowd], hasher.spans(words, first, first + window).view(np.int64)])
                whose, place = np.concatenate([of[~crowd], of[crowd][one]]), np.concatenate([pos[~crowd], start])
                length = np.concatenate([n[~crowd] + window - 1, np.zeros(len(one), np.int64)])
                where = interval_rows(at[whose] + place, at[whose] + place + length)[1]
                lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]), pa.array(words[where].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc_ids[i:j][whose].astype(np.int64)), pa.array(ids[i:j][whose]), pa.array(place.astype(np.int32)), lists.cast(pa.list_(pa.int64()))], names=["key", "doc", "row", "pos", "words"])

    return run


def _search_shards(window: int, shard_words: int):
    """An FM-index over each shard's fragments; a range of windows for each that also starts earlier."""

    def search(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(w) for w in words])
        text = np.zeros(n.sum() + len(n), np.int64)
        first = np.cumsum(n + 1) - n - 1
        _, where = interval_rows(first, first + n)
        text[where] = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
        index = FMIndex(text)
        piece, starts = interval_rows(first, first + n - window + 1)
        length, lo, hi = index.matching_statistics(text, starts + window, window, 2)
        hit = length >= window
        own_lo, which = np.unique(lo[hit], return_inverse=True)
        own_hi = np.zeros(len(own_lo), np.int64)
        own_hi[which] = hi[hit]
        # of every place in the shard's text: its document's rank and its place there
        rank = np.unique(doc, return_inverse=True)[1]
        owner = np.repeat(np.arange(len(n)), n + 1)
        value = (rank.astype(np.int64)[owner] << 36) | (pos[owner] + np.arange(len(text)) - first[owner])
        _, rows = interval_rows(own_lo, own_hi)
        least = np.minimum.reduceat(value[index.locate(rows)], np.concatenate([[0], np.cumsum(own_hi - own_lo)[:-1]])) if len(rows) else np.zeros(0, np.int64)
        later = value[starts[hit]] > least[which]
        p, s = piece[hit][later], starts[hit][later]
        r, s, m = _runs(row[p], pos[p] + s - first[p], np.ones(len(p), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32))], names=["row", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places, words, size = [], [], [], 0
        for b in batches:
            column = b.column("words")
            flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])
            for i, (k, *place) in enumerate(zip(*(b.column(x).to_pylist() for x in ("key", "doc", "row", "pos")), strict=True)):
                if size >= shard_words and k != keys[-1]:
                    yield search(*np.array(places).T, words)
                    keys, places, words, size = [], [], [], 0
                keys.append(k)
                places.append(place)
                words.append(flat[at[i] : at[i + 1]])
                size += len(words[-1])
        if keys:
            yield search(*np.array(places).T, words)

    return run


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kind = dict(docs.dtypes)[doc_id]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} is {kind}: places are ordered by integer ids")
    # one and the same projection for both joins by row, so that their shuffle is made once
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row"))


def _ordered(own: DataFrame) -> DataFrame:
    return own.withColumn("doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, crowded: int = CROWDED) -> DataFrame:
    """row (a hash of id and text), pos (first window), n: ranges of windows that also start earlier."""
    own = _own(docs, doc_id, text)
    hot = np.packbits(_hot(gram_sketch(own, "text", ANCHOR, False))).tobytes()
    marks = _ordered(own).select("doc", "row", "text").mapInArrow(_first_marks(hot, window), MARKS)
    told = written(marks.repartition("key").sortWithinPartitions("key", "frag", "doc", "pos", "row").mapInArrow(_tell_apart(crowded), MARKS))
    wanted = told.where("n > 0").groupBy("row").agg(F.collect_list(F.struct("key", "pos", "n")).alias("marks"))  # no more than a document's words
    pieces = _ordered(own.join(wanted, "row")).select("doc", "row", "text", "marks").mapInArrow(_with_words(window), "key bigint, doc bigint, row bigint, pos int, words array<bigint>")
    settled = told.where("n < 0").select("row", "pos", F.expr("-n").cast("int").alias("n"))
    some = told.where(F.col("n") >= CROWD_BIT).limit(1).count()
    if some:
        pieces = written(pieces)
        alone = pieces.where(F.size("words") == 0).select("key", "doc", "row", "pos")
        least = alone.groupBy("key").agg(F.min(F.struct("doc", "pos")).alias("least"), F.count("*").alias("many")).where("many > 1").select("key", "least")
        settled = settled.unionByName(alone.join(least, "key").where(F.struct("doc", "pos") > F.col("least")).select("row", "pos", F.lit(1).alias("n")))
        pieces = pieces.where(F.size("words") > 0)
    found = pieces.repartition("key").sortWithinPartitions("key", "doc", "pos").mapInArrow(_search_shards(window, shard_words), "row bigint, pos int, n int")
    return settled.unionByName(found)


def _keep(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (ws, _, _) = t.Hasher(), t.byte_classes()
        for b in batches:
            data, offsets = t.text_buffers(b.column("text"))
            for i, j in t.steps(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, at = t.word_ranges(part, own, ws)
                mine = b.column("gone").slice(i, j - i)
                row = np.repeat(np.arange(j - i), pa.compute.list_value_length(mine).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                flat = mine.flatten()
                pos, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "n"))
                first = at[row] + pos
                delta = np.zeros(len(starts) + 1, np.int64)
                np.add.at(delta, first, 1)
                np.add.at(delta, first + n + window - 1, -1)
                kept = np.cumsum(delta[:-1]) == 0
                # the kept words' bytes and the separator behind each, as a blank
                cover = np.zeros(len(part) + 1, np.int32)
                cover[starts[kept]] += 1
                cover[ends[kept]] -= 1
                take = np.cumsum(cover[:-1]) > 0
                behind = ends[kept]
                behind = behind[behind < own[1:][t.rows_of(at)[kept]]]
                out = part.copy()
                out[behind] = 32
                take[behind] = True
                edge = np.concatenate([[0], np.cumsum(take)])[own]
                out = out[take].tobytes()
                texts = [out[x:y].removesuffix(b" ") for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                total = np.diff(at)
                left = np.diff(np.concatenate([[0], np.cumsum(kept)])[at])
                columns = [b.column("doc_id").slice(i, j - i), pa.array(total, pa.int64()), pa.array(total - left, pa.int64())]
                columns.append(pa.array([x.decode() for x in texts], pa.string()) if with_text else pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"])

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, with_text: bool = True, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by blanks (or, without text, their SHA-256)."""
    gone = repeats(docs, doc_id, text, window, shard_words, crowded).groupBy("row").agg(F.collect_list(F.struct("pos", "n")).alias("gone"))
    both = _own(docs, doc_id, text).join(gone, "row", "left").select("doc_id", "text", "gone")
    return both.mapInArrow(_keep(window, with_text), f"doc_id {dict(both.dtypes)['doc_id']}, n_words bigint, n_removed bigint, {'kept_text' if with_text else 'kept_sha256'} string")


def brute(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """What the query returns, by a dictionary of windows; for tests."""
    import re

    least, words = {}, []
    for doc, s in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (s or "").encode())
        words.append(w)
        for i in range(len(w) - window + 1):
            k, place = tuple(w[i : i + window]), (NO_ID if doc is None else doc, i)
            least[k] = min(place, least.get(k, place))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (NO_ID if doc is None else doc, i):
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def op5_query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
