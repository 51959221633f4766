"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents within one input partition. Its words become symbols of the phrases'
alphabet (a word that no phrase holds ends a piece, and pieces shorter than the shortest phrase are not
indexed, as no phrase can occur in them). Phrases are found by backward search over wavelet-tree ranks, their
occurrences are located through sampled suffix positions, and overlapping occurrences are merged to spans.
The phrases are broadcast in blocks of a checked size. One block needs one pass and no shuffle; of more blocks only one
is held at a time: each is a pass of its own, whose hits are written, and the passes' spans are merged by row.

Defined results: a null or wordless text has no hits; a phrase of fewer words than the window, but not none, is one
window as a whole; items without text or id are left out; an item id that repeats is one item; repeated documents are reported row by
row; empty tables give empty results; columns beside id and text are ignored by ``hits`` and kept by ``remove_spans``, whatever
their names. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .fm import FMIndex, interval_rows
from .shared import shipped, written

WINDOW = 10
#: Bytes of phrase text that one block may hold; more phrases take more blocks, each a pass over the shards.
BLOCK_BYTES = 4 << 20
#: Words of phrase alphabet that one shard's index holds at least before it is searched.
SHARD_WORDS = 1 << 20

SPANS = "n_words bigint, spans array<struct<first:bigint,last:bigint,first_byte:bigint,last_byte:bigint>>, item_ids array<string>"


class Phrases:
    """The distinct windows of a block of items, as rows of symbols (places in the sorted vocabulary), and the items of each."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        hasher, (_, alnum, lower) = t.Hasher(), t.byte_classes()
        data, offsets = t.text_buffers(pa.array(texts, pa.large_string()))
        starts, ends, at = t.word_ranges(lower[data], offsets, alnum)
        words = hasher.ranges(lower[data], starts, ends)
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        symbols = symbols.astype(np.int32) + 1
        self.ids = sorted(set(ids))
        item = np.searchsorted(np.array(self.ids, object), np.array(ids, object)).astype(np.int64) if ids else np.zeros(0, np.int64)
        length = np.minimum(np.diff(at), window)
        self.least = int(length[length > 0].min()) if (length > 0).any() else 0
        self.groups = []
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            which, first = interval_rows(at[own], at[own + 1] - n + 1)
            grams, place, kind = np.unique(hasher.grams(words, n)[first], return_index=True, return_inverse=True)
            patterns = symbols[first[place][:, None] + np.arange(n)]
            owner = np.unique(kind * max(len(self.ids), 1) + item[own][which])
            edge = np.searchsorted(owner, np.arange(len(grams) + 1) * max(len(self.ids), 1))
            self.groups.append((n, patterns, edge, (owner % max(len(self.ids), 1)).astype(np.int32)))


def phrase_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """Streams the items to the driver, never more than a block of them at a time."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    for row in rows.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t.encode())
        if size >= block_bytes:
            yield Phrases(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Phrases(ids, texts, window)


class _Shard:
    """Collects documents' words; ``search`` gives the hits of all of them."""

    def __init__(self, phrases: Phrases, hasher: t.Hasher) -> None:
        self.p, self.hasher = phrases, hasher
        _, self.alnum, self.lower = t.byte_classes()
        self.pieces: list[np.ndarray] = []  # symbols, 0 behind each piece
        self.places: list[np.ndarray] = []  # of a symbol: its word in the shard
        self.counts: list[np.ndarray] = []  # words of each document
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []  # bytes of each word, from its document's start
        self.words = self.indexed = 0

    def add(self, column: pa.Array) -> None:
        data, offsets = t.text_buffers(column)
        for i, j in t.steps(offsets):
            part, own = self.lower[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            starts, ends, at = t.word_ranges(part, own, self.alnum)
            self.counts.append(np.diff(at))
            row = t.rows_of(at)
            self.edges.append(((starts - own[row]).astype(np.int32), (ends - own[row]).astype(np.int32)))
            hashes = self.hasher.ranges(part, starts, ends)
            place = np.searchsorted(self.p.vocabulary, hashes)
            known = place < len(self.p.vocabulary)
            known[known] = self.p.vocabulary[place[known]] == hashes[known]
            # pieces: runs of known words within a document
            flag = np.zeros(len(known) + 1, bool)
            flag[:-1] = known
            begin = known.copy()
            begin[1:] &= ~known[:-1]
            cut = at[(at > 0) & (at < len(known))]
            begin[cut] = known[cut]
            run = np.cumsum(begin)
            length = np.bincount(run[known], minlength=run[-1] + 1 if len(run) else 1)
            keep = known & (length[run] >= self.p.least) if len(run) else known
            keep_at = np.flatnonzero(keep)
            if len(keep_at):
                run = run[keep_at]
                shift = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))  # a 0 between pieces
                text, where = np.zeros(len(run) + shift[-1] + 1, np.int32), np.zeros(len(run) + shift[-1] + 1, np.int64)
                text[np.arange(len(run)) + shift] = place[keep_at] + 1
                where[np.arange(len(run)) + shift] = keep_at + self.words
                self.pieces.append(text)
                self.places.append(where)
                self.indexed += len(text)
            self.words += len(starts)

    def search(self) -> tuple[list[int], list[list[tuple]], list[list[str]]]:
        """Of each document: its words, merged spans, and the items that occur."""
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts])
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        spans: list[list[tuple]] = [[] for _ in counts]
        items: list[set[str]] = [set() for _ in counts]
        if self.indexed:
            places, index, delta = np.concatenate(self.places), FMIndex(np.concatenate(self.pieces)), np.zeros(self.words + 1, np.int32)
            for n, patterns, edge, owners in self.p.groups:
                lo, hi = index.search(patterns.astype(np.int64))
                which, rows = interval_rows(lo, hi)
                word = places[index.locate(rows)]
                np.add.at(delta, word, 1)
                np.add.at(delta, word + n, -1)
                doc = np.searchsorted(at, word, "right") - 1
                pair = np.unique(doc * len(patterns) + which)
                kind = pair % len(patterns)
                of, place = interval_rows(edge[kind], edge[kind + 1])
                named = np.unique((pair // len(patterns))[of] * len(self.p.ids) + owners[place])
                for d, i in zip((named // len(self.p.ids)).tolist(), (named % len(self.p.ids)).tolist(), strict=True):
                    items[d].add(self.p.ids[i])
            hit = np.concatenate([[False], np.cumsum(delta[:-1]) > 0, [False]])
            first_byte, last_byte = (np.concatenate(x) for x in zip(*self.edges, strict=True))
            begin = np.flatnonzero(hit[1:-1] & ~hit[:-2])
            end = np.flatnonzero(hit[1:-1] & ~hit[2:]) + 1
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):  # spans of neighbours in the shard part at the documents' ends
                d = int(np.searchsorted(at, a, "right")) - 1
                while a < b:
                    c = min(b, int(at[d + 1]))
                    if a < c:
                        spans[d].append((a - int(at[d]), c - int(at[d]), int(first_byte[a]), int(last_byte[c - 1])))
                    a, d = c, d + 1
        return counts.tolist(), spans, [sorted(x) for x in items]


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases, text: str, shard_words: int) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    """Each batch with its documents' words, spans and items."""
    hasher = t.Hasher()
    held, shard, size = [], _Shard(phrases, hasher), 0
    for b in batches:
        shard.add(b.column(text))
        held.append(b)
        size += b.nbytes
        if shard.indexed >= shard_words or shard.words >= 4 * shard_words or size >= 32 << 20:
            yield from _flush(held, shard)
            held, shard, size = [], _Shard(phrases, hasher), 0
    if held:
        yield from _flush(held, shard)


def _flush(held: list[pa.RecordBatch], shard: _Shard) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    (n, spans, items), i = shard.search(), 0
    for b in held:
        j = i + b.num_rows
        yield b, n[i:j], spans[i:j], items[i:j]
        i = j


def _merged(spans: list[tuple]) -> list[tuple]:
    """Spans in order, those joined that touch."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


_SPAN = ("first", "last", "first_byte", "last_byte")
_FOUND = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(x, pa.int64()) for x in _SPAN]))), ("item_ids", pa.list_(pa.string()))]


def _arrays(n: list, spans: list, ids: list) -> list[pa.Array]:
    structs = [[dict(zip(_SPAN, s, strict=True)) for s in x] for x in spans]
    return [pa.array(x, kind) for x, (_, kind) in zip((n, structs, ids), _FOUND, strict=True)]


def _pass(rows: DataFrame, held: Callable[[], object], shard_words: int, hits_only: bool) -> DataFrame:
    """key, n_words, spans, item_ids of rows (key, text) under one block of phrases."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, n, spans, ids in _shards(batches, held(), "text", shard_words):
            out = pa.RecordBatch.from_arrays([b.column("key"), *_arrays(n, spans, ids)], names=["key", *(k for k, _ in _FOUND)])
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

    return rows.mapInArrow(search, f"key {dict(rows.dtypes)['key']}, {SPANS}")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [_merged([tuple(s[k] for k in _SPAN) for part in x for s in part]) for x in b.column("spans").to_pylist()]
        items = [sorted({i for part in x for i in part}) for x in b.column("item_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), *_arrays(b.column("n_words").to_pylist(), spans, items)], names=["key", *(k for k, _ in _FOUND)])


def _text_key(text: str) -> Column:
    """Rows of one text have the same hits: what the passes are merged by."""
    return F.struct(F.xxhash64(text), F.crc32(F.col(text).cast("binary")), F.octet_length(text))


def _passes(docs: DataFrame, blocks: Iterator[Phrases], text: str, shard_words: int) -> DataFrame:
    """key, n_words, spans, item_ids of the texts that any block hits: a pass for each, which holds no other block."""
    rows, tables = docs.where(F.col(text).isNotNull()).select(_text_key(text).alias("key"), F.col(text).alias("text")), []
    for block in blocks:
        held = shipped(docs.sparkSession, block)
        tables.append(written(_pass(rows, held, shard_words, True).dropDuplicates(["key"])))
        held.held.destroy()
    found = reduce(DataFrame.unionByName, tables).groupBy("key").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("item_ids").alias("item_ids"))  # a row for each block at most
    return written(found.mapInArrow(_merge, f"key {dict(found.dtypes)['key']}, {SPANS}"))


def _first_two(blocks: Iterator[Phrases], window: int) -> tuple[Phrases, Iterator[Phrases] | None]:
    """The one block, or the first and an iterator over all."""
    first = next(blocks, None) or Phrases([], [], window)
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged runs of hit words, with their bytes) and item_ids (sorted) of every document."""
    own = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    one, every = _first_two(phrase_blocks(items, item_id, item_text, window, block_bytes), window)
    if every is None:
        return _pass(own, shipped(docs.sparkSession, one), shard_words, False).withColumnRenamed("key", "doc_id")
    found = _passes(own, every, "text", shard_words).withColumnRenamed("n_words", "n")
    counted = _pass(own.withColumn("key", F.struct(F.col("key").alias("doc_id"), _text_key("text").alias("key"))), shipped(docs.sparkSession, Phrases([], [], window)), shard_words, False)
    out = counted.select("key.*", "n_words").join(found, "key", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(dict(found.dtypes)[c]))
    return out.select("doc_id", "n_words", empty("spans").alias("spans"), empty("item_ids").alias("item_ids"))


def _cut(texts: pa.Array, n: list, spans: list) -> tuple[dict[int, str], np.ndarray]:
    """The new text of each row with spans, and which rows stay."""
    new, stays = {}, np.ones(len(texts), bool)
    for k, s in enumerate(spans):
        if s:
            raw, parts, at = texts[k].as_py().encode(), [], 0
            for _, _, first, last in s:
                parts.append(raw[at:first])
                at = last
            new[k] = b"\n".join([*parts, raw[at:]]).decode()
            stays[k] = sum(x[1] - x[0] for x in s) < n[k]
    return new, stays


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", length: str | None = "n_chars", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the hit spans, all columns kept; a document that is nothing but hits goes.

    A removed span leaves one line break, so that its neighbours don't run together."""
    one, every = _first_two(phrase_blocks(items, window=window, block_bytes=block_bytes), window)
    names = docs.columns
    place, at_length = names.index(text), names.index(length) if length in names else None

    def with_new(b: pa.RecordBatch, columns: list[pa.Array], n: list, spans: list) -> pa.RecordBatch:
        new, stays = _cut(columns[place], n, spans)
        if new:
            columns = list(columns)
            columns[place] = pa.array([new.get(k, x) for k, x in enumerate(columns[place].to_pylist())], columns[place].type)
            if at_length is not None:
                columns[at_length] = pa.array([len(new[k]) if k in new else x for k, x in enumerate(columns[at_length].to_pylist())], columns[at_length].type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    if every is None:
        held = shipped(docs.sparkSession, one)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, n, spans, _ in _shards(batches, held(), text, shard_words):
                yield with_new(b, b.columns, n, spans)

        return docs.mapInArrow(cut, docs.schema)

    def cut_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, spans = b.column("row"), [[tuple(s[k] for k in _SPAN) for s in x or ()] for x in b.column("spans").to_pylist()]
            yield with_new(b, row.flatten(), b.column("n_words").to_pylist(), spans)

    found = _passes(docs, every, text, shard_words).drop("item_ids")
    both = docs.select(_text_key(text).alias("key"), F.struct(*names).alias("row")).join(found, "key", "left")
    return both.select("row", "n_words", "spans").mapInArrow(cut_found, docs.schema)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """What the query returns, word by word; for tests."""
    import re

    split = lambda s: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (s or "").encode()))
    windows = {}
    for item, s in items:
        if item is not None and (w := split(s)):
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths, out = {len(w) for w in windows}, []
    for doc, s in docs:
        w, hit, found = split(s), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def op8_query(spark, sf_dir: str) -> DataFrame:
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), digest(F.col("item_ids")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
