"""N-gram Jaccard join with set-relation skipping.

Documents are sets of 5-word shingles; two link where 100 * intersection >= 80 * union. Sets that are equal are one
entity from the start. Shingles are ordered by how frequent they are (levels of a sketch over all documents), then by hash; linked
sets share a shingle among their first fifth (Xiao et al., PPJoin), and the shorter set one among its first ninth. Inverted lists
hold these shingles with set size and position, in order of size and in blocks of ``BLOCK`` rows.

Skipping by position: a set meets only the blocks, and in them only the sizes, that can link; positions and a parity bitmap (a
lower bound of the symmetric difference) rule out most of the rest before any set is fetched.
Skipping by set relation: first every set of a block is held against one partner in question only, another one in each list. The
verified links make components, and sets of one component need not meet again. What is left of a list are the sets outside its
main component, which meet the blocks of all others. Such a pair's answer is derived from that of the components' roots where it can be: from the
roots' intersection, computed once, and how far each set is from its own root, follow an upper and a lower bound of the
pair's intersection; only pairs between the bounds are compared as whole sets. Links are exact; only components are computed, so links
within a component are neither listed nor counted.

No list is held whole: a task sees a block, or a pair of blocks. A shingle that the sketch does not lift above the others is in at most
2 / 2**18 of all places, so that its list is no more than a task's share among many tasks.

Defined results: null and wordless texts are empty sets, linked with nothing; fewer than five words are one shingle; a row
without id has itself as no component (null); ids of any type with an order are kept as they are; rows that repeat are equal
sets; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from .components import components
from .shared import CELLS_BITS, gram_sketch, written

SHINGLE, PERCENT = 5, 80
#: Rows of an inverted list that are looked at together, and pairs that a worker looks at in one step.
BLOCK, STEP_PAIRS = 1024, 1 << 17
#: Bits of a set's bitmap at most: it goes with each of its rows in the lists.
MOST_BITS = 8192
LISTS = "token bigint, block int, sid bigint, n int, pos int"


def shingle_sets(column: pa.Array, hasher: t.Hasher) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    ws, _, lower = t.byte_classes()
    data, offsets = t.text_buffers(column)
    for i, j in t.steps(offsets):
        part, own = lower[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, at = t.word_ranges(part, own, ws)
        words = hasher.ranges(part, starts, ends)
        grams = hasher.grams(words, SHINGLE)
        for k in range(j - i):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield hasher.spans(words[a:b], np.array([0]), np.array([b - a]))
            else:
                yield np.zeros(0, t.U64)


def set_id(s: np.ndarray) -> int:
    """63 bits of a hash of the set."""
    with np.errstate(over="ignore"):
        return int(t.mix(np.array([t.mix(s).sum(dtype=t.U64) ^ t.U64(len(s)), np.bitwise_xor.reduce(t.mix(s ^ t.U64(0x5BD1E995)))]).astype(t.U64))[:].sum(dtype=t.U64) >> t.U64(1))


def parity(s: np.ndarray) -> bytes:
    """A bitmap of two bits a shingle or more, a power of two to MOST_BITS; two bitmaps differ in no more bits than their sets in members."""
    size = min(MOST_BITS, max(256, 1 << int(2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s >> t.U64(24)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def _needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least intersection of sets of these sizes that link."""
    return -((-PERCENT * (x + y)) // (100 + PERCENT))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = t.Hasher()
    for b in batches:
        sid, n, bits = [], [], []
        for s in shingle_sets(b.column("text"), hasher):  # a batch's sets are not held together
            sid.append(set_id(s) if len(s) else None)
            n.append(len(s))
            bits.append(parity(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("row"), pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["doc", "row", "sid", "n", "bits"])


def _prefixes(levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, low = t.Hasher(), t.U64((1 << CELLS_BITS) - 1)
        seen: set[int] = set()  # equal sets of a batch of work count once
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, sid, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(sid), pa.array(n), pa.array(pos)], names=["token", "sid", "n", "pos"])

        for b in batches:
            for s in shingle_sets(b.column("text"), hasher):
                if len(s) and (sid := set_id(s)) not in seen:
                    seen.add(sid)
                    n = len(s)
                    p = n + (-PERCENT * n) // 100 + 1
                    order = (levels[(s & low).astype(np.int64)].astype(t.U64) << t.U64(59)) | (s >> t.U64(5))
                    first = s[np.argsort(order, kind="stable")[:p]]
                    held.append((first, np.full(p, sid), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
                    size += p
            if size >= 1 << 19:
                yield flush()
                held, size, seen = [], 0, set()
        if held:
            yield flush()

    return run


def _lists(block: int):
    """Of rows sorted by token, size and set, those that may have a partner in their list, with the number of their block: in a
    list of one block, sizes and positions must leave one; in a longer one, the neighbours' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, x) for x in (np.int64, np.int64, np.int32, np.int32)]
        before = 0  # rows of the held list that have gone on; the first held one then is only there as a neighbour

        def settle(rows: list[np.ndarray], gone: int, more: bool) -> pa.RecordBatch:
            """gone: rows of the first list that went before; more: the last row is a neighbour only."""
            x = dict(zip(("token", "sid", "n", "pos"), (c.astype(np.int64) for c in rows), strict=True))
            size = len(rows[0])
            edge = np.flatnonzero(np.concatenate([[True], x["token"][1:] != x["token"][:-1]]))
            length = np.diff(np.concatenate([edge, [size]]))
            index = np.arange(size) - np.repeat(edge, length)
            if gone:
                index[: length[0]] += gone - 1
            long = np.repeat(length > block, length)
            if gone or more:
                long[: length[0]] |= bool(gone)
                long[size - length[-1] :] |= more
            near = np.concatenate([(x["token"][1:] == x["token"][:-1]) & (100 * x["n"][:-1] >= PERCENT * x["n"][1:]), [False]])
            many = long & (near | np.concatenate([[False], near[:-1]]))
            short = np.flatnonzero(~long)
            y = {k: v[short] for k, v in x.items()}
            for i, j in _pairs_in_question(y) if len(short) else ():
                need = _needed(y["n"][i], y["n"][j])
                ok = np.minimum(y["n"][i] - y["pos"][i], y["n"][j] - y["pos"][j]) >= need
                many[short[i[ok]]] = many[short[j[ok]]] = True
            if gone:
                many[0] = False
            if more:
                many[-1] = False
            return pa.RecordBatch.from_arrays([pa.array(rows[0][many]), pa.array((index[many] // block).astype(np.int32)), *(pa.array(c[many]) for c in rows[1:])], names=["token", "block", "sid", "n", "pos"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True)]
            fresh = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            rows = [x[fresh] for x in rows]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield settle([x[:cut] for x in rows], before, False)
                rows, before = [x[cut:] for x in rows], 0
            if len(rows[0]) > 64 * block:  # a long list goes on; its last two rows stay, one of them as a neighbour
                yield settle(rows, before, True)
                before, rows = before + len(rows[0]) - 1 - (before > 0), [x[-2:] for x in rows]
            held = rows
        if len(held[0]):
            yield settle(held, before, False)

    return run


def _can_link(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions and bitmaps leave the pairs (i, j) of a list in question; the set i is not the larger one."""
    need = _needed(x["n"][i], x["n"][j])
    ok = (np.minimum(x["n"][i] - x["pos"][i], x["n"][j] - x["pos"][j]) >= need) & (100 * x["n"][i] >= PERCENT * x["n"][j])
    i, j, need, at = i[ok], j[ok], need[ok], np.flatnonzero(ok)
    most = x["n"][i] + x["n"][j] - 2 * need  # of the symmetric difference
    good = np.ones(len(i), bool)
    sizes = np.minimum(x["bytes"][i], x["bytes"][j])
    for size in np.unique(sizes):
        k = np.flatnonzero(sizes == size)
        own = np.unique(np.concatenate([i[k], j[k]]))
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(x["bits"][r].as_buffer(), "<u8").reshape(-1, size // 8), 0) for r in own.tolist()])
        for c in range(0, len(k), STEP_PAIRS // 8):
            part = k[c : c + STEP_PAIRS // 8]
            differ = np.bitwise_count(rows[np.searchsorted(own, i[part])] ^ rows[np.searchsorted(own, j[part])]).sum(1, dtype=np.int64)
            good[part] = differ <= most[part]
    out = np.zeros(len(ok), bool)
    out[at[good]] = True
    return out


def _pairs_in_question(x: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by token and size: by step, the pairs of a list that sizes leave, the shorter set first."""
    n = x["n"]
    group = np.cumsum(np.concatenate([[0], x["token"][1:] != x["token"][:-1]])) << 40
    # the shorter set has the shingle among its first ninth; it meets the block of sizes up to 100 / PERCENT of its own
    until = np.searchsorted(group + n, group + 100 * n // PERCENT, "right")
    length = np.where(x["pos"] <= n - _needed(n, n), until - np.arange(len(n)) - 1, 0)
    todo = np.flatnonzero(length > 0)
    total = np.cumsum(length[todo])
    while len(todo):
        k = max(1, int(np.searchsorted(total, total[0] - length[todo[0]] + STEP_PAIRS)))
        part, todo, total = todo[:k], todo[k:], total[k:]
        i = np.repeat(part, length[part])
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(length[part]) - length[part], length[part]) + i + 1


def _first_of_each(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each key the item that comes first by order."""
    by = np.lexsort((order, key))
    return by[np.concatenate([[True], key[by][1:] != key[by][:-1]])] if len(by) else by


def _bitmaps(rows: pa.Table, x: dict) -> None:
    x["bytes"], x["bits"] = pc.binary_length(rows.column("bits")).to_numpy().astype(np.int64), rows.column("bits").combine_chunks()


def _one_each(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """In each block, a partner in question for each row, chosen by a hash, so that a group's many lists give different ones."""
    x = {k: rows.column(k).to_numpy().astype(np.int64) for k in ("token", "block", "sid", "n", "pos")}
    _bitmaps(rows, x)
    x["token"] = np.cumsum(np.concatenate([[0], (x["token"][1:] != x["token"][:-1]) | (x["block"][1:] != x["block"][:-1])]))
    token = rows.column("token").to_numpy()
    choice = lambda i, j: _first_of_each(j, t.mix((x["sid"][i] ^ token[i]).view(t.U64)))
    found = [np.zeros((2, 0), np.int64)]
    for i, j in _pairs_in_question(x):
        ok = _can_link(x, i, j)
        i, j = i[ok], j[ok]
        found.append(np.stack([i, j])[:, choice(i, j)])
    i, j = np.concatenate(found, 1)
    one = choice(i, j)
    return x["sid"][i[one]], x["sid"][j[one]]


def _all_across(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """In each pair of blocks, all pairs in question of a set outside the list's main component (asks) and one of another component."""
    x = {k: rows.column(k).to_numpy().astype(np.int64) for k in ("sid", "component", "n", "pos")}
    _bitmaps(rows, x)
    asks, minor = rows.column("asks").to_numpy(zero_copy_only=False), rows.column("minor").to_numpy(zero_copy_only=False)
    keys = [rows.column(k).to_numpy() for k in ("token", "block", "part")]
    new = np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])])
    cell = (np.cumsum(new) - 1).astype(np.int64) << 40
    todo, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    place = cell[others] + x["n"][others]  # rows come sorted by size in each cell
    first = np.searchsorted(place, cell[todo] - (-PERCENT * x["n"][todo]) // 100)
    length = np.searchsorted(place, cell[todo] + 100 * x["n"][todo] // PERCENT, "right") - first
    first, todo, length = first[length > 0], todo[length > 0], length[length > 0]
    total, found = np.cumsum(length), [np.zeros((2, 0), np.int64)]
    at = 0
    while at < len(todo):
        k = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, "right")))
        i = np.repeat(todo[at:k], length[at:k])
        j = others[np.arange(len(i)) - np.repeat(np.cumsum(length[at:k]) - length[at:k], length[at:k]) + np.repeat(first[at:k], length[at:k])]
        at = k
        ok = (x["component"][i] != x["component"][j]) & (~minor[j] | (x["sid"][i] < x["sid"][j]))  # two outside ask each other: once will do
        i, j = i[ok], j[ok]
        turn = (x["n"][i] > x["n"][j]) | ((x["n"][i] == x["n"][j]) & (x["pos"][i] > x["pos"][j]))
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        ok = x["pos"][i] <= x["n"][i] - _needed(x["n"][i], x["n"][i])  # the shorter set has the shingle among its first ninth
        i, j = i[ok], j[ok]
        found.append(np.stack([i, j])[:, _can_link(x, i, j)])
    i, j = np.concatenate(found, 1)
    return x["sid"][i], x["sid"][j]


def _by_cells(pairs: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], names: tuple[str, ...]):
    """Pairs (a, b) of rows that come sorted by the names: whole cells at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            both = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        found: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(k).to_numpy() for k in names]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.argmax(same))  # where the last cell of the batch begins
            whole = cut or (held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in names))
            if whole and sum(x.num_rows for x in held) + cut >= 1 << 15:
                found.append(pairs(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()))
                held, b = [], b.slice(cut)
            held.append(b)
            if sum(len(x[0]) for x in found) >= 1 << 18:
                found = [tuple(c.to_numpy() for c in out(found).columns)]
                if len(found[0][0]) >= 1 << 17:
                    yield out(found)
                    found = []
        if held:
            found.append(pairs(pa.Table.from_batches(held).combine_chunks()))
        yield out(found)

    return run


def _match_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = t.Hasher()
    for b in batches:
        want, keep, sets = b.column("sid").to_pylist(), [], []
        for k, s in enumerate(shingle_sets(b.column("text"), hasher)):
            if len(s) and set_id(s) == want[k]:
                keep.append(want[k])
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "shingles"])


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, m, both = [], [], []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), t.U64) for s in (x, y))
            place = np.searchsorted(y, x)
            both.append(int((y[np.minimum(place, len(y) - 1)] == x).sum()))
            n.append(len(x))
            m.append(len(y))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(v, pa.int64()) for v in (n, m, both))], names=["a", "b", "n", "m", "both"])


def _intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, their sizes n and m, and how many shingles both have, by their whole sets."""
    x, y = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_intersect, "a bigint, b bigint, n bigint, m bigint, both bigint")


def _linked(n: Column, m: Column, both: Column) -> Column:
    return 100 * both >= PERCENT * (n + m - both)


def _across(pairs: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b of the pairs that link, from the answers of their components' roots where the bounds decide, else by their whole sets.

    A set x that shares s(x) shingles with its root r(x) holds |x| - s(x) others, and lacks |r(x)| - s(x) of the root's. So
    the roots' intersection plus what x and y hold beside is the most that x and y can share, and less what they lack the least.
    """
    sizes, end = known.select("sid", "component", "n"), lambda k: known.select(F.col("sid").alias(k), F.col("component").alias(f"component_{k}"))
    asked = pairs.join(end("a"), "a").join(end("b"), "b").select(F.explode(F.array("a", "b", "component_a", "component_b")).alias("sid"))
    ends = written(asked.distinct())
    sizes, sets = sizes.join(ends, "sid", "left_semi"), sets_of(ends)  # of what little the pairs ask for
    roots = written(_intersections(sizes.where("sid <> component").select(F.col("component").alias("a"), F.col("sid").alias("b")), sets))
    own = sizes.join(roots.select(F.col("b").alias("sid"), F.col("n").alias("root_n"), "both"), "sid", "left")
    own = written(own.select("sid", "component", F.col("n").cast("bigint").alias("n"), F.coalesce("root_n", "n").cast("bigint").alias("root_n"), F.coalesce("both", "n").cast("bigint").alias("own")))
    end = lambda k: own.select(F.col("sid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("component", "n", "root_n", "own")])
    pairs = written(pairs.join(end("a"), "a").join(end("b"), "b"))
    met = pairs.select(F.least("component_a", "component_b").alias("a"), F.greatest("component_a", "component_b").alias("b")).distinct()
    met = _intersections(met, sets).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("both").alias("roots"))
    told = pairs.join(met, (F.least("component_a", "component_b") == F.col("x")) & (F.greatest("component_a", "component_b") == F.col("y")))
    n, m = F.col("n_a"), F.col("n_b")
    most = F.least(n, m, F.col("roots") + n - F.col("own_a") + m - F.col("own_b"))
    least = F.greatest(F.lit(0), F.col("roots") - (F.col("root_n_a") - F.col("own_a")) - (F.col("root_n_b") - F.col("own_b")))
    told = written(told.select("a", "b", F.when(_linked(n, m, least), 1).when(_linked(n, m, most), 0).otherwise(-1).alias("derived")))
    rest = _intersections(told.where("derived = 0"), sets).where(_linked(F.col("n"), F.col("m"), F.col("both")))
    return told.where("derived = 1").select("a", "b").unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row"))
    rows = written(own.mapInArrow(_sets, f"doc {dict(own.dtypes)['doc']}, row bigint, sid bigint, n bigint, bits binary"))
    owners = rows.where("sid is not null and doc is not null").groupBy("sid").agg(F.min(F.struct("doc", "row")).alias("least"), F.first("bits").alias("bits"), F.first("n").alias("n"))
    owners = written(owners.select("sid", "least.doc", "least.row", "bits", "n"))
    counts = gram_sketch(own, "text", SHINGLE, True)
    levels = np.clip(np.floor(np.log2(np.maximum(counts / max(counts.mean(), 1e-9), 1))), 0, 30).astype(np.uint8)
    prefixes = own.where("doc is not null and text is not null").select("text").mapInArrow(_prefixes(levels), "token bigint, sid bigint, n int, pos int")
    lists = written(prefixes.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(_lists(block), LISTS))
    bits = owners.select("sid", "bits")

    def sets_of(asked: DataFrame) -> DataFrame:
        """sid, shingles of the sets asked for (sid, distinct): each round reads the texts of its own, which are few next to all."""
        wanted = written(asked.join(owners.select("sid", "row"), "sid"))
        texts = own.join(wanted, "row").select("row", F.crc32(F.col("text").cast("binary")).alias("check"), "sid", "text").dropDuplicates(["row", "check"])
        return written(texts.select("sid", "text").mapInArrow(_match_sets, "sid bigint, shingles binary"))

    full = lists.join(bits, "sid").select("token", "block", "sid", "n", "pos", "bits")
    pairs = full.repartition("token", "block").sortWithinPartitions("token", "block", "n", "sid").mapInArrow(_by_cells(_one_each, ("token", "block")), "a bigint, b bigint").distinct()
    pairs = written(pairs)
    first = written(_intersections(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())).where(_linked(F.col("n"), F.col("m"), F.col("both"))).select("a", "b"))
    so_far = written(components(first).select(F.col("node").alias("sid"), "component"))
    known = owners.select("sid", "n").join(so_far, "sid", "left").select("sid", "n", F.coalesce("component", "sid").alias("component"))
    second = written(_across(_second_pairs(lists, known.select("sid", "component"), bits, block), known, sets_of))
    # components of components: few edges are left
    node = lambda k: known.select(F.col("sid").alias(k), F.col("component").alias(f"component_{k}"))
    joined = components(second.join(node("a"), "a").join(node("b"), "b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
    of = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component", "left").select("sid", F.coalesce("cluster", "component").alias("cluster"))
    owned = owners.select("sid", "doc").join(of, "sid")
    least = owned.groupBy("cluster").agg(F.min("doc").alias("component_id"))
    named = owned.join(least, "cluster").select("sid", "component_id")
    return rows.select("doc", "sid", "n").join(named, "sid", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def _second_pairs(lists: DataFrame, known: DataFrame, bits: DataFrame, block: int) -> DataFrame:
    """a, b: all pairs in question of different components, of lists that hold several."""
    placed = lists.join(known, "sid")
    kinds = placed.groupBy("token", "component").agg(F.count("*").alias("n"))
    main = kinds.groupBy("token").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    main = main.select("token", F.col("top.component").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("parts"))
    mixed = written(placed.join(main, "token").withColumn("minor", F.col("component") != F.col("main")).drop("main"))
    ranges = mixed.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))  # blocks whose sizes cannot link are skipped
    asking = mixed.where("minor").drop("block").join(ranges, "token").where((100 * F.col("n") >= PERCENT * F.col("low")) & (100 * F.col("high") >= PERCENT * F.col("n")))
    asking = asking.withColumn("part", F.pmod(F.xxhash64("sid"), "parts").cast("int")).withColumn("asks", F.lit(True))
    asked = mixed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(False))
    columns = ["token", "block", "part", "asks", "minor", "sid", "component", "n", "pos"]
    cells = asking.select(*columns).unionByName(asked.select(*columns)).join(bits, "sid").select(*columns, "bits")
    return written(cells.repartition("token", "block", "part").sortWithinPartitions("token", "block", "part", "n", "sid").mapInArrow(_by_cells(_all_across, ("token", "block", "part")), "a bigint, b bigint").distinct())


def brute(docs: list[tuple]) -> list[tuple]:
    """What the query returns, over all pairs; for tests."""
    import re

    sets = []
    for _, s in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (s or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at: dict = {}
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        if docs[i][0] is None:
            continue
        near = {j for x in s for j in at.get(x, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for x in s:
            at.setdefault(x, []).append(i)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def op6_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
