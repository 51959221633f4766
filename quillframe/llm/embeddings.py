"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Two vectors link where labels are equal and not null and the cosine, in double precision, is at least the threshold. Equal
vectors of a label are one entity with a weight. Each entity goes to one bucket in each table; a worker multiplies the vectors of
a bucket, block by block, and counts a pair only in the first table where the two share a bucket. So no pair leaves a worker:
only counts of links and, of each block, a star for each of its components. Buckets are found by ids alone; vectors are
fetched for those of two entities or more. A bucket of more than ``bucket_rows`` entities is dealt as pairs of blocks, which
together hold all its pairs.

Recall: vectors at an angle a share a bucket of k signs with probability (1 - a/pi)**k; at cosine 0.98, k = 16 and 17 tables
find a pair with probability 0.9993. Links found are exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with null label, link with
nothing; vectors of different length do not link; labels of any type with an order are compared as they are (as in SQL, 0.0 equals -0.0
and NaN equals NaN), and ids of any such type are kept; a row without id is reported with no links and no component; rows that repeat
count as other vectors; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, least_members
from .shared import written

COSINE, BITS, TABLES = 0.98, 16, 17
BUCKET_ROWS = 4096
SEED = 11


def planes(length: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, bits * tables))


def sign_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (unit @ planes(unit.shape[1], bits, tables) >= 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _hash_rows(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, label = b.column("vector"), b.column("label").to_pylist()
            n, lengths = b.num_rows, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten()
            bad = pc.fill_null(pc.invert(pc.is_finite(values)), True).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lengths)])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            good = (lengths > 0) & (sums(bad) == 0) & (sums(flat != 0) > 0) & np.array([x is not None for x in label], bool) & ~np.asarray(pc.is_null(b.column("vec_id")).to_numpy(zero_copy_only=False))
            sid, keys = [None] * n, [None] * n
            for length in np.unique(lengths[good]).tolist():
                rows = np.flatnonzero(good & (lengths == length))
                matrix = flat[(at[rows][:, None] + np.arange(length)).ravel()].reshape(-1, length)
                for r, vector, key in zip(rows.tolist(), matrix, sign_keys(unit_rows(matrix), bits, tables).tolist(), strict=True):
                    sid[r] = int.from_bytes(hashlib.blake2b(label[r].encode() + b"\0" + vector.tobytes(), digest_size=8).digest(), "little") >> 1
                    keys[r] = key
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int32()))], names=["vec_id", "vector", "label", "sid", "keys"])

    return run


def _compare(threshold: float):
    def pairs(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(x), 1024):
            for b in range(a if same else 0, len(y), 1024):
                i, j = np.nonzero(x[a : a + 1024] @ y[b : b + 1024].T >= threshold)
                i, j = i + a, j + b
                keep = i < j if same else np.ones(len(i), bool)
                yield i[keep], j[keep]

    def bucket(g: pa.Table) -> tuple[np.ndarray, ...]:
        sid, weight, own, first = (g.column(k).to_numpy() for k in ("sid", "weight", "own", "first"))
        table, keys = g.column("table").to_numpy(), np.array(g.column("keys").to_pylist())
        labels = g.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        lengths = pc.list_value_length(g.column("vector")).to_numpy()
        links, left, right = np.zeros(len(sid), np.int64), [], []
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            unit = unit_rows(g.column("vector").take(pa.array(rows)).combine_chunks().flatten().to_numpy().reshape(-1, length))
            diagonal = g.column("second")[0].as_py() == first[0]
            x, y = (np.arange(len(rows)),) * 2 if diagonal else (np.flatnonzero(own[rows] == first[rows]), np.flatnonzero(own[rows] != first[rows]))
            for i, j in pairs(unit[x], unit[y], diagonal):
                i, j = rows[x[i]], rows[y[j]]
                # a hash may bring together what has nothing in common; an earlier table has counted what it shares
                ok = (labels[i] == labels[j]) & (table[i] == table[j]) & (sid[i] != sid[j])
                i, j = i[ok], j[ok]
                earlier = (keys[i] == keys[j]) & (np.arange(keys.shape[1]) < table[i][:, None])
                i, j = i[~earlier.any(1)], j[~earlier.any(1)]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                left.append(i)
                right.append(j)
        root = least_members(len(sid), np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64))
        hit = links > 0
        return sid[hit], sid[root][hit], links[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "first", "second"]

        def out(found: list[tuple]) -> pa.RecordBatch:
            a, b, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

        held, found = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(x).to_numpy() for x in names], 1)
            edge = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if held and tuple(held[-1].column(x)[0].as_py() for x in names) != tuple(k[a].tolist()):
                    if sum(x.num_rows for x in held) > 1:
                        found.append(bucket(pa.Table.from_batches(held).combine_chunks()))
                    held = []
                held.append(batch.slice(a, b - a))
            if sum(len(x[0]) for x in found) >= 1 << 16:
                yield out(found)
                found = []
        if sum(x.num_rows for x in held) > 1:
            found.append(bucket(pa.Table.from_batches(held).combine_chunks()))
        yield out(found)

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = COSINE, bits: int = BITS, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    types = dict(vectors.dtypes)
    name = F.col(label) + 0 if types[label] in ("float", "double") else F.col(label)  # so that 0.0 and -0.0 have one name
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), name.cast("string").alias("label"))
    kind, ids = dict(own.dtypes)["vector"], dict(own.dtypes)["vec_id"]
    if kind not in ("array<float>", "array<double>"):
        kind = "array<double>"
        own = own.withColumn("vector", F.col("vector").cast(kind))
    rows = written(own.mapInArrow(_hash_rows(bits, tables), f"vec_id {ids}, vector {kind}, label string, sid bigint, keys array<int>"))
    entities = written(rows.where("sid is not null").groupBy("sid").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"), F.first("keys").alias("keys")))
    dealt = entities.select("sid", "label", F.size("vector").alias("length"), F.posexplode("keys").alias("table", "key")).select("sid", "table", F.xxhash64("label", "length", "table", "key").alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"))
    dealt = dealt.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("sid", F.lit(1)), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    dealt = dealt.join(entities.select("sid", "weight", "label", "keys", "vector"), "sid").select("bucket", "first", "second", "own", "sid", "weight", "label", "table", "keys", "vector")
    found = written(dealt.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second").mapInArrow(_compare(threshold), "a bigint, b bigint, n bigint"))
    links = found.groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n"))
    of = components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("sid"), "component")
    named = entities.select("sid", "weight", "least").join(links, "sid", "left").join(of, "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("sid", "n_links", "component_id")
    out = rows.select("vec_id", "sid").join(named, "sid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def brute(rows: list[tuple], threshold: float = COSINE) -> list[tuple]:
    """What the query returns, over all pairs; for tests."""
    good = [i for i, (v, x, y) in enumerate(rows) if v is not None and y is not None and x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for p, i in enumerate(good):
        for j in good[p + 1 :]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                u, w = (unit_rows(np.array([rows[k][1]], np.float64))[0] for k in (i, j))
                if u @ w >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least: dict = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    return [(v, links[i], None if v is None else least[root(i)], None if v is None else least[root(i)] == v) for i, (v, _, _) in enumerate(rows)]


def op9_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
