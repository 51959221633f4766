"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the transfers that move the fewest bytes.

Documents are dealt by a hash to blocks, and blocks stand on the old shards' byte lines; the driver sees only the blocks' sizes
(``blocks`` rows, a parameter). A flow from the old shards to the new ones, free where a shard keeps its bytes and at a cost of
one a byte elsewhere, tells how much goes where; cutting the byte lines accordingly turns flows into transfers of runs of blocks,
and of documents within a block where a cut falls into it. To make sizes near equal in spite of a few very long documents, these
are dealt first; the rest then flows into what capacity they really left. The greatest documents of all (``HEADS`` a shard, so a bounded number)
are dealt one by one on the driver, longest first: each stays where it is if there is room, else it goes where there is most. ``reshard`` does this to folders of rows: it reads where
each row is now, and replaces the folders of those shards that a row leaves or enters.

Law ``bytes``: shard sizes (UTF-8 bytes of the text plus 8 a row) differ from each other by no more than a few of the small
documents, and by a few per cent where there are only a few hundred documents. Defined results: a null text has no bytes; null ids, ties and repeated rows are placed like others, by id, then
checksum, then size; an empty table gives no rows; other columns are ignored by ``assign``. In folders a row is known by its file and its
place there, so null and repeated ids are moved like others; a row in no shard yet (null) is free to go to any.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import groupby, pairwise
from math import log2

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import folder, written

SHARDS, OLD_SHARDS, BLOCKS, ROW_BYTES = 24, 16, 6144, 8
#: So many documents for each shard, the greatest ones, are dealt one by one.
HEADS = 64
#: The folders' column and the order in a shard, and what a row is known by: names that no input has.
SHARD, SLOT, PLACE = "__shard", "__slot", ("__file", "__row")


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows from each supply to each capacity at least total cost; both sums are equal. Shortest augmenting paths (Bellman-Ford)."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for j, c in enumerate(capacity):
        add(n + j, sink, c, 0)
    start = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, supply[i], cost[i][j])
    while True:
        far = [float("inf")] * (n + m + 2)
        via: list[int] = [-1] * (n + m + 2)
        far[source], queue, waiting = 0, [source], {source}
        while queue:
            a = queue.pop(0)
            waiting.discard(a)
            for e in out[a]:
                b, room, price = edges[e]
                if room > 0 and far[a] + price < far[b]:
                    far[b], via[b] = far[a] + price, e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if via[sink] < 0:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        room = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= room
            edges[e ^ 1][1] += room
    return [[edges[start + 2 * (i * m + j) + 1][1] for j in range(m)] for i in range(n)]


def transfers(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Flows when staying in the shard of the same number is free."""
    return min_cost_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(len(supply))])


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _by_cuts(place: Column, flows: list[list[int]]) -> Column:
    """The new shard of a place on the old shards' joined byte lines: what stays comes first on each line."""
    end, ends = 0, []
    for i, row in enumerate(flows):
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):  # noqa: B023
            if row[j]:
                end += row[j]
                ends.append((end, j))
    if not ends:
        return F.lit(0)
    # a search tree of conditions, so that few are looked at
    def pick(k: list[tuple[int, int]]) -> Column:
        if len(k) == 1:
            return F.lit(k[0][1])
        half = len(k) // 2
        return F.when(place < F.lit(k[half - 1][0]), pick(k[:half])).otherwise(pick(k[half:]))

    return pick(ends)


def _dealt(rows: DataFrame, flows: list[list[int]], starts: dict[int, int], blocks: int) -> DataFrame:
    """Adds shard to rows, by their middle on the byte line."""
    spark = rows.sparkSession
    lines = F.broadcast(spark.createDataFrame(sorted(starts.items()), "block int, start bigint"))  # at most a row for each block
    within = F.sum("size").over(Window.partitionBy("block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("start") * 2 + F.col("upto") * 2 - F.col("size")
    placed = rows.withColumn("upto", within).join(lines, "block").withColumn("middle", (middle / 2).cast("bigint"))
    return placed.withColumn("shard", _by_cuts(F.col("middle"), flows).cast("int")).drop("upto", "start", "middle")


def _heads(rows: DataFrame, capacity: list[int], was: Column, most: int) -> tuple[DataFrame | None, list[int], int]:
    """(id, shard) of the greatest documents, the room that they leave, and the size up to which documents are not among them."""
    top = rows.select("size").orderBy(F.desc("size")).limit(most + 1).collect()
    limit = top[most].size if len(top) > most else -1  # ties at the limit are left out, so that there are never more than most
    found = rows.where(F.col("size") > limit).select("id", "size", was.alias("was")).collect()
    room, to = list(capacity), []
    def put(r: Row, j: int) -> None:
        room[j] -= r.size
        to.append((r.id, j))

    # among documents of about one size those that stay go first, so that none has to leave for one that comes
    for _, like in groupby(sorted(found, key=lambda r: (-r.size, r.id)), key=lambda r: int(4 * log2(r.size))):
        leave = []
        for r in like:
            if r.was is not None and r.was < len(room) and room[r.was] >= r.size:
                put(r, r.was)
            else:
                leave.append(r)
        for r in leave:
            put(r, max(range(len(room)), key=lambda j: (room[j], -j)))
    return (rows.sparkSession.createDataFrame(to, "id bigint, shard int") if to else None), room, limit


def _starts(sizes: dict[int, int]) -> dict[int, int]:
    keys = sorted(sizes)
    out, at = {}, 0
    for k in keys:
        out[k] = at
        at += sizes[k]
    return out


def _supplies(sizes: dict[int, int], blocks: int, old_shards: int) -> list[int]:
    out = [0] * old_shards
    for k, n in sizes.items():
        out[k * old_shards // blocks] += n
    return out


def _lines(docs: DataFrame, old: str, shards: int, blocks: int) -> tuple[int, int]:
    """How many byte lines there are, and how many blocks on each; rows in no shard stand on the last, which has the number of no new shard."""
    least, most = docs.agg(F.min(F.col(old).cast("int")), F.max(F.col(old).cast("int"))).first()
    if least is not None and least < 0:
        raise ValueError("shards are numbered from 0")
    old_shards = max(shards, -1 if most is None else most + 1) + 1
    return old_shards, max(1, blocks // old_shards)


def _block(old: Column, old_shards: int, each: int) -> Column:
    return (F.coalesce(old, F.lit(old_shards - 1)) * each + F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(each))).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, blocks: int = BLOCKS, doc_id: str = "doc_id", text: str = "text", old: str | None = None, carry: Sequence[str] = (), heads_each: int = HEADS) -> DataFrame:
    """doc_id, size, text_crc32, block, old_shard, shard, slot (gapless from 0 in its shard) of every row, and the columns to carry.

    ``old`` is the column of the shard that a row is in, from 0 or null; without it the hash deals the rows to ``old_shards``.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"), *([F.col(old).cast("int").alias("old_shard")] if old else []), *carry)
    if old:
        old_shards, each = _lines(docs, old, shards, blocks)
        blocks = each * old_shards
        block = _block(F.col("old_shard"), old_shards, each)
    else:
        block = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int")
    rows = written(rows.withColumn("block", block).withColumn("id", F.monotonically_increasing_id()))
    was = F.col("old_shard") if old else F.floor(F.col("block") * old_shards / blocks).cast("int")
    total = rows.agg(F.sum("size")).first()[0] or 0
    capacity = equal_capacities(total, shards)
    heads, capacity, most = _heads(rows, capacity, was, heads_each * shards)
    dealt = rows.where("size < 0").withColumn("shard", F.lit(0)) if heads is None else rows.where(F.col("size") > most).join(F.broadcast(heads), "id")
    rows, capacity = rows.where(F.col("size") <= most), [max(0, c) for c in capacity]
    kinds = rows.groupBy(F.floor(F.log2("size")).cast("int").alias("k")).agg(F.sum("size").alias("n")).orderBy("k").collect()
    total, upto, limit = sum(r.n for r in kinds), 0, 0
    for r in kinds:  # the small ones hold a quarter of the bytes
        upto += r.n
        limit = 1 << (r.k + 1)
        if 4 * upto >= total:
            break
    large, small = rows.where(F.col("size") >= limit), rows.where(F.col("size") < limit)

    def sums(part: DataFrame) -> dict[int, int]:
        return {r.block: r.n for r in part.groupBy("block").agg(F.sum("size").alias("n")).collect()}

    def flows(sizes: dict[int, int], room: list[int], stay: bool = False) -> list[list[int]]:
        """Capacities scaled to what there is of these rows; a shard may keep all it has if that leaves a sixteenth to others."""
        supply = _supplies(sizes, blocks, old_shards)
        n, have = sum(supply), max(sum(room), 1)
        share = [n * sum(room[:j]) // have for j in range(len(room) + 1)]
        share[-1] = n
        scaled = [b - a for a, b in pairwise(share)]
        if stay:
            scaled = [own if c < own <= most * 15 // 16 else c for c, own, most in zip(scaled, [*supply, *[0] * len(room)], room)]
        return transfers(supply, scaled)

    sizes = sums(large)
    first = written(_dealt(large, flows(sizes, capacity, bool(old)), _starts(sizes), blocks))
    taken = {r.shard: r.n for r in first.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    sizes = sums(small)
    second = _dealt(small, flows(sizes, [max(0, c - taken.get(j, 0)) for j, c in enumerate(capacity)]), _starts(sizes), blocks)
    both = written(first.unionByName(second).unionByName(dealt.select(*first.columns)).drop("id"))
    counts = both.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("offset"))  # blocks plus cuts rows
    number = F.row_number().over(Window.partitionBy("block", "shard").orderBy("doc_id", "text_crc32", "size"))
    out = both.withColumn("number", number).join(F.broadcast(offsets), ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "block", was.alias("old_shard"), "shard", (F.col("offset") + F.col("number") - 1).alias("slot"), *carry)


def layout(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the folders __shard=N, of that schema, with __shard and __slot."""
    return spark.read.schema(StructType([*schema.fields, StructField(SLOT, LongType()), StructField(SHARD, IntegerType())])).parquet(path)


def lay_out(docs: DataFrame, path: str, shards: int = OLD_SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """A first layout, dealt by a hash; its rows have no slot yet."""
    if clash := {SHARD, SLOT, *PLACE} & set(docs.columns):
        raise ValueError(f"columns in use: {sorted(clash)}")
    at = F.pmod(F.xxhash64(doc_id, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))), F.lit(shards)).cast("int")
    docs.withColumn(SLOT, F.lit(None).cast("bigint")).withColumn(SHARD, at).write.partitionBy(SHARD).parquet(path, compression="zstd")


def reshard(spark: SparkSession, path: str, schema: StructType, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", files: int = 8) -> list[int]:
    """Moves the rows of a layout to so many shards of equal size; gives the shards whose folders were replaced or dropped.

    A block without a cut goes to one shard, so that its rows find theirs in a table of blocks; only the rows of the blocks with a
    cut are joined one by one. New folders are written whole beside the old ones before any is replaced.
    """
    now = layout(spark, path, schema).select("*", F.col("_metadata.file_name").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    placed = written(assign(now, shards, doc_id=doc_id, text=text, old=SHARD, carry=(SLOT, *PLACE)))
    changed = placed.where(~F.col("old_shard").eqNullSafe(F.col("shard")) | F.col(SLOT).isNull())
    affected = sorted(r[0] for r in changed.select(F.explode(F.array("old_shard", "shard")).alias("n")).where("n is not null").distinct().collect())
    if not affected:
        return []
    kind = F.floor(F.log2("size")).cast("int")
    by_block = written(placed.groupBy("block", kind.alias("kind")).agg(F.min("shard").alias("to"), F.max("shard").alias("most")))  # blocks by kinds of size
    cut = F.broadcast(by_block.where("to < most").select("block", "kind"))
    offsets = placed.where(F.col("shard").isin(affected)).groupBy(F.col("shard").alias("to"), "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("to").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(offsets.select("to", "block", F.coalesce(before, F.lit(0)).alias("offset")))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    here = now.where(F.col(SHARD).isin(affected) | F.col(SHARD).isNull())  # a row in no shard is in the folder of null
    here = here.select(F.struct(*schema.names).alias("row"), F.col(doc_id).alias("doc_id"), (F.octet_length(data) + ROW_BYTES).alias("size"), F.crc32(data).alias("text_crc32"), F.col(SHARD).alias("old_shard"), *PLACE)
    here = here.withColumn("kind", kind).withColumn("block", _block(F.col("old_shard"), *_lines(now, SHARD, shards, BLOCKS)))
    one = F.coalesce("old_shard", F.lit(-1)).alias("old")
    ends = placed.withColumn("kind", kind).join(cut, ["block", "kind"]).select(one, *PLACE, F.col("shard").alias("to"))
    of_cut = here.join(cut, ["block", "kind"]).withColumn("old", one).join(ends, ["old", *PLACE]).drop("old")
    rows = here.join(F.broadcast(by_block.where("to = most").select("block", "kind", "to")), ["block", "kind"]).unionByName(of_cut)
    rows = rows.withColumn("bucket", F.pmod("block", F.lit(files))).repartition("to", "bucket")
    number = F.row_number().over(Window.partitionBy("to", "bucket", "block").orderBy("doc_id", "text_crc32", "size", "old_shard", *PLACE))
    rows = rows.withColumn("number", number).join(offsets, ["to", "block"]).select("row.*", (F.col("offset") + F.col("number") - 1).alias(SLOT), F.col("to").alias(SHARD))
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    rows.sortWithinPartitions(SHARD, SLOT).write.partitionBy(SHARD).parquet(staged, compression="zstd")
    _replace(spark, path, staged, [f"{SHARD}={n}" for n in affected] + [f"{SHARD}=__HIVE_DEFAULT_PARTITION__"])
    return affected


def _replace(spark: SparkSession, path: str, staged: str, names: list[str]) -> None:
    """Puts the staged folders in the place of the old ones; one that has none staged goes."""
    file = spark._jvm.org.apache.hadoop.fs.Path
    fs = file(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        fs.delete(file(f"{path}/{name}"), True)
        if fs.exists(file(f"{staged}/{name}")) and not fs.rename(file(f"{staged}/{name}"), file(f"{path}/{name}")):
            raise OSError(f"{staged}/{name} could not be put in place")
    fs.delete(file(staged), True)


def resharded(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, read from the shards' folders: rows laid out in the old shards, then moved to the new."""
    path, schema = folder(docs.sparkSession), docs.schema
    lay_out(docs, path)
    reshard(docs.sparkSession, path, schema)
    data = F.coalesce("text", F.lit("")).cast("binary")
    size = (F.octet_length(data) + ROW_BYTES).cast("bigint").alias("size")
    return layout(docs.sparkSession, path, schema).select("doc_id", size, F.crc32(data).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(SHARD).alias("shard"), F.col(SLOT).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return resharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
