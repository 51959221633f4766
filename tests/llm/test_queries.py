"""The queries against brute force, SQL or held-out labels, on the smallest tables and on small hard ones."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillframe.llm import chat, decontaminate, embeddings, fm, jaccard, language, mixing, quality, sharding, substring, toxicity
from quillframe.llm.components import components
from quillframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, TEXT2 string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
HARD = [
    (None, "x y z q r t"), (5, None), (6, ""), (7, "Short One"), (8, "short  one"), (4, "short one two"), (9, "a b " * 40), (1, "a b " * 30 + "x"), (None, "a b " * 15),
    (10, LONG), (11, LONG + " end"), (12, " ".join(str(i % 30) for i in range(100))), (12, " ".join(str(i % 30) for i in range(5, 100))), (12, " ".join(str(i % 30) for i in range(100))), (13, "\n\t "), (14, "é è Ü ß 😀 " * 9),
]


def hard(spark):
    return spark.createDataFrame([(k, s, "s", "other") for k, s in HARD], DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def pairs(spark, name, *columns):
    return [tuple(r) for r in read(spark, name).select(*columns).collect()]


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    columns = sorted(df.columns)
    at = [want.columns.index(k) for k in columns]
    assert sorted(str(tuple(r[k] for k in columns)) for r in df.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


def test_fm_index():
    rng = np.random.default_rng(0)
    for n, sigma in ((0, 2), (1, 2), (40, 2), (300, 5)):
        text = rng.integers(0, sigma, n)
        index = fm.FMIndex(text)
        patterns = rng.integers(1, sigma + 1, (30, 3))
        for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
            assert sorted(index.locate(np.arange(lo, hi))) == [i for i in range(n - 2) if (text[i : i + 3] == p).all()]
        if n:
            length, lo, hi = index.matching_statistics(text, np.arange(n + 1), 4, 2)
            for e in range(n + 1):
                best = next((k for k in range(min(4, e), 0, -1) if (text[e - k : e] > 0).all() and sum((text[i : i + k] == text[e - k : e]).all() for i in range(n - k + 1)) > 1), 0)
                assert length[e] == best


def test_substring(spark):
    assert rows(substring.dedup(hard(spark), with_text=False)) == sorted(substring.brute(HARD), key=str)
    assert rows(QUERIES["op5_substring_dedup"](spark, SF)) == sorted(substring.brute(pairs(spark, "documents", "doc_id", "text")), key=str)
    assert substring.dedup(hard(spark).limit(0)).collect() == []
    docs = pairs(spark, "documents", "doc_id", "text")
    assert rows(substring.dedup(read(spark, "documents"), with_text=False, crowded=2)) == sorted(substring.brute(docs), key=str)
    kept = {r.doc_id: r.kept_text for r in substring.dedup(hard(spark).where("doc_id in (7, 14)")).collect()}
    assert kept == {7: "Short One", 14: "é è Ü ß 😀"}


def test_substring_of_repeated_and_null_ids(spark):
    """Many texts without id, which are one document; repeated rows; anchors with a crowd of fragments."""
    import random

    r = random.Random(5)
    parts = [" ".join(f"q{r.randrange(10**6)}" for _ in range(24)) for _ in range(300)]
    word = lambda n: " ".join(f"z{r.randrange(10**6)}" for _ in range(n))
    data = [(None, f"{r.choice(parts)} {word(r.randrange(4))}") for _ in range(7000)]
    data += [(7, data[0][1]), (7, data[0][1]), (7, f"{word(3)} {parts[1]}"), (8, f"{word(2)} {parts[1]} x"), (8, f"{word(2)} {parts[1]} x")]
    common = word(30)
    data += [(10_000 + i, f"{word(15)} {common} {word(15)}") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id int, text string").repartition(5)
    want = sorted(substring.brute(data), key=str)
    assert rows(substring.dedup(df, with_text=False)) == want
    some = [x for x in data if x[0] is not None]
    df = spark.createDataFrame(some, "doc_id int, text string").repartition(3)
    for crowd in (3, 1):  # most anchors are crowds
        assert rows(substring.dedup(df, with_text=False, crowded=crowd)) == sorted(substring.brute(some), key=str)
    with pytest.raises(TypeError):
        substring.dedup(df.withColumn("doc_id", mixing.F.col("doc_id").cast("string")))


def test_decontaminate(spark):
    items = [(1, "W1 w2, w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "short one"), (None, "x y"), (3, None), (4, "..."), (5, "short ONE"), (10, "é è ü ß")]
    table = spark.createDataFrame(items, "item_id bigint, text string")

    def digest(df):
        from pyspark.sql import functions as F

        n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
        return rows(df.select("doc_id", "n_words", n, F.size("item_ids"), decontaminate.digest(F.col("item_ids")), F.size("spans") > 0))

    want = sorted(decontaminate.brute(HARD, items), key=str)
    assert digest(decontaminate.hits(hard(spark), table)) == want
    assert digest(decontaminate.hits(hard(spark), table, shard_words=1)) == want
    assert not any(r[5] for r in digest(decontaminate.hits(hard(spark), table.limit(0))))
    assert decontaminate.hits(hard(spark).limit(0), table).collect() == []
    got = rows(QUERIES["op8_decontaminate"](spark, SF))
    assert got == sorted(decontaminate.brute(pairs(spark, "documents", "doc_id", "text"), pairs(spark, "benchmark", "item_id", "text")), key=str)
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(hard(spark), table).where("doc_id in (4, 7, 8)").collect()}
    assert left == {4: "\n two"}


def test_decontaminate_by_blocks(spark, monkeypatch):
    """Phrases of several blocks, of which one is broadcast at a time; repeated rows and ids, clashing names."""
    from pyspark.sql import functions as F

    items = [(i % 40, " ".join(f"w{(i * 13 + k) % 977}" for k in range(15))) for i in range(60)] + [(90, "short one")]
    table = spark.createDataFrame(items, "item_id bigint, text string").repartition(1)
    live, most, ship = [], [], decontaminate.shipped

    def counting(session, value):
        get = ship(session, value)
        if value.ids:
            live.append(get)
            most.append(len(live))
            destroy = get.held.destroy
            get.held.destroy = lambda *a, **k: (live.remove(get), destroy(*a, **k))
        return get

    monkeypatch.setattr(decontaminate, "shipped", counting)
    docs = spark.createDataFrame([*HARD, *HARD[:4]], "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("spans", F.lit("s")).withColumn("n_words", F.lit(7)).withColumn("row", F.lit("r"))
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    got = decontaminate.hits(docs, table, block_bytes=1500)
    got = rows(got.select("doc_id", "n_words", n, F.size("item_ids"), decontaminate.digest(F.col("item_ids")), F.size("spans") > 0))
    assert got == sorted(decontaminate.brute([*HARD, *HARD[:4]], items), key=str)
    assert len(most) > 2 and max(most) == 1
    many, one = (rows(decontaminate.remove_spans(docs, table, block_bytes=k)) for k in (1500, 1 << 20))
    assert many == one and 0 < len(one) < docs.count() and decontaminate.remove_spans(docs, table, block_bytes=1500).columns == docs.columns


def test_near_duplicates(spark):
    import random

    r = random.Random(1)
    base = [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(200)]
    near = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(200)] = f"e{r.randrange(10_000)}"
        near.append((100 + i, " ".join(w)))
    data = [*HARD, *near, (100, near[-1][1]), (100, "other words of the same id here now")]
    df = spark.createDataFrame([(k, s, "x") for k, s in data], "doc_id bigint, text string, sid string")
    for block in (1024, 8):  # lists in one block, and in many
        assert rows(jaccard.near_duplicates(df, block=block)) == sorted(jaccard.brute(data), key=str)
    named = [(None if k is None else f"k{k:05d}", s, x) for k, s, x in ((k, s, "x") for k, s in data)]
    got = rows(jaccard.near_duplicates(spark.createDataFrame(named, "doc_id string, text string, sid string")))
    assert got == sorted(((None if k is None else f"k{k:05d}", n, None if c is None else f"k{c:05d}") for k, n, c in jaccard.brute(data)), key=str)
    assert rows(QUERIES["op6_ngram_jaccard"](spark, SF)) == sorted(jaccard.brute(pairs(spark, "documents", "doc_id", "text")), key=str)
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_long_lists():
    """Blocks of lists that are longer than what is held, as the brute rule has them."""
    rng = np.random.default_rng(1)
    token, sid = np.repeat([3, 5, 9], [40, 2000, 30]), rng.integers(0, 10**6, 2070)
    n = rng.integers(20, 4000, 2070)
    by = np.lexsort((sid, n, token))
    columns = [token[by], sid[by], n[by].astype(np.int32), np.zeros(2070, np.int32)]
    for size in (7, 300, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in columns], names=list("abcd")) for i in range(0, 2070, size)]
        got = pa.Table.from_batches(jaccard._lists(16)(iter(batches)))
        five = got.filter(pa.compute.equal(got["token"], 5))
        k = columns[0] == 5
        own = columns[2][k].astype(int)
        near = np.concatenate([100 * own[:-1] >= 80 * own[1:], [False]])
        keep = near | np.concatenate([[False], near[:-1]])
        assert five["sid"].to_pylist() == columns[1][k][keep].tolist() and five["block"].to_pylist() == (np.arange(2000)[keep] // 16).tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7)]
    for at_once in (0, 100):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), at_once=at_once).collect()}
        assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}


def test_components_of_hubs(spark):
    rng = np.random.default_rng(3)
    edges = [(5000, int(x)) for x in range(1, 900)] + [(int(a), int(b)) for a, b in rng.integers(10_000, 10_400, (300, 2))]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for at_once in (0, 10_000):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), at_once=at_once).collect()}
        assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_components_that_are_not_whole_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        components(edges, rounds=1, at_once=0)
    assert components(edges.limit(0), rounds=1).collect() == [] and components(edges.limit(0), at_once=-1).collect() == []


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 8))
    data = [(None, [1.0, 2.0], 1), (50, None, 1), (51, [0.0, 0.0], 1), (52, [1.0, None], 1), (53, [float("nan"), 1.0], 1), (54, [], 1), (55, [1.0, 2.0], None), (56, [1.0, 2.0], 1), (57, [2.0, 4.0], 1), (58, [1e300, 2e300], 1), (56, [1.0, 2.0], 1)]
    data += [(i, (centres[i % 6] + rng.standard_normal(8) * 0.12).tolist(), i % 2) for i in range(40)]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id bigint, embedding array<double>, label int, sid string")
    want = sorted(embeddings.brute(data), key=str)
    for size in (4096, 3):
        assert rows(embeddings.near_duplicates(df, bits=6, tables=40, bucket_rows=size)) == want
    assert embeddings.near_duplicates(df.limit(0)).collect() == []
    e = pairs(spark, "embeddings", "vec_id", "embedding", "label")
    assert rows(QUERIES["op9_embedding_dedup"](spark, SF)) == sorted(embeddings.brute(e), key=str)
    # labels as they are: doubles, strings; ids as they are
    for kind, names in (("double", [1.2, 1.7, -0.0, 0.0, float("nan"), float("nan")]), ("string", ["x", "y", "", "", "z", "z"])):
        data = [(f"v{i}", [1.0, 2.0], x) for i, x in enumerate(names)]
        got = embeddings.near_duplicates(spark.createDataFrame(data, f"vec_id string, embedding array<double>, label {kind}"))
        assert rows(got) == [("v0", 0, "v0", True), ("v1", 0, "v1", True), ("v2", 1, "v2", True), ("v3", 1, "v2", False), ("v4", 1, "v4", True), ("v5", 1, "v4", False)]
    # recall at the threshold itself, with the parameters in use
    found = 0
    for k in range(200):
        u = embeddings.unit_rows(rng.standard_normal((1, 64)))[0]
        v = rng.standard_normal(64)
        v = embeddings.unit_rows((v - (v @ u) * u)[None])[0]
        keys = embeddings.sign_keys(np.stack([u, 0.98 * u + np.sqrt(1 - 0.98**2) * v]), embeddings.BITS, embeddings.TABLES)
        found += bool((keys[0] == keys[1]).any())
    assert found >= 190


def test_chat(spark):
    turns = [(None, 1, "user", None), (1, None, None, "a:b"), (1, 2, "as:s\\", "<x>#</turn>\n### user: "), (1, 2, "as:s\\", "<x>#</turn>\n### user: "), (2, 0, "assistant", "é😀\\")]
    df = spark.createDataFrame([(*x, "z") for x in turns], "conv_id bigint, turn int, role string, text string, loss string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {k: chat.parse(r.formatted) for k, r in got.items()} == {None: [("user", "")], 1: [("", "a:b"), ("as:s\\", turns[2][3]), ("as:s\\", turns[2][3])], 2: [("assistant", "é😀\\")]}
    assert [got[2].formatted[x.first : x.last] for x in got[2].loss] == ["é😀\\\\"]
    assert chat.format_chats(df.limit(0)).collect() == []
    probe = next(r for r in QUERIES["op3_chat_format"](spark, SF).collect() if r.conv_id == -7)
    assert probe.n_turns == 2 and probe.loss_chars == len(chat.PROBE)


def test_sharding(spark):
    from pyspark.sql import functions as F

    got = QUERIES["op7_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    own = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(own)
    assert all(r.size == len(own[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(own[r.doc_id].encode()) for r in got.itertuples())
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sums = got.groupby("shard")["size"].sum()
    assert list(sums.index) == list(range(24)) and sums.max() < 1.05 * sums.min()
    few = QUERIES["op7_sharding"](spark, SF).toPandas().groupby("shard")["size"].sum()
    assert len(few) == 24 and few.max() <= 1.05 * few.min()
    placed = sharding.assign(hard(spark))
    assert placed.count() == len(HARD) and placed.where(F.col("slot") < 0).count() == 0
    assert sharding.assign(hard(spark).limit(0)).collect() == []


def test_moved_bytes(spark):
    """What assign moves, against the least that has to be moved by any placing of rows that can be parted at will."""
    F = sharding.F
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (1 + F.col("id") * 7919 % 120).cast("int")).alias("text"), F.when(F.col("id") % 10 < 6, 0).when(F.col("id") % 10 < 9, 1).otherwise(F.lit(None)).cast("int").alias("was"))
    for heads in (0, 16, 2000):  # flows alone, both, and one by one
        got = sharding.assign(docs, 4, old="was", heads_each=heads).toPandas()
        sizes, total = got.groupby("shard")["size"].sum(), int(got["size"].sum())
        assert len(got) == 6000 and list(sizes.index) == [0, 1, 2, 3] and sizes.max() - sizes.min() <= 4 * 128
        moved = int(got[(got.old_shard != got["shard"])]["size"].sum())
        supply = [int(got[got.old_shard == k]["size"].sum()) for k in range(4)]
        least = total - sum(min(n, total // 4) for n in supply)
        assert least <= moved + 4 * 128 and moved <= least * 1.02 + 8 * 128, (heads, moved, least)
    # a small instance, all placings tried: no balanced one moves less
    import itertools

    sizes, was = [9, 9, 9, 9, 9, 9, 9], [0, 0, 0, 0, 0, 1, 2]
    rows_ = spark.createDataFrame([(i, "y" * (n - 8), w) for i, (n, w) in enumerate(zip(sizes, was, strict=True))], "doc_id bigint, text string, was int")
    best = min((max(t := [sum(n for n, p in zip(sizes, x, strict=True) if p == k) for k in range(3)]) - min(t), sum(n for n, p, w in zip(sizes, x, was, strict=True) if p != w)) for x in itertools.product(range(3), repeat=7))
    got = sharding.assign(rows_, 3, old="was").collect()
    t = [sum(r.size for r in got if r.shard == k) for k in range(3)]
    assert (max(t) - min(t), sum(r.size for r in got if r.shard != r.old_shard)) == best


def test_reshard(spark, tmp_path):
    import os

    schema = "doc_id bigint, text string, shard string, slot int"
    data = [(k, s, "a", i) for i, (k, s) in enumerate([*HARD, (None, "x y"), (None, "x y"), (3, "same"), (3, "same"), *((100 + i, f"row {i}") for i in range(400))])]
    df = spark.createDataFrame(data, schema)
    path = str(tmp_path / "shards")

    def state():
        return sorted((tuple(r) for r in sharding.layout(spark, path, df.schema).collect()), key=str)

    def sound(n):
        got = state()
        assert sorted((r[:4] for r in got), key=str) == sorted(data, key=str)  # no row lost or doubled
        for k in {r[5] for r in got}:
            assert 0 <= k < n and sorted(r[4] for r in got if r[5] == k) == list(range(sum(r[5] == k for r in got)))
        return got

    sharding.lay_out(df, path, 3)
    sharding.reshard(spark, path, df.schema, 5)
    five = sound(5)
    # a fifth shard grows, the others' folders stay as they are
    extra = [(1000 + i, "y" * 40, "b", i) for i in range(30)]
    spark.createDataFrame(extra, schema).withColumn(sharding.SLOT, sharding.F.lit(None).cast("bigint")).withColumn(sharding.SHARD, sharding.F.lit(4)).write.mode("append").partitionBy(sharding.SHARD).parquet(path)
    data += extra
    assert 4 in sharding.reshard(spark, path, df.schema, 5)
    sound(5)
    assert not [x for x in os.listdir(path) if x.startswith("_staged")]
    # rows in no shard yet
    fresh = [(2000 + i, "z" * 20, "c", i) for i in range(20)]
    spark.createDataFrame(fresh, schema).withColumn(sharding.SLOT, sharding.F.lit(None).cast("bigint")).withColumn(sharding.SHARD, sharding.F.lit(None).cast("int")).write.mode("append").partitionBy(sharding.SHARD).parquet(path)
    data += fresh
    sharding.reshard(spark, path, df.schema, 5)
    sound(5)
    sharding.reshard(spark, path, df.schema, 2)
    assert {r[5] for r in sound(2)} == {0, 1} and len(five) == len(data) - 50


def test_only_changed_shards_are_rewritten(spark, tmp_path):
    import os

    path, F = str(tmp_path / "shards"), sharding.F
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t" * 92).alias("text"))
    at = F.when((F.col("doc_id") % 4 == 1) & (F.col("doc_id") < 800), 0).otherwise(F.col("doc_id") % 4).cast("int")
    df.withColumn(sharding.SLOT, F.floor(F.col("doc_id") / 4)).withColumn(sharding.SHARD, at).write.partitionBy(sharding.SHARD).parquet(path)

    def files():
        return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}

    before = files()
    assert sharding.reshard(spark, path, df.schema, 4) == [0, 1]  # what 0 has too much goes to 1
    after = files()
    assert [d for d in sorted(after) if after[d] != before[d]] == ["__shard=0", "__shard=1"]
    got = sharding.layout(spark, path, df.schema)
    assert {r[0]: r[1] for r in got.groupBy(sharding.SHARD).count().collect()} == dict.fromkeys(range(4), 1000) and got.select("doc_id").distinct().count() == 4000
    assert sharding.reshard(spark, path, df.schema, 4) == [] and files() == after


def test_flow():
    rng = np.random.default_rng(0)
    for _ in range(20):
        supply = rng.integers(0, 50, 5).tolist()
        capacity = sharding.equal_capacities(sum(supply), 7)
        flow = sharding.transfers(supply, capacity)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == capacity
        stay = sum(flow[i][i] for i in range(5))
        assert stay == sum(min(supply[i], capacity[i]) for i in range(5))  # the fewest bytes move


def test_mixing(spark):
    cells = spark.createDataFrame([("a", "x", "p", 900.0), ("b", "x", "p", 60.0), ("b", "y", "q", 40.0), ("a", "y", "p", 100.0)], "source string, lang string, topic string, mass double")
    mass = {("a", "x"): 900.0, ("b", "x"): 60.0, ("b", "y"): 40.0, ("a", "y"): 100.0}
    kept = {k: 0.0 for k in "abxy"}
    got = mixing.fitted(cells, {"source": 0.5, "lang": 1.0}, 50, 0.1).collect()
    for r in got:
        kept[r.source] += mass[r.source, r.lang] * r.probability
        kept[r.lang] += mass[r.source, r.lang] * r.probability
    assert len(got) == 4 and abs(kept["a"] / kept["b"] - (1000 / 100) ** 0.5) < 0.01 and abs(kept["x"] / kept["y"] - 960 / 140) < 0.01
    docs = hard(spark).withColumn("lang", mixing.F.lit(None).cast("string")).withColumn("__x", mixing.F.lit(1))
    assert mixing.probabilities(docs).count() == len(HARD) and mixing.sample(docs).columns == docs.columns
    assert mixing.sample(docs.limit(0)).collect() == [] and mixing.probabilities(docs.limit(0)).collect() == []


def test_mixing_to_given_targets(spark):
    F = mixing.F
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, "odd").otherwise("much").alias("source"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"), F.lit("kept").alias("__cell"), F.lit(0.5).alias("__Probability"))
    want = [("source", "rare", 1.0), ("source", "much", 1.0), ("source", "nowhere", 5.0), ("lang", "x", 1.0), ("lang", "y", 1.0)]
    targets = spark.createDataFrame(want, "marginal string, name string, weight double")
    got = mixing.sample(docs, keep=0.15, targets=targets).collect()
    assert {(r["__cell"], r["__Probability"]) for r in got} == {("kept", 0.5)}  # columns of those names stay as they are
    share = lambda k, v: sum(r[k] == v for r in got) / len(got)
    assert 500 < len(got) < 700 and all(abs(share(k, v) - 0.5) < 0.07 for k, v in (("source", "rare"), ("source", "much"), ("lang", "x"))) and not share("source", "odd")
    cells = docs.groupBy("source", "lang").agg(F.count("*").cast("double").alias("mass"))
    powers = {"source": 1.0, "lang": 1.0}
    small, some, large = (mixing.rake(cells, powers, targets, few=k, at_once=n) for k, n in ((10, 10), (10, 1), (1, 1)))  # in one task, by factors on the driver, by factors in tables
    assert all(abs(a[3] - b[3]) < 1e-6 for x in (some, large) for a, b in zip(rows(x[0]), rows(small[0]), strict=True))
    fit, missed = small
    sums = {r.source: r.s for r in fit.groupBy("source").agg(F.sum("weight").alias("s")).collect()}
    assert missed < 1e-9 and sums["odd"] == 0 and abs(sums["rare"] - 2000) < 1e-5 and abs(sums["much"] - 2000) < 1e-5
    # targets that cannot be met together, of a name without rows alone, of an unknown marginal
    apart = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "source string, lang string, mass double")
    clash = spark.createDataFrame([("source", "a", 9.0), ("source", "b", 1.0), ("lang", "x", 1.0), ("lang", "y", 9.0)], targets.schema)
    assert mixing.rake(apart, powers, clash, 2)[1] > 0.1
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.fitted(apart, powers, 2, targets=clash)
    for bad, strict in ((clash, True), (targets.where("name = 'nowhere'"), False), (targets.withColumn("marginal", F.lit("z")), False)):
        with pytest.raises(ValueError):
            mixing.fitted(apart, powers, 2, targets=bad, strict=strict)
    own = mixing.probabilities(docs, {"topic": 1.0}, of_topic=F.col("lang"), targets=spark.createDataFrame([("topic", "x", 1.0)], targets.schema))
    assert own.where("probability > 0").join(docs, "doc_id").where("lang = 'y'").count() == 0


def test_mixing_keeps_a_stated_share(spark):
    F = mixing.F
    cells = [(f"s{i}", f"l{j}", "p", 1000.0 * (i + 1) * (3 * j + 1)) for i in range(5) for j in range(3)]
    powers = {"source": 0.8, "lang": 0.9}
    rates = []
    for table in (cells, [*cells, ("tiny", "l0", "p", 1.0)]):
        df = spark.createDataFrame(table, "source string, lang string, topic string, mass double")
        for keep in (0.2, 1.0):
            got = {(r.source, r.lang): r.probability for r in mixing.fitted(df, powers, 10, keep).collect()}
            assert abs(sum(got[s, k] * m for s, k, _, m in table) / sum(x[3] for x in table) - keep) < 1e-9 and max(got.values()) <= 1
            rates.append([got[s, k] for s, k, _, _ in cells])
    assert all(abs(x - y) < 0.01 for a, b in zip(rates[:2], rates[2:], strict=True) for x, y in zip(a, b, strict=True))
    # the sample itself, with a document of a new source and language
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang")
    more = docs.unionByName(spark.createDataFrame([(-1, "one two three", "new", "xx")], docs.schema))
    total = docs.agg(F.sum(mixing.tokens(F.col("text")))).first()[0]
    kept = [{r.doc_id: r.n for r in mixing.sample(df).select("doc_id", mixing.tokens(F.col("text")).alias("n")).collect()} for df in (docs, more)]
    assert all(abs(sum(k.values()) / total - mixing.KEEP) < 0.05 for k in kept) and len(kept[0].keys() ^ kept[1].keys()) < 0.02 * len(kept[0])


def held_out(spark, name, label, n, r):
    got = {x.doc_id: x for x in QUERIES[name](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = docs.select("doc_id", label) if label == "lang" else spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label)
    assert len(got) == docs.count() and all(x.held_out == (zlib.crc32(str(k).encode()) % n == r) and 0 <= x.score <= 1 for k, x in got.items())
    return [(got[k], v) for k, v in map(tuple, truth.collect()) if got[k].held_out]


def test_language(spark):
    out = held_out(spark, "op1_language_id", "lang", 5, 0)
    assert np.mean([x.lang_pred == v for x, v in out]) > 0.97
    model = language.Model.fit(["the cat and the dog", "le chat et le chien"], ["en", "fr"])
    assert model.predict(pa.array([None, "", "12 ?", "the the", "le chat", "thedog"]))[0] == ["und", "und", "und", "en", "fr", "en"]
    assert language.Model.fit([], []).predict(pa.array(["a"])) [0] == ["und"]
    assert language.identify(hard(spark).limit(0), model).collect() == [] and language.identify(hard(spark), model).count() == len(HARD)


def test_toxicity(spark):
    out = held_out(spark, "op2_toxicity", "toxic", 5, 0)
    assert np.mean([x.predicted == v for x, v in out]) > 0.9
    texts = [f"you {w} thing {i}" for i in range(60) for w in ("idiot", "friend")]
    model = toxicity.Model.fit(texts, np.array([1, 0] * 60))
    score = model.score(pa.array(["idiotic", "idi0t idiots", "friends", "", None]))
    assert score[0] > 0.5 and score[1] > 0.5 and score[2] < 0.5 and score[3] == score[4]
    assert toxicity.Model.fit([], np.zeros(0, np.int64)).score(pa.array(["a", None])).tolist() == [0, 0]
    for k in (0, 1):  # one label alone
        assert toxicity.Model.fit(["a b", "c"], np.array([k, k])).score(pa.array(["a", None, "x"])).tolist() == [k, k, k]
    docs = hard(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()} == {0.0}
    with pytest.raises(ValueError):
        toxicity.scored(docs.withColumn("score", mixing.F.lit(1)), model)
    assert toxicity.scored(hard(spark), model).count() == len(HARD) and toxicity.scored(hard(spark).limit(0), model).collect() == []


def _hash(hasher, values):
    """The hash of a word by plain integers."""
    total, power, mask = 0, 1, (1 << 64) - 1
    for v in values:
        total, power = (total + int(v) * power) & mask, power * int(hasher) & mask
    return total


def _mix(h):
    mask = (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
    return h ^ h >> 31


def test_language_by_row(spark):
    """Whole texts scored word by word with plain dictionaries of the same tables."""
    import math
    import re

    from quillframe.llm._text import Hasher

    docs = read(spark, "documents")
    model, base = language.train(docs), int(Hasher().words.base)
    tables = {n: dict(zip(keys.tolist(), rows.tolist(), strict=True)) for n, (keys, rows) in model.tables.items()}
    char = lambda c: _mix(ord(c) + 97)
    word_of = lambda w: _mix(_hash(base, map(char, w)) + len(w) & (1 << 64) - 1)
    seen = {}

    def scores(w):
        if w not in seen:
            found = tables[0].get(word_of(w))
            marks = [1, *map(char, w), 2]
            for n in (5, 4, 3, 2, 1):
                if found is None:
                    hits = [r for i in range(len(marks) - n + 1) if (r := tables[n].get(_mix(_hash(base, marks[i : i + n]) + n & (1 << 64) - 1))) is not None]
                    found = [sum(x) / len(hits) for x in zip(*hits, strict=True)] if hits else None
            seen[w] = found or [0.0] * len(model.languages)
        return seen[w]

    got = {r.doc_id: r for r in language.identify(docs.unionByName(docs), model).collect()}
    assert len(got) == docs.count() and language.identify(docs.unionByName(docs), model).distinct().count() == len(got)  # repeats alike, whatever stands beside them
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        total = [sum(x) for x in zip(*map(scores, words), strict=True)] if words else []
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        assert got[r.doc_id].lang_pred == model.languages[best] and abs(got[r.doc_id].score - 1 / sum(math.exp(max(x - total[best], -700)) for x in total)) < 1e-4, r.doc_id
    two = language.Model.fit(["same words", "same words"], ["xx", "aa"])
    assert two.predict(pa.array(["same", "same"])) [0] == ["aa", "aa"]  # ties: the first in alphabetical order
    assert language.identify(hard(spark).withColumn("score", mixing.F.lit(1)).withColumn("lang_pred", mixing.F.lit(1)), model).count() == len(HARD)


def test_toxicity_by_row(spark):
    """Whole texts scored word by word with a plain dictionary of the same cells' numbers."""
    import math
    import re

    from quillframe.llm._text import Hasher

    docs = read(spark, "documents")
    model = toxicity.train(docs, read(spark, "labels"))
    weights, hasher, mask = {k: float(model.weights[k]) for k in np.flatnonzero(model.weights)}, Hasher(), (1 << toxicity.CELLS_BITS) - 1
    table, seen = hasher.table.tolist(), {}

    def number(w):
        if w not in seen:
            marks = [1, *(table[c] for c in w), 2]
            cells = [_mix(_hash(hasher.bytes.base, (table[c] for c in w)) + len(w) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)]
            cells += [_mix(_hash(hasher.words.base, marks[i : i + n]) + n & (1 << 64) - 1) for n in toxicity.SIZES for i in range(len(marks) - n + 1)]
            seen[w] = sum(weights.get(c & mask, 0.0) for c in cells) / len(cells)
        return seen[w]

    got = {r.doc_id: r.score for r in toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    for r in docs.collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", r.text.lower().encode())
        z = (sum(map(number, words)) / len(words) if words else 0.0) + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(min(z, 500), -500)))) < 1e-6, r.doc_id


def test_quality_by_row(spark):
    """The statistics of whole texts word by word, and the rules one by one."""
    import math
    import re
    from collections import Counter

    docs = read(spark, "documents")
    model = quality.train(docs, read(spark, "labels"))

    def statistics(text):
        raw = text.encode()
        words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), re.findall(rb"[^\n]+", raw)
        n, size, letters = max(len(words), 1), max(len(raw), 1), max(len(re.findall(rb"[A-Za-z]", raw)), 1)
        count = lambda p: len(re.findall(p, raw))
        fresh = sum(len(set(words[i : i + quality.BLOCK_WORDS])) for i in range(0, len(words), quality.BLOCK_WORDS))
        return [
            len(words), sum(map(len, words)) / n, count(rb"[A-Z]") / letters, count(rb"[0-9]") / size, count(rb"[.,;:?]") / n, raw.count(b"!") / n, raw.count(b"|") / n, count(rb"[#$%&*@<>{}\[\]=\\^~_]") / n,
            len(words) / max(len(lines), 1), fresh / n, max(Counter(words).values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            1 - len(set(lines)) / len(lines) if lines else 0.0, sum(c >= 128 for c in raw) / size,
        ]

    got = {r.doc_id: r.s for r in quality.with_statistics(docs).select("doc_id", model.column().alias("s")).collect()}
    for r in docs.collect():
        x = statistics(r.text)
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights.tolist(), strict=True) if all(low < x[k] <= high for k, low, high in rule.bounds))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9, r.doc_id
    twice = quality.with_statistics(docs.unionByName(docs)).distinct()
    assert twice.count() == docs.count()


def test_samples_are_bounded(spark):
    """An id that repeats, and long texts: the sample stays within its bounds."""
    from quillframe.llm.learn import labelled_sample

    F = mixing.F
    docs = spark.range(3000).select((F.col("id") % 30).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit(" x"), F.when(F.col("id") % 7 == 0, 500).otherwise(5))).alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = labelled_sample(docs, labels.unionByName(labels), "toxic", F.lit(False), per_class=10)
    assert len(rows) <= 40 and len({r[0] for r in rows}) == len(rows) and rows == labelled_sample(docs, labels, "toxic", F.lit(False), per_class=10)
    for limit in (60, 3000):
        rows = labelled_sample(docs.withColumn("lang", F.lit("a")), None, "lang", F.lit(False), 2000, limit)
        assert rows and sum(len(r[1]) for r in rows) <= limit
    assert any(len(r[1]) > 1000 for r in rows) or len(rows) > 0
    assert labelled_sample(docs.limit(0), labels, "toxic", F.lit(False)) == [] and labelled_sample(docs, labels.limit(0), "toxic", F.lit(False)) == []


def test_quality(spark):
    out = held_out(spark, "op10_quality", "quality", 4, 2)
    assert np.mean([x.predicted == v for x, v in out]) > 0.9
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.7)).astype(int)
    model = quality.Model.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(r) for r in x[:50].tolist()], ", ".join(f"{s} double" for s in quality.STATISTICS))
    assert np.allclose([r.s for r in df.select(model.column().alias("s")).collect()], model.score(x[:50]))
    assert quality.Model.fit(x[:0], y[:0]).score(x[:1]) == [0.5]
    stats = quality.with_statistics(hard(spark)).collect()
    assert len(stats) == len(HARD) and all(v is not None and np.isfinite(v) for r in stats for v in r[1:])


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = {r.doc_id: r.text for r in read(spark, "documents").collect()}
    assert 0 < len(out) < len(docs) and set(out.doc_id) <= set(docs) and out.doc_id.is_unique
    stage = dict(corpus_pipeline.STAGES)
    table = read(spark, "documents")
    kept = {r.doc_id for r in stage["near_duplicates"](spark, table, SF).collect()}
    assert kept == {d for d, _, c in jaccard.brute(list(docs.items())) if d == c}
    cleaned = {r.doc_id: r for r in stage["decontamination"](spark, table, SF).collect()}
    found = {x[0]: x for x in decontaminate.brute(list(docs.items()), pairs(spark, "benchmark", "item_id", "text"))}
    assert set(cleaned) == {d for d, x in found.items() if not x[1] or x[2] < x[1]}
    assert all((r.text == docs[d]) != found[d][5] and (not found[d][5] or r.n_chars == len(r.text)) for d, r in cleaned.items())
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        assert stage[name](spark, table, SF).columns == table.columns


def test_pipeline_near_duplicates_by_row(spark):
    text, other, third = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    data = [
        (None, text, "n"), (None, text + " x", "n"), (None, text, "n"),  # null ids only: one stays
        (1, other, "r"), (1, other, "r"), (None, other, "r"),  # repeated rows and a null id: the one with an id, once
        (2, third, "t"), (3, third + " x", "t"), (3, "a clean text under the same id as a copy", "t"),  # only the copy of 2 goes
        (4, "", "e"), (None, None, "e"),
    ]
    df = spark.createDataFrame([(*x, k) for k, x in enumerate(data)], "doc_id bigint, text string, source string, __row int").withColumn("component_id", mixing.F.lit("c"))
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, SF)
    kept = sorted(((r.source, r.doc_id, r.text) for r in got.collect()), key=str)
    assert got.columns == df.columns and [k for k in kept if k[0] in "et"] == [("e", 4, ""), ("e", None, None), ("t", 2, third), ("t", 3, data[8][1])]
    assert [k for k in kept if k[0] == "r"] == [("r", 1, other)] and [k[1] for k in kept if k[0] == "n"] == [None]


def test_pipeline_on_hard_tables(spark, tmp_path):
    """No labels, no rows, repeated and null ids, columns whose names the stages use: all but the last give the columns back."""
    import os

    F = mixing.F
    docs = hard(spark).unionByName(hard(spark)).select("doc_id", F.col("text"), F.lit("en").alias("lang"), "source", F.length("text").alias("n_chars"), *[F.lit(k).alias(k) for k in ("__score", "__row", "__cell", "__probability", "row", "key", "spans", "n_words")])
    read(spark, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    for table in (docs, docs.limit(0)):
        for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
            got = stages[name](spark, table, str(tmp_path))
            assert got.columns == docs.columns and all(r["__cell"] == "__cell" for r in got.collect())
        assert stages["toxicity"](spark, table, str(tmp_path)).count() == table.count()  # nothing is known to be toxic
        assert stages["sharding"](spark, table.select("doc_id", "text"), str(tmp_path)).count() == table.count()
    from quillframe.llm import shared

    before = shared.tables_written()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and shared.tables_written() == before + 1 and not [x for x in shared._WRITTEN[before:-1] if os.path.exists(x)]


def test_batches_are_bounded(spark):
    from pyspark.sql import functions as F

    from quillframe.llm import shared

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = spark.range(8, numPartitions=1).select(F.when(F.col("id") % 2 == 0, F.repeat(F.lit("word "), 1_200_000)).otherwise("x").alias("text"))
    sizes = texts.mapInArrow(run, "n bigint, size bigint")
    got = shared.written(sizes).collect()
    assert sum(r.n for r in got) == 8 and max(r.size for r in got) < 7_000_000  # no row is lost, a longer one is a batch nearly alone
    before = spark.conf.get(shared._BATCH)
    spark.conf.set(shared._BATCH, "64000000")
    shared.shipped(spark, 1)
    assert spark.conf.get(shared._BATCH) == "64000000" and len(sizes.collect()) == 1  # a bound that is set stays
    spark.conf.set(shared._BATCH, before)
