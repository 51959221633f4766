"""Tables that cut lineage, and a count sketch of word sequences."""

from __future__ import annotations

import atexit
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset in a local session, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints/quillframe"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder; ``release`` drops what is there, at the latest when the driver ends."""
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(f"{shared_dir(spark)}/quillframe-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


#: Whether an execution's shuffle files go when it ends, and the bytes of a batch for Python.
_DROP_SHUFFLES, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """A session that does not bound the bytes of a batch for Python gets a bound of 4 MB (or one row) and keeps it, as plans run later:
    10,000 long texts in one batch would be held by the JVM and by Python at once."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(4 << 20))


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again. The write's shuffle files go as soon as the table stands, not when
    the driver happens to collect garbage."""
    spark = df.sparkSession
    path, before = folder(spark), spark.conf.get(_DROP_SHUFFLES, "false")
    bound_batches(spark)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    return len(_WRITTEN)


def release(spark: SparkSession, but: int = 0, last: bool = False) -> None:
    """Drops the tables of ``written`` but the first ones, and but the last where that is what was made of them."""
    kept = [_WRITTEN.pop()] if last and len(_WRITTEN) > but else []
    while len(_WRITTEN) > but:
        path = _WRITTEN.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            return
    _WRITTEN.extend(kept)


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A value of checked size for the executors: broadcast as bytes that bring their classes along. Its ``held`` can be destroyed after use."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        return pickle.loads(held.value)

    get.held = held
    return get


#: Cells of the sketch: its size does not grow with the input.
CELLS_BITS = 18
_BLOCKS = 256


def gram_sketch(texts: DataFrame, text: str, n: int, lower: bool) -> np.ndarray:
    """How many n-word sequences of all texts fall into each of 2**CELLS_BITS cells (by their hash's low bits)."""
    cells = 1 << CELLS_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (ws, _, low) = t.Hasher(), t.byte_classes()
        total = np.zeros(cells, np.int64)
        for b in batches:
            data, offsets = t.text_buffers(b.column(0))
            for i, j in t.steps(offsets):
                part = data[offsets[i] : offsets[j]]
                part = low[part] if lower else part
                starts, ends, at = t.word_ranges(part, offsets[i : j + 1] - offsets[i], ws)
                grams = hasher.grams(hasher.ranges(part, starts, ends), n)
                total += np.bincount((grams[t.inside(at, n)] & t.U64(cells - 1)).astype(np.int64), minlength=cells)
        if total.any():
            size = cells // _BLOCKS
            narrow = total.astype("<i4") if total.max() < 1 << 31 else total.astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([narrow[k * size : (k + 1) * size].tobytes() for k in range(_BLOCKS)], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<i4" if len(raw) == 4 * cells // _BLOCKS else "<i8").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    parts = texts.select(F.col(text)).mapInArrow(count, "block int, counts binary")
    bound_batches(texts.sparkSession)
    rows = parts.repartition("block").mapInArrow(add, "block int, counts binary").collect()
    out = np.zeros((_BLOCKS, cells // _BLOCKS), np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)
