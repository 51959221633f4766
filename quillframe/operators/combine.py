"""Verbs over a table of records in file order, given by a numbering column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def first(df: DataFrame, order: str, where: Column | None = None) -> DataFrame:
    """A table of the first record, or of none."""
    return (df if where is None else df.where(where)).orderBy(order).limit(1)


def first_or_fail(df: DataFrame, order: str, where: Column | None = None) -> Row:
    row = first(df, order, where).first()
    if row is None:
        raise LookupError("no record")
    return row


def single(df: DataFrame, where: Column | None = None, default: bool = False) -> Row | None:
    rows = (df if where is None else df.where(where)).limit(2).collect()
    if len(rows) == 2:
        raise LookupError("more than one record")
    if not rows and not default:
        raise LookupError("no record")
    return rows[0] if rows else None


def quantifiers(df: DataFrame, where: Column) -> DataFrame:
    """n, any and all of a predicate; all holds for no records."""
    return df.agg(F.count_if(where).alias("n"), F.coalesce(F.bool_or(where), F.lit(False)).alias("any"), F.coalesce(F.bool_and(where), F.lit(True)).alias("all"))


def skip(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).offset(n)


def take(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def dictionary(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value), one row a key; a key that comes up twice, or a null one, fails the query."""
    grouped = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.first(value).alias("value"))
    failed = F.raise_error(F.concat(F.lit("key in use: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
    return grouped.select(F.when((F.col("n") == 1) & F.col("key").isNotNull(), F.col("key")).otherwise(failed.cast(dict(grouped.dtypes)["key"])).alias("key"), "value")


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def group_lists(df: DataFrame, key: Column, value: Column, order: str) -> DataFrame:
    """(key, values in file order)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("value"))))
    return df.groupBy(key.alias("key")).agg(F.transform(pairs, lambda x: x["value"]).alias("values"))


def numbered(df: DataFrame, order: str, name: str = "row_number", parts: int | None = None) -> DataFrame:
    """Numbers the rows from 1 by ``order`` (unique), without one task for all: ranges are numbered apart, then moved up.

    The ranges are written once, as their borders are sampled anew whenever they are worked out."""
    ranged = df.repartitionByRange(parts, order) if parts else df.repartitionByRange(order)
    placed = written(ranged.sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))  # the range above, the place below 33 bits
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before")))  # a row for each range
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_id", "_before")


def batches(df: DataFrame, order: str, size: int, value: Column) -> DataFrame:
    """(batch, n, values): lists of a fixed size in file order, the last one shorter; ``order`` numbers the rows from 1."""
    if size <= 0:
        raise ValueError("size must be over 0")
    return group_lists(df.withColumn("_batch", F.floor((F.col(order) - 1) / size)), F.col("_batch"), value, order).select(F.col("key").alias("batch"), F.size("values").alias("n"), "values")


def for_each(df: DataFrame, action: Callable[[Row], None]) -> None:
    df.foreach(action)
