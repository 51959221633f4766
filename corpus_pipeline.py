"""A corpus pipeline in stages; each is written and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import decontaminate, jaccard, mixing, sharding
from quillframe.llm import toxicity as toxic
from quillframe.llm.mixing import free_name
from quillframe.llm.shared import release, tables_written, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Without any labelled document nothing is known to be toxic, and all stay."""
    model, score = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name("__score", docs.columns)
    return toxic.scored(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the least doc_id; so does a row in no group.

    Rows are told apart by a number of their own, not by doc_id: rows with a null id are compared like others and stay only if
    none of their group has an id (then one does); of repeated rows one stays; of two texts under one id only that goes which
    is a near copy of another row that stays. Texts without any word are copies of nothing and all stay.
    """
    row = free_name("__row", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = jaccard.near_duplicates(rows.select(row, "text"), row).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text", F.col(row).alias("row")))
    kept = rows.select(row, "doc_id", F.xxhash64("text").alias("text")).join(groups, row).groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that hold a window of ten words of the benchmark are cut out; a document that is nothing else goes."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities fitted to targets of source, language and topic."""
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.resharded(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes when the next one's is written, the last one when the driver ends."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = tables_written()
    for _, stage in STAGES:
        out = written(stage(spark, out, sf_dir))
        release(spark, start, last=True)
    return out
