"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.session import shared_folder, work_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# Words are runs of anything but these ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers started from here import this package from its checkout, and send them
    texts in batches of a few megabytes, however long the texts of a row are."""
    spark.conf.set(BATCH_BYTES, "8m")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: a lineage cut that
    survives lost executors and computes `df` a single time."""
    spark = df.sparkSession
    shared_folder(spark)
    path = work_folder(spark, name)
    # The plan ends with the write, so its shuffle files may go at once.
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def whole(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`_id`, `_text` of every row; a null text is an empty one. Other columns are left
    behind, so none of theirs can clash with an operator's own."""
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`whole` plus `_key`, which tells documents apart: (id, fingerprint of the text).

    Rows that repeat both id and text are one document; rows that share an id but not
    the text, or have no id, are documents of their own.
    """
    return whole(df, id_col, text_col).withColumn("_key", F.struct(F.col("_id").alias("id"), F.xxhash64("_text").alias("h")))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the fifth of all ids that no model may learn from; a null id is not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `rows` labelled documents that are not held out: `_id`, `_text`, `_label`.

    The choice is by a hash of the id, so it is the same at every run. Ids labelled
    twice count once (the larger label), null labels and ids are left out. Of an id with several
    rows the text of least fingerprint counts, picked before and after the shuffle. The sample's
    labels are at most `rows` narrow rows, so they may be broadcast.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_lid")).agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_lid"), "_lid").limit(rows))
    d = whole(docs, id_col, text_col)
    met = d.join(F.broadcast(chosen), d["_id"] == chosen["_lid"])
    one = met.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text", "_label")).alias("r"))
    return one.select("_id", "r._text", "r._label")
