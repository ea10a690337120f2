"""The corpus pipeline: stages in order, each on all that the one before kept.

Every stage reads `documents` as the stage before left them and returns the same columns, the last one
the packing. Decisions take effect: toxic documents go, repeated blocks of lines go (and documents left
without a word by that), one document of each group of near duplicates stays, contaminated ones go.
Empty documents that were empty from the start stay, one of them, as a group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm import line_align, ngram_join, packing, template_decontam, toxicity
from tallyhound.llm.common import stored, table
from tallyhound.llm.queries import vocabulary
from tallyhound.operators.skew import checked_side

TOXIC = 0.5


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` but those whose (id, text) fingerprint is in `gone` (d)."""
    gone = checked_side(gone.select(F.col("d").alias("gd")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", _text()).alias("d"))
    return rows.join(gone, F.col("d") == F.col("gd"), "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity, learned on the documents at hand; at or above TOXIC they go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), toxicity.scorer(spark, model)(F.col("text")).alias("p"))
    return rows.where(F.col("p") < TOXIC).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks go from the later document; a document emptied by that goes altogether."""
    r = line_align.remove(docs)
    has_word = F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    r = r.where(F.col("gone").isNull() | has_word)
    changed = {"text": F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.col("kept")),
               "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))}
    return r.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by id of each class of linked documents stays."""
    found = stored(ngram_join.join(docs), "classes").select(F.col("doc_id").alias("id"), "h", "class_id", "class_h")
    gone = found.where(~(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h")))).select("id", "h").distinct().hint("merge")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64(_text()).alias("th"))
    kept = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left_anti")
    # What is left more than once are rows that repeat id and text.
    again = found.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return kept.select("row.*")
    return kept.groupBy("doc_id", "th").agg(F.min("row").alias("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go."""
    return _without(docs, template_decontam.find(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, cut into pieces and placed in sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

# Trained scores, alignments and fitted packings have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
