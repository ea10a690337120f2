"""Registered queries of the corpus operators: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm import hard_negatives, lattice_lm, lexical_search, license_scan, line_align, ngram_join, packing, pii, quality_model, quality_rules, suffix_index, template_decontam, toxicity
from tallyhound.llm.common import held_out, table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op7_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


@query
def op10_pattern_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op2_attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality_model.train(docs, table(spark, sf, "labels"))
    return quality_model.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages")


@query
def op4_sentence_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


@query
def op6_disguised_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan(table(spark, sf, "documents")).drop("found")


@query
def op9_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents")).select("doc_id", "class_id", "n_copies", "n_text_links", "n_links")


@query
def op3_suffix_family(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_index.remove(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_line_alignment(spark: SparkSession, sf: str) -> DataFrame:
    r = line_align.remove(table(spark, sf, "documents"))
    return r.select(
        F.col("row.doc_id"), F.size(F.split(F.coalesce("row.text", F.lit("")), "\n")).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.length("kept").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_template_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = template_decontam.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "slots", "changed")


@query
def op8_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` has no paths: source/lang/id stands in, and source/id for every fifth id."""
    path = F.concat_ws("/", "source", F.when(F.col("doc_id") % 5 != 0, F.col("lang")), F.col("doc_id").cast("string"))
    return license_scan.scan(table(spark, sf, "documents").withColumn("path", path))


@query
def op12_angular_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, label=label).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query
def op13_norm_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op11_subword_lattice(spark: SparkSession, sf: str) -> DataFrame:
    other = F.crc32(F.col("_id").cast("string").cast("binary")) % 7 == 2
    return lattice_lm.score(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), held_out=other)
