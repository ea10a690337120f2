"""Risk score expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and steps of the score model.
MAX_SCORE = 100
MAX_MAGNITUDE = 15
MAX_RECURRENCE = 12
RECURRENCE_STEP = 3
PEP_UPLIFT = 10
RATING_UPLIFT = {"LOW": 0, "MEDIUM": 7, "HIGH": 15}
BREAKDOWN_FIELDS = [
    "ruleWeight", "jurisdictionUplift", "customerRiskUplift", "pepUplift",
    "magnitudeUplift", "recurrenceUplift", "total",
]


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MAX_SCORE), c))


def rating_uplift(rating: Column) -> Column:
    """Uplift by customer rating; no customer or no rating adds nothing."""
    out = F.lit(0)
    for name, points in RATING_UPLIFT.items():
        out = F.when(rating == name, F.lit(points)).otherwise(out)
    return out


def magnitude_uplift(ratio: Column) -> Column:
    """min(15, round(5 * log2(ratio))); 0 at or below a ratio of 1."""
    steps = F.floor(F.log(ratio.cast("double")) / F.lit(math.log(2)) * 5 + 0.5)
    return F.when(ratio > 1, F.least(F.lit(MAX_MAGNITUDE), steps.cast("int"))).otherwise(0)


def recurrence_uplift(prior: Column) -> Column:
    return F.least(F.lit(MAX_RECURRENCE).cast("long"), F.greatest(prior, F.lit(0)) * RECURRENCE_STEP).cast("int")


def breakdown(weight: Column, jurisdiction: Column, rating: Column, pep: Column,
              ratio: Column, prior: Column) -> Column:
    """Struct of the six contributions and the clamped total."""
    parts = [
        F.coalesce(weight, F.lit(0)).cast("int"),
        F.greatest(F.lit(0), F.coalesce(jurisdiction, F.lit(0))).cast("int"),
        rating_uplift(rating).cast("int"),
        F.when(F.coalesce(pep, F.lit(False)), PEP_UPLIFT).otherwise(0).cast("int"),
        magnitude_uplift(ratio).cast("int"),
        recurrence_uplift(prior),
    ]
    total = clamp(sum(parts[1:], parts[0]))
    return F.struct(*[p.alias(n) for p, n in zip([*parts, total], BREAKDOWN_FIELDS)])


def breakdown_json(b: Column) -> Column:
    return F.to_json(b)


def breakdown_from_json(text: Column) -> Column:
    """Name to points; unreadable or blank text gives an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,int>")
    return F.coalesce(F.from_json(F.nullif(F.trim(text), F.lit("")), "map<string,int>"), empty)


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW"))


def noisy_or(df, keys: list[str], score: str, out: str):
    """round(100 * (1 - product(1 - s/100))) per key.

    Scores are whole numbers 0..100, so the data is first counted per (key,
    score). At most 101 rows per key remain, and the product is taken over them in
    score order: no key is gathered whole and the floating result is repeatable.
    """
    clean = clamp(F.coalesce(F.col(score), F.lit(0))).cast("int")
    counted = df.groupBy(*keys, clean.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_s", "_n"))), F.lit(1.0),
        lambda p, x: p * F.pow(F.lit(1.0) - x["_s"] / F.lit(100.0), x["_n"]))
    value = clamp(F.floor(F.lit(100) * (F.lit(1.0) - folded) + 0.5).cast("int"))
    return counted.groupBy(*keys).agg(value.alias(out), F.sum("_n").alias(f"{out}_members"))
