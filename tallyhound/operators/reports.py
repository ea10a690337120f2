"""Dashboard, productivity and customer reports over derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import text
from tallyhound.refs import inline
from tallyhound.schemas import DISPOSITIONS

# Disposed alerts a rule needs before its quality is reported, and the columns of the
# customer views below.
MIN_SAMPLE = 20


# --- dashboard -------------------------------------------------------------

def count_by(df: DataFrame, column: str, domain: list[str] | None = None, out: str = "n") -> DataFrame:
    """Rows per value. With a domain, every listed value appears, counted 0 if absent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(out))
    if domain is None:
        return counts
    listed = inline(df.sparkSession, [(v,) for v in domain], [column])
    return listed.join(counts, column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def count_by_rule(alerts: DataFrame) -> DataFrame:
    return count_by(alerts, "rule_code").orderBy(F.desc("n"), "rule_code")


def totals(**tables: DataFrame) -> DataFrame:
    """One row with the size of each table."""
    return _side_by_side([df.agg(F.count(F.lit(1)).alias(name)) for name, df in tables.items()])


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row results with different columns as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def heatmap(alerts: DataFrame) -> DataFrame:
    """Peak score and count per customer and typology."""
    return alerts.groupBy("customer_id", "typology").agg(
        F.max("risk_score").alias("peak_risk_score"), F.count(F.lit(1)).alias("alert_count"))


def heatmap_grid(alerts: DataFrame, typologies: list[str], top: int = 25) -> DataFrame:
    """The riskiest customers against all typologies; empty cells are null."""
    wide = alerts.groupBy("customer_id").agg(
        *[F.max(F.when(F.col("typology") == t, F.col("risk_score"))).alias(t.lower()) for t in sorted(typologies)],
        F.max("risk_score").alias("peak"))
    return wide.orderBy(F.desc("peak"), "customer_id").limit(top)


# --- productivity ----------------------------------------------------------

def disposition_records(alerts: DataFrame) -> DataFrame:
    return alerts.where("disposition is not null").select(
        "rule_code", "disposition", "first_detected_at", "disposed_at")


def _half_up(value: Column, places: int = 2) -> Column:
    return F.floor(value * 10 ** places + 0.5) / 10 ** places


def percentage(part: Column, whole: Column) -> Column:
    """Two places; unknown (null) over nothing."""
    return F.when(whole > 0, F.floor(part * 10000.0 / whole + 0.5) / 100.0)


def disposition_hours(records: DataFrame) -> DataFrame:
    """Mean and exact median hours to disposition.

    Times are whole minutes. They are counted per minute value first, so both
    figures come from one row per distinct duration.
    """
    seconds = F.unix_micros(F.col("disposed_at").cast("timestamp")) - F.unix_micros(F.col("first_detected_at").cast("timestamp"))
    minutes = F.call_function("div", seconds, F.lit(60_000_000))
    counted = records.select(minutes.alias("minutes")).where("minutes >= 0").groupBy("minutes").agg(
        F.count(F.lit(1)).alias("n"))
    hours = F.col("minutes") / 60.0
    return counted.agg(
        _half_up(F.sum(hours * F.col("n")) / F.sum("n")).alias("mean_hours"),
        _half_up(F.percentile(hours, 0.5, F.col("n"))).alias("median_hours"))


def quality_by_rule(records: DataFrame) -> DataFrame:
    """False-positive rate per rule, noisiest first; too small a sample has no rate."""
    enough = F.col("disposed") >= MIN_SAMPLE
    return (
        records.groupBy("rule_code").agg(
            F.count(F.lit(1)).alias("disposed"),
            F.count_if(F.col("disposition") == "FALSE_POSITIVE").alias("false_positives"))
        .withColumn("false_positive_rate_pct", F.when(enough, percentage(F.col("false_positives"), F.col("disposed"))))
        .withColumn("sufficient_sample", enough)
        .orderBy(F.desc_nulls_last("false_positive_rate_pct"), F.desc("disposed"), "rule_code"))


def trend_days(days: int | None) -> int:
    return 90 if days is None else min(max(days, 1), 365)


def daily_alerts(alerts: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """New alerts per UTC day over the horizon, oldest first; empty days are absent."""
    start = as_of - F.make_dt_interval(days=F.lit(trend_days(days)))
    return alerts.where(F.col("first_detected_at") >= start).groupBy(F.to_date("first_detected_at").alias("day")).agg(
        F.count(F.lit(1)).alias("alerts")).orderBy("day")


def disposition_breakdown(records: DataFrame) -> DataFrame:
    return count_by(records, "disposition", DISPOSITIONS)


def productivity(alerts: DataFrame) -> DataFrame:
    """Headline figures in one row."""
    records = disposition_records(alerts)
    counts = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count("disposition").alias("disposed_alerts"),
        F.count_if(F.col("status") == "OPEN").alias("open_alerts"),
        percentage(F.count_if(F.col("disposition") == "FALSE_POSITIVE"), F.count("disposition")).alias("false_positive_rate_pct"),
        F.count_if(F.col("disposition") == "ESCALATED_TO_SAR").alias("sar_count"))
    return _side_by_side([counts, disposition_hours(records)])


# --- customers -------------------------------------------------------------

def masked_customers(customers: DataFrame) -> DataFrame:
    name = text.full_name(F.col("first_name"), F.col("last_name"))
    return customers.select(
        "customer_id", text.mask_name(name).alias("name_masked"), text.mask_identifier(F.col("national_id")).alias("national_id_masked"),
        text.mask_email(F.col("email")).alias("email_masked"), text.mask_phone(F.col("phone_number")).alias("phone_masked"),
        "city", "country", "customer_segment", "kyc_status", "risk_rating",
        F.col("is_politically_exposed").alias("politically_exposed"))


def full_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "first_name", "last_name", text.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        "national_id", "email", "phone_number", "date_of_birth", "gender", "city", "state", "country", "postal_code",
        "occupation", "annual_income", "employment_status", "customer_since", "customer_segment", "kyc_status",
        "risk_rating", F.col("is_politically_exposed").alias("politically_exposed"), "num_complaints_last_year")


def customers_by_rating(customers: DataFrame, ratings: list[str]) -> DataFrame:
    return customers.where(F.col("risk_rating").isin(ratings))
