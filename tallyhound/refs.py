"""Reference tables: exchange rates, listed jurisdictions, watchlist, rule settings.

The bootstrap values are fixed values. Each loader returns a DataFrame, so a
deployment can read the same columns from its own tables instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.functions.text import normalise_party
from tallyhound.operators.skew import checked_side

BASE_CURRENCY = "INR"

# Currency, rate to one unit of the base currency.
FX_RATES = [
    ("INR", "1.00000000"),
    ("USD", "83.20000000"),
    ("EUR", "90.50000000"),
    ("GBP", "105.80000000"),
    ("AED", "22.65000000"),
    ("SGD", "61.90000000"),
    ("CHF", "94.10000000"),
    ("HKD", "10.65000000"),
    ("JPY", "0.55000000"),
    ("RUB", "0.92000000"),
]

# Country code, name, category, risk weight, source.
JURISDICTIONS = [
    ("IR", "Iran", "SANCTIONED", 40, "FATF Call for Action"),
    ("KP", "North Korea", "SANCTIONED", 40, "FATF Call for Action"),
    ("SY", "Syria", "SANCTIONED", 40, "UN Sanctions"),
    ("MM", "Myanmar", "HIGH_RISK", 30, "FATF Grey List"),
    ("AF", "Afghanistan", "HIGH_RISK", 30, "FATF Grey List"),
    ("YE", "Yemen", "HIGH_RISK", 30, "FATF Grey List"),
    ("RU", "Russia", "HIGH_RISK", 30, "Enhanced Due Diligence"),
    ("PK", "Pakistan", "HIGH_RISK", 25, "FATF Monitoring"),
    ("NG", "Nigeria", "HIGH_RISK", 25, "FATF Grey List"),
    ("PA", "Panama", "HIGH_RISK", 25, "Offshore Secrecy"),
    ("KY", "Cayman Islands", "MONITORED", 20, "Offshore Secrecy"),
    ("VG", "British Virgin Islands", "MONITORED", 20, "Offshore Secrecy"),
    ("SC", "Seychelles", "MONITORED", 20, "Offshore Secrecy"),
    ("BZ", "Belize", "MONITORED", 20, "Offshore Secrecy"),
    ("CY", "Cyprus", "MONITORED", 15, "Enhanced Due Diligence"),
    ("AE", "United Arab Emirates", "MONITORED", 15, "Trade-Based ML Risk"),
]

# Name, list type, country, notes.
WATCHLIST = [
    ("Zenith Holdings FZE", "SHELL_COMPANY", "AE", "Opaque ownership, trade-based ML indicators"),
    ("Orion Trade Partners Ltd", "SHELL_COMPANY", "VG", "Nominee directors, no operating footprint"),
    ("Delta Bridge Exchange", "SANCTIONS", "IR", "Designated entity - unlicensed money services"),
    ("Pyramid Capital SA", "SHELL_COMPANY", "PA", "Layering conduit identified in prior SAR"),
    ("Kestrel Logistics OOO", "SANCTIONS", "RU", "Sanctioned ownership chain"),
    ("Silverline Commodities Ltd", "ADVERSE_MEDIA", "KY", "Adverse media - invoice fraud allegations"),
]

# List type to risk weight; any other type weighs 15.
LIST_TYPE_WEIGHTS = {"SANCTIONS": 40, "SHELL_COMPANY": 30, "ADVERSE_MEDIA": 20}
OTHER_LIST_WEIGHT = 15

# Rule code, typology, enabled, weight, severity, parameters.
RULE_CONFIG = [
    ("CTR_THRESHOLD", "THRESHOLD_BREACH", True, 25, "MEDIUM", '{"thresholdBase":10000}'),
    ("STRUCTURING", "STRUCTURING", True, 35, "HIGH",
     '{"minCount":3,"windowHours":24,"lowerBound":9000,"upperBound":9999.99}'),
    ("RAPID_MOVEMENT", "LAYERING", True, 35, "HIGH",
     '{"windowHours":48,"outflowRatio":0.80,"minDepositBase":50000}'),
    ("HIGH_RISK_JURISDICTION", "JURISDICTION_RISK", True, 30, "HIGH", '{"alertRegardlessOfAmount":true}'),
    ("BEHAVIORAL_DEVIATION", "BEHAVIOURAL_ANOMALY", True, 25, "MEDIUM",
     '{"multiplier":3.0,"baselineDays":90,"minBaselineTxns":5,"minDailyBase":25000}'),
    ("ROUND_AMOUNT_PATTERN", "ROUND_AMOUNT", True, 15, "LOW",
     '{"minCount":3,"windowHours":24,"roundingUnit":10000,"minAmountBase":50000}'),
]


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A few constant rows as a local relation, whose exact size the planner knows."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def fx_rates(spark: SparkSession, rows: list[tuple] = FX_RATES) -> DataFrame:
    df = inline(spark, rows, ["currency", "rate_to_base"])
    return df.withColumn("rate_to_base", F.col("rate_to_base").cast("decimal(18,8)"))


def jurisdictions(spark: SparkSession, rows: list[tuple] = JURISDICTIONS) -> DataFrame:
    columns = ["country_code", "country_name", "category", "risk_weight", "source"]
    return inline(spark, rows, columns).withColumn("active", F.lit(True))


def watchlist(spark: SparkSession, rows: list[tuple] = WATCHLIST) -> DataFrame:
    numbered = [(i + 1, *row) for i, row in enumerate(rows)]
    df = inline(spark, numbered, ["id", "name", "list_type", "country", "notes"])
    return df.withColumn("normalized_name", normalise_party(F.col("name"))).withColumn("active", F.lit(True))


def rule_config(spark: SparkSession, rows: list[tuple] = RULE_CONFIG) -> DataFrame:
    return inline(spark, rows, ["rule_code", "typology", "enabled", "weight", "severity", "params"])


def list_type_weight(list_type):
    """Watchlist type to risk weight."""
    kind = F.upper(F.coalesce(list_type, F.lit("")))
    out = F.lit(OTHER_LIST_WEIGHT)
    for name, weight in LIST_TYPE_WEIGHTS.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


# --- active views used by the rules ----------------------------------------

def active_jurisdictions(df: DataFrame) -> DataFrame:
    """Listed countries in force, whatever their codes look like, one row per code."""
    return (
        df.where("active")
        .select(F.upper(F.trim("country_code")).alias("country_code"), "country_name", "category",
                "risk_weight", "source")
        .groupBy("country_code")
        .agg(F.max_by(F.struct("country_name", "category", "risk_weight", "source"),
                      F.struct("risk_weight", "country_name")).alias("listing"))
        .select("country_code", "listing.*")
    )


def active_watchlist(df: DataFrame) -> DataFrame:
    """Watchlist names in force, one row per normalised name (the newest entry)."""
    return (
        df.where("active and normalized_name <> ''")
        .groupBy("normalized_name")
        .agg(F.max_by(F.struct("name", "list_type", "notes"), F.col("id")).alias("entry"))
        .select("normalized_name", "entry.*")
        .withColumn("risk_weight", list_type_weight(F.col("list_type")))
    )


def country_weight(codes: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Add `country_risk_weight` for the country in `column`; 0 when unlisted."""
    keys = active_jurisdictions(listed).select(
        F.col("country_code").alias("_code"), F.col("risk_weight").alias("_weight"))
    return (
        codes.join(checked_side(keys), F.upper(F.trim(column)) == F.col("_code"), "left")
        .withColumn("country_risk_weight", F.coalesce("_weight", F.lit(0)))
        .drop("_code", "_weight")
    )


def active_fx(df: DataFrame) -> DataFrame:
    """Exchange rates by upper-case code, whatever the codes look like."""
    return (
        df.select(F.upper(F.trim("currency")).alias("fx_currency"), F.col("rate_to_base").cast("decimal(18,8)").alias("fx_rate"))
        .groupBy("fx_currency").agg(F.max("fx_rate").alias("fx_rate"))
    )


def latest_by_key(changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """Current state of a reference list kept as a change log: the last row per key.

    Deactivation is a change row with `active` false, never a delete."""
    values = [c for c in changes.columns if c not in (key, sequence)]
    return (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*values), F.col(sequence)).alias("v"), F.count(F.lit(1)).alias("changes"))
        .select(key, "v.*", "changes")
    )
