"""Rule parameters kept as JSON text, read with coded defaults."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule, parameter, type, default.
PARAMETERS = [
    ("CTR_THRESHOLD", "thresholdBase", "decimal(18,2)", "10000"),
    ("STRUCTURING", "minCount", "int", "3"),
    ("STRUCTURING", "windowHours", "int", "24"),
    ("STRUCTURING", "lowerBound", "decimal(18,2)", "9000"),
    ("STRUCTURING", "upperBound", "decimal(18,2)", "9999.99"),
    ("RAPID_MOVEMENT", "windowHours", "int", "48"),
    ("RAPID_MOVEMENT", "outflowRatio", "decimal(9,6)", "0.80"),
    ("RAPID_MOVEMENT", "minDepositBase", "decimal(18,2)", "50000"),
    ("HIGH_RISK_JURISDICTION", "alertRegardlessOfAmount", "boolean", "true"),
    ("BEHAVIORAL_DEVIATION", "multiplier", "decimal(9,4)", "3.0"),
    ("BEHAVIORAL_DEVIATION", "baselineDays", "int", "90"),
    ("BEHAVIORAL_DEVIATION", "minBaselineTxns", "int", "5"),
    ("BEHAVIORAL_DEVIATION", "minDailyBase", "decimal(18,2)", "25000"),
    ("ROUND_AMOUNT_PATTERN", "minCount", "int", "3"),
    ("ROUND_AMOUNT_PATTERN", "windowHours", "int", "24"),
    ("ROUND_AMOUNT_PATTERN", "roundingUnit", "decimal(18,2)", "10000"),
    ("ROUND_AMOUNT_PATTERN", "minAmountBase", "decimal(18,2)", "50000"),
]


def parse_params(text: Column) -> Column:
    """JSON object to map of text; malformed or blank text gives an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(F.nullif(F.trim(text), F.lit("")), "map<string,string>"), empty)


def get_param(params: Column, key: str, kind: str, default: object) -> Column:
    """A typed parameter; a missing or unreadable value gives the default."""
    text = F.trim(F.try_element_at(params, F.lit(key)))
    if kind == "int":
        whole = text.try_cast("decimal(20,6)")
        value = F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole)).try_cast("int")
    elif kind == "boolean":
        value = F.when(text.isNotNull(), F.lower(text) == "true")
    elif kind == "string":
        value = text
    else:
        value = text.try_cast(kind)
    return F.coalesce(value, F.lit(default).cast(kind))


@dataclass(frozen=True)
class RuleSetting:
    code: str
    enabled: bool
    weight: int
    params: dict

    def number(self, key: str) -> Decimal:
        return Decimal(str(self.params[key]))

    def money(self, key: str) -> Column:
        return F.lit(self.number(key)).cast("decimal(18,2)")


def _checked(config: DataFrame) -> DataFrame:
    # Parsed once a row: written out inside every check, the text would be parsed by each of them.
    config = config.withColumn("_parsed", parse_params(F.col("params")))
    p = F.col("_parsed")

    def num(key: str) -> Column:
        return F.coalesce(F.try_element_at(p, F.lit(key)).try_cast("decimal(24,6)"), F.lit(0))

    def has(key: str) -> Column:
        return F.coalesce(F.array_contains(F.map_keys(p), key), F.lit(False))

    checks = [
        ((F.col("weight") < 0) | (F.col("weight") > 100), "weight must be between 0 and 100"),
        (has("windowHours") & (num("windowHours").cast("int") <= 0), "windowHours must be greater than zero"),
        (has("minCount") & (num("minCount").cast("int") < 1), "minCount must be at least 1"),
        ((has("lowerBound") | has("upperBound")) & (num("lowerBound") >= num("upperBound")),
         "lowerBound must be less than upperBound"),
        (has("outflowRatio") & ((num("outflowRatio") <= 0) | (num("outflowRatio") > 1)),
         "outflowRatio must be between 0 (exclusive) and 1.0 (inclusive)"),
        (has("multiplier") & (num("multiplier") <= 0), "multiplier must be greater than zero"),
        (has("baselineDays") & (num("baselineDays").cast("int") < 1), "baselineDays must be at least 1"),
    ]
    message = F.lit(None).cast("string")
    for bad, text in reversed(checks):
        message = F.when(bad, F.lit(text)).otherwise(message)
    return config.withColumn("problem", message).drop("_parsed")


def check_config(config: DataFrame) -> DataFrame:
    """The settings with a `problem` column; null when the row is usable."""
    return _checked(config)


def check_fx(rates: DataFrame) -> DataFrame:
    bad = F.col("rate_to_base").isNull() | (F.col("rate_to_base") <= 0)
    return rates.withColumn("problem", F.when(bad, F.lit("rate must be greater than zero")))


def load_settings(config: DataFrame) -> dict[str, RuleSetting]:
    """Settings of the registered rules, read once per run.

    Only registered codes are collected, one row each, so the driver holds a
    handful of rows however large the settings table is. Unusable rows stop the run.
    """
    codes = list(dict.fromkeys(r for r, *_ in PARAMETERS))
    from tallyhound.operators.rules import registered_codes
    codes = list(dict.fromkeys([*codes, *registered_codes()]))
    known = _checked(config.where(F.col("rule_code").isin(codes)))
    p = parse_params(F.col("params"))
    typed = [get_param(p, key, kind, default).alias(f"{rule}.{key}") for rule, key, kind, default in PARAMETERS]
    rows = known.dropDuplicates(["rule_code"]).select(
        "rule_code", "enabled", "weight", "problem", p.alias("raw"), *typed).collect()
    out = {}
    for row in rows:
        if row["problem"]:
            raise ValueError(f"{row['rule_code']}: {row['problem']}")
        mine = {key: row[f"{rule}.{key}"] for rule, key, *_ in PARAMETERS if rule == row["rule_code"]}
        out[row["rule_code"]] = RuleSetting(
            row["rule_code"], bool(row["enabled"]), int(row["weight"]), {**row["raw"], **mine})
    return out
