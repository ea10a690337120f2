"""Row validation: an ordered list of checks, the first failure wins.

Checks are plain Columns, so the whole chain is one projection. Accepted rows have
a null `error_type`.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import money, text
from tallyhound.operators.skew import checked_side
from tallyhound.refs import active_fx
from tallyhound.schemas import LEDGER_COLUMNS

STRUCTURAL, REFERENTIAL, BUSINESS = "STRUCTURAL", "REFERENTIAL_INTEGRITY", "BUSINESS_RULE"
MESSAGE_LIMIT = 500


@dataclass(frozen=True)
class Check:
    """Fails where `fails` is true. Lower `order` runs first."""
    order: int
    fails: Column
    error_type: str
    message: Column


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("null"))


def transaction_checks(as_of: datetime) -> list[Check]:
    """Checks over the prepared fields of a raw row (see `prepared`), joined to
    `owner_id` (of its account) and `fx_rate`."""
    c = F.col
    future = c("p_ts") > F.lit(as_of).cast("timestamp_ntz") + F.expr("INTERVAL 5 MINUTES")
    return [
        Check(10, c("p_id").isNull(), STRUCTURAL, F.lit("transactionId is required")),
        Check(10, c("p_account").isNull(), STRUCTURAL, F.lit("accountId is required")),
        Check(10, text.is_blank(c("txn_timestamp")), STRUCTURAL, F.lit("txnTimestamp is required")),
        Check(10, c("p_ts").isNull(), STRUCTURAL,
              _say("txnTimestamp '", c("txn_timestamp"), "' is not a recognised date-time")),
        Check(10, c("direction").isNull(), STRUCTURAL, F.lit("direction is required")),
        Check(10, c("p_way").isNull(), STRUCTURAL, _say("unknown direction: ", c("direction"))),
        Check(10, c("p_amount").isNull(), STRUCTURAL, _say("amount '", _shown(c("amount")), "' is not a valid number")),
        Check(10, c("p_amount") <= 0, STRUCTURAL,
              _say("amount must be greater than zero (was ", text.strip(c("amount")), ")")),
        Check(10, F.coalesce(F.length("p_currency") != 3, F.lit(True)), STRUCTURAL,
              _say("currency must be a 3-letter ISO-4217 code (was '", _shown(c("currency")), "')")),
        Check(10, F.length("p_country") != 2, STRUCTURAL,
              _say("counterpartyCountry must be a 2-letter ISO code (was '", c("counterparty_country"), "')")),
        Check(20, c("owner_id").isNull(), REFERENTIAL, _say("accountId '", c("account_id"), "' does not exist")),
        Check(20, c("p_customer") != c("owner_id"), REFERENTIAL,
              _say("customerId '", c("customer_id"), "' does not own account '", c("account_id"), "' (owner is '",
                   c("owner_id"), "')")),
        Check(30, c("fx_rate").isNull(), BUSINESS,
              _say("unknown currency '", c("p_currency"), "' — no rate configured in fx_rates, "
                   "so the amount cannot be normalised for threshold comparison")),
        Check(30, future, BUSINESS, _say("txnTimestamp '", c("txn_timestamp"), "' is in the future")),
    ]


def prepared(raw: DataFrame) -> DataFrame:
    """Each field stripped and parsed once, under `p_` names.

    The checks then compare plain columns. Written out inside every check, the
    same parsing makes one method too large for the JVM to compile.
    """
    c = F.col
    rows = raw.withColumns({
        "p_id": text.text_or(c("transaction_id")), "p_account": text.text_or(c("account_id")),
        "p_customer": text.text_or(c("customer_id")), "p_time": text.strip(c("txn_timestamp")),
        "p_way": text.parse_direction(c("direction")), "p_amount": text.parse_decimal(c("amount"), "decimal(38,18)"),
        "p_currency": F.upper(text.text_or(c("currency"))), "p_country": F.upper(text.text_or(c("counterparty_country")))})
    rows = rows.withColumn("p_plain", text.without_marks(c("p_time")))
    rows = rows.withColumn("p_iso", text.iso_text_of(c("p_time"), c("p_plain")))
    return rows.withColumn("p_ts", text.iso_timestamp(c("p_iso"))).drop("p_time", "p_plain", "p_iso")


def request_checks() -> list[Check]:
    """Stricter limits for JSON requests; a violating row is rejected by itself."""
    c = F.col
    return [
        Check(0, F.length("transaction_id") > 40, STRUCTURAL, F.lit("size must be between 0 and 40")),
        Check(0, F.length("account_id") > 32, STRUCTURAL, F.lit("size must be between 0 and 32")),
        Check(0, ~c("direction").rlike("(?i)^(CREDIT|DEBIT)$"), STRUCTURAL, F.lit("direction must be CREDIT or DEBIT")),
        Check(0, c("p_amount") < F.lit("0.01").cast("decimal(4,2)"), STRUCTURAL, F.lit("amount must be greater than zero")),
        Check(0, ~c("currency").rlike("^[A-Za-z]{3}$"), STRUCTURAL, F.lit("currency must be a 3-letter ISO-4217 code")),
        Check(0, ~c("counterparty_country").rlike("^([A-Za-z]{2})?$"), STRUCTURAL,
              F.lit("counterpartyCountry must be a 2-letter ISO code")),
    ]


def _ordered(checks: list[Check]) -> list[Check]:
    return sorted(checks, key=lambda k: k.order)


def _choose(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out


def first_failure(checks: list[Check]) -> Column:
    """Place of the first failing check in the chain; null if none fails.

    A small number, so that only rejected rows ever build a message."""
    return _choose([(c.fails, F.lit(i)) for i, c in enumerate(_ordered(checks))])


def explain(checks: list[Check]) -> list[Column]:
    """error_type and error_message of the check numbered in `failed`."""
    ordered = _ordered(checks)
    kind = _choose([(F.col("failed") == i, F.lit(c.error_type)) for i, c in enumerate(ordered)])
    message = _choose([(F.col("failed") == i, c.message) for i, c in enumerate(ordered)])
    return [kind.alias("error_type"), text.clip(message, MESSAGE_LIMIT).alias("error_message")]


def _repeat_check() -> Check:
    """Passed by the chain itself; `flag_repeats` fails it later."""
    return Check(99, F.lit(False), BUSINESS,
                 _say("duplicate transactionId '", F.col("transaction_id"), "' within this batch"))


def chain(as_of: datetime, strict: bool = False, extra: list[Check] | None = None) -> list[Check]:
    """All transaction checks in order. `extra` checks join by their order."""
    return _ordered([*transaction_checks(as_of), *(request_checks() if strict else []), *(extra or []), _repeat_check()])


def check_rows(raw: DataFrame, accounts: DataFrame, fx: DataFrame, checks: list[Check]) -> DataFrame:
    """Every check that looks at one row; adds `failed` and the parsed fields."""
    owners = accounts.select(text.strip(F.col("account_id")).alias("_account"), F.col("customer_id").alias("owner_id"))
    rates = active_fx(fx)
    rows = prepared(raw).join(owners, F.col("p_account") == F.col("_account"), "left")
    rows = rows.join(checked_side(rates), F.col("p_currency") == F.col("fx_currency"), "left")
    return rows.withColumn("failed", first_failure(checks)).drop("_account", "fx_currency")


def first_rows(rows: DataFrame, key: Column) -> DataFrame:
    """Keys that occur more than once, with the number of their first row.

    Counted with a map-side combine, so a key copied into a third of the rows costs
    no more than any other.
    """
    return (
        rows.groupBy(key.alias("_key"))
        .agg(F.min("row_number").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _key is not null").select("_key", "_first"))


def flag_repeats(checked: DataFrame, checks: list[Check]) -> DataFrame:
    """Reject a transaction id already seen on an earlier accepted row of the batch.

    Only rows that passed every other check count as seen, so a rejected row never
    shadows a later good one. The list of repeated ids is computed first; the rows
    themselves are shuffled only if that list is too large to broadcast.
    """
    key = F.col("p_id")
    repeats = checked_side(first_rows(checked.where("failed is null"), key))
    joined = checked.join(repeats, key == F.col("_key"), "left")
    late = F.col("failed").isNull() & (F.col("row_number") > F.col("_first"))
    return joined.withColumn("failed", F.when(late, len(checks) - 1).otherwise(F.col("failed"))).drop("_key", "_first")


def accepted(checked: DataFrame) -> DataFrame:
    """Typed ledger rows: owner from the account, amounts in the base currency."""
    amount = money.to_money(F.col("p_amount"))
    typed = {
        "transaction_id": F.col("p_id"),
        "account_id": F.col("p_account"),
        "customer_id": F.col("owner_id"),
        "txn_timestamp": F.col("p_ts"),
        "direction": F.col("p_way"),
        "amount": amount,
        "currency": F.col("p_currency"),
        "amount_base": money.to_base(amount, F.col("fx_rate")),
        "fx_rate_applied": F.col("fx_rate"),
        "counterparty_country": F.upper(text.strip(F.col("counterparty_country"))),
        "status": F.coalesce("status", F.lit("POSTED")),
    }
    return checked.where("failed is null").select(*[typed.get(c, F.col(c)).alias(c) for c in LEDGER_COLUMNS])


def rejected(checked: DataFrame, checks: list[Check], key: str = "transaction_id") -> DataFrame:
    """Dead-letter rows with the reason and the record as it came."""
    return checked.where("failed is not null").select(
        "row_number", F.col(key).alias("record_key"), *explain(checks), F.col("raw_line").alias("raw_record"))


# --- customer and account files --------------------------------------------

def master_checks(key: str, owned: bool = False) -> list[Check]:
    """Checks of a customer or account file. An id counts as seen on its first row,
    whatever happens to that row later."""
    checks = [
        Check(10, F.col("_id").isNull(), STRUCTURAL, F.lit(f"{key} is required")),
        Check(20, F.col("row_number") > F.col("_first"), BUSINESS, F.lit(f"duplicate {key} in file"))]
    if owned:
        checks.append(Check(30, F.col("_owner").isNull(), REFERENTIAL, _say(
            "customer_id '", _shown(F.col("customer_id")), "' does not exist — load customers first")))
    return checks


def check_master(rows: DataFrame, key: str, customers: DataFrame | None = None) -> DataFrame:
    """Add `failed` to the rows of a customer file, or of an account file whose owners
    must be among `customers`."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "row_number"]
    rows = rows.withColumns({"_id": text.text_or(F.col(key)), "raw_line": F.to_json(F.struct(*kept))})
    if customers is not None:
        known = customers.select(F.col("customer_id").alias("_owner")).distinct()
        rows = rows.join(known, F.col("customer_id") == F.col("_owner"), "left")
    repeats = checked_side(first_rows(rows, F.col("_id")))
    joined = rows.join(repeats, F.col("_id") == F.col("_key"), "left")
    return joined.withColumn("failed", first_failure(master_checks(key, customers is not None))).drop("_key", "_first", "_id")
