"""CSV and JSON readers. Everything is read as text and typed by projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhound.functions import text
from tallyhound.operators.skew import checked_side
from tallyhound.schemas import ACCOUNT_COLUMNS, CUSTOMER_COLUMNS, RAW_TRANSACTION_COLUMNS

# JSON request field to column.
JSON_FIELDS = {
    "transactionId": "transaction_id", "accountId": "account_id", "customerId": "customer_id",
    "txnTimestamp": "txn_timestamp", "direction": "direction", "amount": "amount", "currency": "currency",
    "channel": "channel", "txnType": "txn_type", "counterpartyName": "counterparty_name",
    "counterpartyAccount": "counterparty_account", "counterpartyBank": "counterparty_bank",
    "counterpartyCountry": "counterparty_country", "description": "description",
}
JSON_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in JSON_FIELDS])


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Header-named text columns (lower case, stripped) with a 1-based `row_number`.

    Columns are found by name, in any order. Every file must carry the same
    header, and a row that does not fit it stops the read. Quoted line breaks need
    `multi_line`, which reads each file in one task; without it large files split.
    """
    options = {"header": True, "escape": '"', "encoding": "UTF-8", "multiLine": multi_line, "mode": "FAILFAST"}
    names = spark.read.options(**options).csv(path).columns
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.options(**options, enforceSchema=False).schema(layout).csv(path)
    rows = number_rows(rows)
    return rows.select("row_number", *[text.strip(F.col(f"`{n}`")).alias(n.strip().lower()) for n in names])


def number_rows(rows: DataFrame) -> DataFrame:
    """Consecutive numbers in file order, without bringing rows together.

    Rows are counted per file block first. The offsets are one row per block.
    """
    names = rows.columns
    placed = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                         F.monotonically_increasing_id().alias("_m"))
    blocks = placed.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(checked_side(offsets), ["_f", "_b"]).select(
        (F.col("_offset") + F.col("_m") - F.col("_first") + 1).alias("row_number"), *[F.col(f"`{n}`") for n in names])


def _reader(rows: DataFrame):
    """Column access by name; a column the file lacks reads as null."""
    have = set(rows.columns)

    def get(name: str, fallback: str | None = None) -> Column:
        value = F.col(f"`{name}`") if name in have else F.lit(None).cast("string")
        return text.text_or(value, fallback)
    return get


def to_raw_transactions(rows: DataFrame) -> DataFrame:
    """CSV rows to untyped transactions."""
    get = _reader(rows)
    special = {
        "txn_timestamp": F.coalesce(get("txn_timestamp"), get("transaction_date")),
        "currency": get("currency", "INR"),
    }
    columns = [special.get(c, get(c)).alias(c) for c in RAW_TRANSACTION_COLUMNS]
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "row_number"]
    return rows.select("row_number", *columns, F.to_json(F.struct(*kept)).alias("raw_line"))


def json_to_raw_transactions(rows: DataFrame) -> DataFrame:
    """JSON requests (text fields named as in JSON_FIELDS) to untyped transactions."""
    fields = [F.col(f).alias(c) for f, c in JSON_FIELDS.items()]
    passed = [c for c in ("row_number",) if c in rows.columns]
    return rows.select(*passed, *fields, F.lit("POSTED").alias("status"),
                       F.to_json(F.struct(*JSON_FIELDS)).alias("raw_line"))


def read_json(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """A batch of JSON transactions, one object per line (or arrays, if `multi_line`)."""
    rows = spark.read.schema(JSON_SCHEMA).option("multiLine", multi_line).json(path)
    return json_to_raw_transactions(number_rows(rows))


def stream_json(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON transactions as they arrive in a folder."""
    rows = spark.readStream.schema(JSON_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return json_to_raw_transactions(rows)


def to_customers(rows: DataFrame) -> DataFrame:
    """CSV rows to customers: 26 columns with their defaults."""
    get = _reader(rows)
    typed = {
        "first_name": get("first_name", "Unknown"), "last_name": get("last_name", "Unknown"),
        "date_of_birth": text.parse_date(get("date_of_birth")),
        "national_id": text.stand_in_national_id(get("customer_id")),
        "country": get("country", "IN"),
        "annual_income": text.parse_decimal(get("annual_income")),
        "customer_since": text.parse_date(get("customer_since")),
        "kyc_status": get("kyc_status", "PENDING"),
        "risk_rating": text.parse_rating(get("risk_rating")),
        "is_politically_exposed": text.parse_flag(get("is_politically_exposed")),
        "email_verified": text.parse_flag(get("email_verified")),
        "phone_verified": text.parse_flag(get("phone_verified")),
        "num_complaints_last_year": F.coalesce(text.parse_int(get("num_complaints_last_year")), F.lit(0)),
    }
    return rows.select(*[typed.get(c, get(c)).alias(c) for c in CUSTOMER_COLUMNS])


def to_accounts(rows: DataFrame) -> DataFrame:
    """CSV rows to accounts: 22 columns with their defaults."""
    get = _reader(rows)
    typed = {
        "account_type": get("account_type", "SAVINGS"), "account_status": get("account_status", "ACTIVE"),
        "currency": get("currency", "INR"),
        "open_date": text.parse_date(get("open_date")), "close_date": text.parse_date(get("close_date")),
        "current_balance": F.coalesce(text.parse_decimal(get("current_balance")), F.lit(0).cast("decimal(18,2)")),
        "avg_monthly_balance_6m": text.parse_decimal(get("avg_monthly_balance_6m")),
        "credit_limit": text.parse_decimal(get("credit_limit")),
        "credit_utilization_pct": text.parse_decimal(get("credit_utilization_pct"), "decimal(6,2)"),
        "overdraft_enabled": text.parse_flag(get("overdraft_enabled")),
        "is_joint_account": text.parse_flag(get("is_joint_account")),
        "num_linked_devices": text.parse_int(get("num_linked_devices")),
        "mobile_banking_enrolled": text.parse_flag(get("mobile_banking_enrolled")),
        "last_login_date": text.parse_date(get("last_login_date")),
        "avg_monthly_txn_count": text.parse_int(get("avg_monthly_txn_count")),
        "risk_rating": text.parse_rating(get("risk_rating")),
    }
    return rows.select(*[typed.get(c, get(c)).alias(c) for c in ACCOUNT_COLUMNS])
