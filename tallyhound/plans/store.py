"""Tables on shared storage: append-only logs, written one folder per batch.

Rewriting a batch replaces its folder, so a retried batch leaves no duplicates.
Current state is always derived by aggregation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.plans.keys import KeyTable
from tallyhound.schemas import LEDGER_COLUMNS, LEDGER_DDL

# Account buckets of a stored ledger. A day's rows of one bucket should fill a file.
BUCKETS = 4


def bucket_of(account_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(account_id), F.lit(buckets)).cast("int")


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def kept(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write a batch and read it back, so that what follows reads stored rows."""
    write_batch(df, path, batch_id)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """All batches of a log, with `batch_id`; no rows before the first batch is written."""
    try:
        return spark.read.schema(", ".join([*([ddl] if ddl else []), "batch_id bigint"])).parquet(path)
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join([*([ddl] if ddl else []), "batch_id bigint"]))


def write_ledger(accepted: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Append accepted rows, partitioned by day and account bucket.

    The rebalance hint gathers small days into few files and splits a bucket that
    holds too much for one task. A ledger keeps its number of buckets. Ids that earlier batches wrote
    are noted where their old rows lie (see `rewrites`), so batches are numbered 0, 1, 2 ...
    """
    dated = accepted.withColumns({"txn_date": F.to_date("txn_timestamp"), "account_bucket": bucket_of(F.col("account_id"), buckets)})
    write_batch(dated.hint("rebalance", "txn_date", "account_bucket"), path, batch_id, ["txn_date", "account_bucket"])
    spark, index = accepted.sparkSession, places(path)
    mine = spark.read.schema("transaction_id string, txn_date date, account_bucket int").parquet(f"{path}/batch_id={batch_id}")
    if batch_id:
        old = index.find(mine, batch_id)
        write_batch(old.hint("rebalance", "txn_date", "account_bucket"), f"{path}-rewritten", batch_id, ["txn_date", "account_bucket"])
    index.add(mine, batch_id)


def places(path: str) -> KeyTable:
    """The day and bucket of every row of a stored ledger, by transaction id."""
    return KeyTable(f"{path}-places", "transaction_id", payload=(("txn_date", "date"), ("account_bucket", "int")))


def rewrites(spark: SparkSession, path: str) -> DataFrame:
    """Ids that a batch wrote again, one row per place (day, bucket) where an older row of theirs lies. The
    places are partitions here as in the ledger, so a reader of some days opens the same days of both."""
    return read_log(spark, f"{path}-rewritten", "transaction_id string, txn_date date, account_bucket int")


def not_rewritten(rows: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Rows of a ledger log, cut to any places, that no later batch wrote again, be it to another day or
    account. `rewritten` holds the same places."""
    last = rewritten.groupBy("transaction_id", "txn_date", "account_bucket").agg(F.max("batch_id").alias("_again")).withColumnsRenamed(
        {"transaction_id": "_id", "txn_date": "_day", "account_bucket": "_bucket"})
    same = (F.col("transaction_id") == F.col("_id")) & (F.col("txn_date") == F.col("_day")) & (F.col("account_bucket") == F.col("_bucket"))
    return rows.join(last, same & (F.col("_again") > F.col("batch_id")), "left_anti")


def current_slice(spark: SparkSession, path: str, where: Column) -> DataFrame:
    """Current rows of the places that `where` (on txn_date and account_bucket) opens; others are not read."""
    return not_rewritten(read_ledger_log(spark, path).where(where), rewrites(spark, path).where(where)).select(*LEDGER_COLUMNS)


def read_ledger_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_DDL + ", batch_id bigint, txn_date date, account_bucket int").parquet(path)


def last_committed(spark: SparkSession, path: str) -> int:
    """The last batch of which everything is written, by the log that is written last; -1 for none."""
    return read_log(spark, path, "").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]


def current_ledger(log: DataFrame) -> DataFrame:
    """The last write per transaction id."""
    picked = log.groupBy("transaction_id").agg(
        F.max_by(F.struct(*[c for c in LEDGER_COLUMNS if c != "transaction_id"]), F.col("batch_id")).alias("r"))
    return picked.select("transaction_id", "r.*").select(*LEDGER_COLUMNS)


def current_rows_of(log: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Current ledger rows of some accounts or customers, reading only the id columns of the rest. A
    row counts if no later batch in `log` rewrote its id, so `log` must not be cut to some days: those are
    read by `current_slice`, which knows of rewrites elsewhere."""
    mine = log.join(ids.select(key).distinct(), key, "left_semi")
    newest = (
        log.select("transaction_id", "batch_id")
        .join(mine.select("transaction_id").distinct(), "transaction_id", "left_semi")
        .groupBy("transaction_id").agg(F.max("batch_id").alias("batch_id")))
    return mine.join(newest, ["transaction_id", "batch_id"], "left_semi").select(*LEDGER_COLUMNS)


def compact_ledger(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite the log as one batch holding each transaction's current row."""
    write_ledger(current_ledger(read_ledger_log(spark, path)), target, 0)


def ledger_window(ledger: DataFrame, account_ids: DataFrame, start, end) -> DataFrame:
    """Rows of the given accounts between two times, both included, in account and time order."""
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    rows = ledger.where(F.col("txn_timestamp").between(start, end))
    if "txn_date" in ledger.columns:  # a stored ledger: other days are not opened
        rows = rows.where(F.col("txn_date").between(F.to_date(start), F.to_date(end)))
    return rows.join(account_ids.select("account_id").distinct(), "account_id", "left_semi").orderBy(
        "account_id", "txn_timestamp", "transaction_id")


def by_ids(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of `table` whose `key` occurs in `ids`."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def accounts_of(accounts: DataFrame, customer_ids: DataFrame) -> DataFrame:
    return by_ids(accounts, "customer_id", customer_ids)


def in_detection_order(ledger: DataFrame) -> DataFrame:
    """Account then time order within evenly sized partitions."""
    return ledger.repartitionByRange("account_id", "txn_timestamp", "transaction_id").sortWithinPartitions(
        "account_id", "txn_timestamp", "transaction_id")
