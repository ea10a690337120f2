"""The ingest job, shared by batch files and the stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound import refs
from tallyhound.functions import text
from tallyhound.functions.params import check_fx
from tallyhound.operators import cases, validate
from tallyhound.plans import store
from tallyhound.session import stored
from tallyhound.sources import files


@dataclass(frozen=True)
class Ingested:
    accepted: DataFrame
    rejected: DataFrame
    checked: DataFrame


def ingest(raw: DataFrame, accounts: DataFrame, fx: DataFrame, as_of: datetime, strict: bool = False,
           extra: list[validate.Check] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None,
           spread: int | None = None) -> Ingested:
    """Validate raw transactions and split them into ledger rows and rejects.

    The raw rows are read, parsed and joined once: between the checks of single rows and the search for
    repeated ids they are stored, by `keep` or else in the work folder. The search then reads two columns.
    `spread` deals the raw rows to that many tasks first, for input in fewer files or splits than there are
    cores. Rates that are not above zero stop the batch before a row is read.
    """
    fx = refuse_bad_rates(fx)
    checks = validate.chain(as_of, strict, extra)
    rows = validate.check_rows(raw.repartition(spread) if spread else raw, accounts, fx, checks)
    checked = validate.flag_repeats(keep(rows) if keep else stored(rows, "checked"), checks)
    return Ingested(validate.accepted(checked), validate.rejected(checked, checks), checked)


def ingest_customers(rows: DataFrame) -> Ingested:
    checked = validate.check_master(rows, "customer_id")
    good = files.to_customers(checked.where("failed is null"))
    return Ingested(good, validate.rejected(checked, validate.master_checks("customer_id"), "customer_id"), checked)


def ingest_accounts(rows: DataFrame, customers: DataFrame) -> Ingested:
    checked = validate.check_master(rows, "account_id", customers)
    good = files.to_accounts(checked.where("failed is null"))
    return Ingested(good, validate.rejected(checked, validate.master_checks("account_id", True), "account_id"), checked)


def source_ref(source: str, as_of: datetime, entity: str = "TRANSACTION") -> Column:
    """The ref of a batch, on its summary and on its rejects."""
    return batch_ref(F.lit(f"{entity}|{source}|{as_of.isoformat()}"), F.lit(as_of).cast("timestamp_ntz"))


def refuse_bad_rates(rates: DataFrame) -> DataFrame:
    """The rates, or an error that names some that are not above zero."""
    bad = check_fx(rates).where("problem is not null").select("currency").take(10)
    if bad:
        raise ValueError("rate must be greater than zero: " + ", ".join(str(r["currency"]) for r in bad))
    return rates


def batch_ref(key: Column, at: Column) -> Column:
    return F.concat_ws("-", F.lit("BATCH"), F.date_format(at, "yyyyMMdd-HHmmss"), F.upper(F.left(F.sha2(key, 256), F.lit(8))))


def summarise(checked: DataFrame, source: str, as_of: datetime, entity: str = "TRANSACTION",
              alerts: Column | int = 0, duration_ms: int | None = None) -> DataFrame:
    """One row about the batch: counts and status, and the alerts its detection opened."""
    counts = checked.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("failed").isNull()).alias("accepted_records"),
        F.count_if(F.col("failed").isNotNull()).alias("rejected_records"))
    alerts = F.lit(alerts) if isinstance(alerts, int) else alerts
    return counts.select(
        source_ref(source, as_of, entity).alias("batch_ref"),
        F.lit(entity).alias("entity_type"), F.lit(source).alias("source"),
        "total_records", "accepted_records", "rejected_records", alerts.cast("long").alias("alerts_generated"),
        F.when(F.col("rejected_records") == 0, "COMPLETED").otherwise("COMPLETED_WITH_ERRORS").alias("status"),
        F.lit(duration_ms).cast("long").alias("duration_ms"))


def audit_row(summaries: DataFrame, as_of: datetime, actor: str = "system") -> DataFrame:
    """The audit row of each finished batch."""
    return cases.audit(
        "INGESTION", "INGESTION_COMPLETED", summaries, F.col("batch_ref"), F.lit(as_of).cast("timestamp_ntz"),
        F.format_string("%d accepted, %d rejected, %d alerts in %d ms", "accepted_records", "rejected_records",
                        F.coalesce("alerts_generated", F.lit(0).cast("long")), F.coalesce("duration_ms", F.lit(0).cast("long"))), actor=F.lit(actor))


def load_masters(customers: DataFrame, accounts: DataFrame, path: str, batch_id: int, as_of: datetime, spread: int | None = None) -> None:
    """Validate a customer file and an account file and store what they bring under `path`: the accepted
    rows, the rejects with their batch's ref, the summaries and their audit rows. Accounts may
    belong to customers of this or any earlier batch. `spread` deals the rows to that many tasks first, as in `ingest`."""
    spark = customers.sparkSession
    parts = []
    for entity, rows in (("customer", customers), ("account", accounts)):
        rows = rows.repartition(spread) if spread else rows
        known = store.read_log(spark, f"{path}/customers", "customer_id string")
        done = ingest_customers(rows) if entity == "customer" else ingest_accounts(rows, known)
        store.write_batch(done.accepted, f"{path}/{entity}s", batch_id)
        ref = source_ref(f"{entity}s-{batch_id}", as_of, entity.upper())
        store.write_batch(done.rejected.withColumn("batch_ref", ref), f"{path}/{entity}_rejects", batch_id)
        parts.append(summarise(done.checked, f"{entity}s-{batch_id}", as_of, entity.upper()))
    made = store.kept(parts[0].unionByName(parts[1]), f"{path}/master_batches", batch_id)
    store.write_batch(audit_row(made, as_of), f"{path}/master_audit", batch_id)


def current_masters(log: DataFrame, key: str) -> DataFrame:
    """The last stored row of each customer or account."""
    return refs.latest_by_key(log, key, "batch_id").drop("changes")


def batch_report(summaries: DataFrame, rejects: DataFrame) -> DataFrame:
    """Each batch with its rejects in row order, one row per reject.

    A batch without rejects keeps one row. Rejects stay rows, since a single batch
    may have any number of them.
    """
    lines = rejects.select("batch_ref", "row_number", "record_key", "error_type", "error_message")
    return summaries.join(lines, "batch_ref", "left").orderBy("batch_ref", "row_number")
