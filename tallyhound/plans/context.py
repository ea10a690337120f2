"""What a batch's rules read: history around each account's own rows, pruned by day and account bucket.

Account rules read, per account, the rows from the widest account rule's hours before each of the batch's rows
to as many behind it; behaviour reads the baseline days before each of a customer's days. Stretches that overlap
are one, those that do not stay apart, so a row that comes two years late adds its own surroundings and
nothing between. Patterns are found in what is read, so an old pattern is not found again by every
later batch. `account_window` reads more: one window, over the whole batch, for all of its accounts.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions.params import RuleSetting
from tallyhound.operators import flows, rules, skew
from tallyhound.plans import store


def account_reach(batch: DataFrame, settings: dict[str, RuleSetting]) -> DataFrame:
    span = timedelta(hours=rules.max_lookback_hours(settings))
    return flows.stretches(batch, ["account_id"], F.col("txn_timestamp"), span, span)


def customer_reach(batch: DataFrame, settings: dict[str, RuleSetting]) -> DataFrame:
    """From midnight of the first baseline day to the end of the day, for each of a customer's days."""
    days = max((int(s.params["baselineDays"]) for s in settings.values() if "baselineDays" in s.params), default=90)
    return flows.stretches(batch, ["customer_id"], F.date_trunc("day", "txn_timestamp").cast("timestamp_ntz"), timedelta(days=days), timedelta(days=1, microseconds=-1))


def in_days(days: list[date]) -> Column:
    """Condition on `txn_date`, as ranges of days that follow one another."""
    runs: list[list[date]] = []
    for d in sorted(days):
        if runs and d - runs[-1][1] == timedelta(days=1):
            runs[-1][1] = d
        else:
            runs.append([d, d])
    return reduce(or_, (F.col("txn_date").between(F.lit(a), F.lit(b)) for a, b in runs))


def opened(days: DataFrame, key: str, ledger: DataFrame, buckets: int) -> Column:
    """Condition on the partition columns of a stored ledger: the days to open, in each account
    bucket its own. Buckets times days of the calendar come back."""
    if key == "account_id" and "account_bucket" in ledger.columns:
        found = days.select(store.bucket_of(F.col(key), buckets).alias("b"), "txn_date").distinct().collect()
        per: dict[int, list[date]] = {}
        for r in found:
            per.setdefault(r["b"], []).append(r["txn_date"])
        return reduce(or_, ((F.col("account_bucket") == b) & in_days(d) for b, d in sorted(per.items())), F.lit(False))
    found = [r["txn_date"] for r in days.select("txn_date").distinct().collect()]
    return in_days(found) if found else F.lit(False)


def rows_in_reach(ledger: DataFrame, reach: DataFrame, key: str, buckets: int = store.BUCKETS, rewritten: DataFrame | None = None) -> DataFrame:
    """Ledger rows inside their key's stretches. Stored days and buckets that hold none are not opened.
    Given the ids written again, of a stored ledger, only current rows count, wherever their rewrites lie."""
    days = skew.checked_side(flows.by_day(reach, [key]).withColumnsRenamed({key: "_key", "txn_date": "_day"}))
    plain = days.withColumnsRenamed({"_key": key, "_day": "txn_date"})
    stored = "txn_date" in ledger.columns
    here = opened(plain, key, ledger, buckets) if stored else F.lit(True)
    rows = ledger.where(here)
    day = F.col("txn_date") if stored else F.to_date("txn_timestamp")
    # Stretches of a key are disjoint, so a row meets at most one.
    met = rows.join(days, (F.col(key) == F.col("_key")) & (day == F.col("_day")) & F.col("txn_timestamp").between(F.col("start"), F.col("end")))
    met = met.select(*[rows[c] for c in rows.columns])
    return met if rewritten is None else store.not_rewritten(met, rewritten.where(here))


def account_window(ledger: DataFrame, batch: DataFrame, settings: dict[str, RuleSetting], rewritten: DataFrame | None = None) -> DataFrame:
    """All rows of the batch's accounts from the widest account rule's hours before the batch's first row to as many
    behind its last, whichever accounts these two are of. Stored days outside are not opened; `rewritten` as in `rows_in_reach`."""
    hours = F.make_dt_interval(hours=F.lit(rules.max_lookback_hours(settings)))
    first, last = batch.agg(F.min("txn_timestamp"), F.max("txn_timestamp")).first()
    if first is None:
        return ledger.where(F.lit(False))
    start, end = (F.lit(first).cast("timestamp_ntz") - hours), (F.lit(last).cast("timestamp_ntz") + hours)
    here = F.col("txn_date").between(F.to_date(start), F.to_date(end)) if "txn_date" in ledger.columns else F.lit(True)
    ids = skew.checked_side(batch.select("account_id").distinct())
    rows = ledger.where(here & F.col("txn_timestamp").between(start, end)).join(ids, "account_id", "left_semi")
    return rows if rewritten is None else store.not_rewritten(rows, rewritten.where(here))
