"""Sums of later outflows per deposit, over a forward time window on one account."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.operators import skew
from tallyhound.operators.clusters import _hours

# Order at equal times: a window opens before the debits and closes after them,
# so both ends are included.
_OPEN, _DEBIT, _CLOSE = 0, 1, 2
_ORDER = ["at", "kind", "transaction_id"]


def outflow_after_deposits(ledger: DataFrame, is_deposit: Column, is_outflow: Column, hours: int,
                           hot_limit: float | None = None) -> DataFrame:
    """Deposits with the count and sum of outflows in `[t, t + hours]`, where there is one.

    Two readings of a running total, at the window's open and close, give each sum.
    This is linear in the rows, where a sliding frame or a join grows with rows
    per window, and it reads the ledger once.
    """
    rows = ledger.select(
        "account_id", "customer_id", "transaction_id", "txn_timestamp", "amount_base",
        F.coalesce(is_deposit, F.lit(False)).alias("deposit"), F.coalesce(is_outflow, F.lit(False)).alias("outflow"),
    ).where("deposit or outflow")
    hot = skew.hot_keys(rows, ["account_id"], hot_limit)
    plain, heavy = skew.split_hot(rows, hot, ["account_id"])

    marks = _marks(plain, hours)
    running = Window.partitionBy("account_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    totals = marks.select("*", F.sum("out_amount").over(running).alias("sum_amount"),
                          F.sum("out_count").over(running).alias("sum_count"))
    out = _read_off(totals)
    if heavy is not None:
        pieces = skew.cut_into_pieces(_marks(heavy, hours), ["account_id"], _ORDER)
        split = skew.running_sum(pieces, ["account_id"], _ORDER,
                                 {"sum_amount": F.col("out_amount"), "sum_count": F.col("out_count")})
        out = out.unionByName(_read_off(split))
    return out


def _marks(rows: DataFrame, hours: int) -> DataFrame:
    def mark(at: Column, kind: int) -> Column:
        moved = F.when(F.lit(kind == _DEBIT), F.col("amount_base")).otherwise(F.lit(0).cast("decimal(18,2)"))
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), moved.alias("out_amount"),
                        F.lit(int(kind == _DEBIT)).cast("long").alias("out_count"))

    t = F.col("txn_timestamp")
    window = F.array(mark(t, _OPEN), mark(t + _hours(hours), _CLOSE))
    nothing = F.slice(window, 1, 0)
    marks = F.concat(F.when(F.col("deposit"), window).otherwise(nothing),
                     F.when(F.col("outflow"), F.array(mark(t, _DEBIT))).otherwise(nothing))
    return rows.select("account_id", "customer_id", "transaction_id", "txn_timestamp", "amount_base",
                       F.explode(marks).alias("m")).select(
        "account_id", "customer_id", "transaction_id", "txn_timestamp", "amount_base", "m.*")


def _read_off(totals: DataFrame) -> DataFrame:
    def between(name: str) -> Column:
        return F.max(F.when(F.col("kind") == _CLOSE, F.col(name))) - F.max(F.when(F.col("kind") == _OPEN, F.col(name)))

    return (
        totals.where(F.col("kind") != _DEBIT)
        .groupBy("account_id", "transaction_id", "txn_timestamp", "customer_id",
                 F.col("amount_base").alias("deposit_amount"))
        .agg(between("sum_amount").cast("decimal(28,2)").alias("outflow_total"),
             between("sum_count").alias("outflow_count"))
        .where("outflow_count > 0"))


def windows_covering(rows: DataFrame, windows: DataFrame, hot_limit: float | None = None) -> DataFrame:
    """For each row (account_id, transaction_id, txn_timestamp), how many windows
    (account_id, first_ts, last_ts, is_new) on its account cover it: `covered`, `covered_new`.

    Windows opened so far less windows closed so far: a running count, no pairs.
    """
    one = F.lit(1).cast("long")

    def mark(df: DataFrame, at: str, kind: int, step: int, txn: Column, new: Column) -> DataFrame:
        return df.select("account_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), txn.alias("transaction_id"),
                         (one * step).alias("step"), (new * step).alias("step_new"))

    blank, fresh = F.lit(""), F.col("is_new").cast("long")
    marks = (mark(windows, "first_ts", _OPEN, 1, blank, fresh)
             .unionByName(mark(windows, "last_ts", _CLOSE, -1, blank, fresh))
             .unionByName(mark(rows, "txn_timestamp", _DEBIT, 0, F.col("transaction_id"), one)))
    hot = skew.hot_keys(marks, ["account_id"], hot_limit)
    plain, heavy = skew.split_hot(marks, hot, ["account_id"])
    running = Window.partitionBy("account_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    out = plain.select("transaction_id", "kind", F.sum("step").over(running).alias("covered"),
                       F.sum("step_new").over(running).alias("covered_new"))
    if heavy is not None:
        split = skew.running_sum(skew.cut_into_pieces(heavy, ["account_id"], _ORDER), ["account_id"], _ORDER,
                                 {"covered": F.col("step"), "covered_new": F.col("step_new")})
        out = out.unionByName(split.select("transaction_id", "kind", "covered", "covered_new"))
    return out.where(F.col("kind") == _DEBIT).drop("kind")


def stretches(rows: DataFrame, keys: list[str], at: Column, before: timedelta, after: timedelta) -> DataFrame:
    """`keys`, `start`, `end`: the union of [t - before, t + after] over each key's times, as disjoint stretches.

    Rows are first combined, on the map side, to one per key and cell of that width, so
    a key's window holds at most the calendar's cells, however many rows it has.
    """
    width = int((before + after) / timedelta(microseconds=1))
    cells = rows.select(*keys, at.alias("_at")).where("_at is not null").groupBy(
        *keys, F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / width).alias("_cell")).agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    reach = cells.select(*keys, (F.col("lo") - F.lit(before)).alias("start"), (F.col("hi") + F.lit(after)).alias("end"))
    in_order = Window.partitionBy(*keys).orderBy("start", "end")
    apart = F.col("start") > F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = reach.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "n", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("n")


def by_day(stretches_: DataFrame, keys: list[str], day: str = "txn_date") -> DataFrame:
    """`keys`, the day, `start`, `end`: one row per day that a stretch touches."""
    return stretches_.select(*keys, F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias(day), "start", "end")


def outflows_within(windows: DataFrame, keys: list[str], ledger: DataFrame, hours: int) -> DataFrame:
    """`keys`, `transaction_id`: the debits in any of a key's windows (account_id, first_ts; each `hours` long), once
    each. Overlapping windows are united first, so a debit that many of them cover is met once: no pairs."""
    spans = stretches(windows, [*keys, "account_id"], F.col("first_ts"), timedelta(0), timedelta(hours=hours))
    days = by_day(spans, [*keys, F.col("account_id").alias("_account")], "_day")
    debits = ledger.where(F.col("direction") == "DEBIT").select("account_id", "transaction_id", "txn_timestamp")
    met = (F.col("account_id") == F.col("_account")) & (F.to_date("txn_timestamp") == F.col("_day")) & F.col("txn_timestamp").between(F.col("start"), F.col("end"))
    return debits.join(days, met).select(*keys, "transaction_id")


def outflows_of(deposits: DataFrame, ledger: DataFrame, is_outflow: Column, hours: int) -> DataFrame:
    """The outflow rows behind each given deposit (dedup_key, account_id, anchor time).

    One row per (deposit, outflow): this is the evidence list itself, so its size
    is the size of the answer. Ask for it on the findings to be shown. The time
    bucket in the join key bounds the rows compared, and the adaptive skew join
    splits a bucket that is still large.
    """
    span = hours * 3600
    def bucket(ts):
        return F.floor(F.unix_seconds(ts.cast("timestamp")) / span)
    asked = deposits.select(
        "dedup_key", "account_id", F.col("first_ts").alias("_from"),
        (F.col("first_ts") + _hours(hours)).alias("_to"),
        F.explode(F.array(bucket(F.col("first_ts")), bucket(F.col("first_ts")) + 1)).alias("_bucket"))
    outflows = ledger.where(is_outflow).select(
        "account_id", "transaction_id", "txn_timestamp", "amount_base", bucket(F.col("txn_timestamp")).alias("_bucket"))
    return (
        outflows.join(asked, ["account_id", "_bucket"])
        .where(F.col("txn_timestamp").between(F.col("_from"), F.col("_to")))
        .drop("_bucket", "_from", "_to"))
