"""Greedy non-overlapping clusters of events in a time window, per account.

Events are taken in (time, id) order. From the first event not yet used, a
cluster takes every event up to `hours` later, both ends included. With at least
`min_count` events it is kept and the search goes on behind it; otherwise the
search moves on by one event.

An event can open a cluster exactly when the event `min_count - 1` places later is
still inside the window, so one `lead` marks the candidates. What remains is
to pick candidates from left to right, each more than a window after the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.operators import skew
from tallyhound.session import cut_lineage

# Qualifying rows of one account that are folded in one go. The fold copies its list of picks at
# every pick, so its cost grows with the square of a stretch; larger accounts take the split path.
FOLD_ROWS = 4_000

MEMBER_COLUMNS = ["account_id", "cluster_ts", "cluster_txn_id", "cluster_customer_id",
                  "transaction_id", "txn_timestamp", "amount_base"]
_ORDER = ["txn_timestamp", "transaction_id"]


def _hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def find_clusters(candidates: DataFrame, hours: int, min_count: int, hot_limit: float | None = None) -> DataFrame:
    """Cluster members, one row per event, in MEMBER_COLUMNS.

    `candidates` has account_id, customer_id, transaction_id, txn_timestamp and
    amount_base, already filtered to the events that qualify.
    """
    rows = candidates.select("account_id", "customer_id", *_ORDER, "amount_base")
    if min_count <= 0:
        return _ordinary(rows.where(F.lit(False)), hours, 1)
    hot = skew.hot_keys(rows, ["account_id"], FOLD_ROWS if hot_limit is None else hot_limit)
    plain, heavy = skew.split_hot(rows, hot, ["account_id"])
    out = _ordinary(plain, hours, min_count)
    if heavy is not None:
        out = out.unionByName(_split_accounts(heavy, hours, min_count))
    return out


def _ordinary(rows: DataFrame, hours: int, min_count: int) -> DataFrame:
    """One shuffle on account_id; everything after it stays in place.

    A cluster never spans a gap longer than the window, so the sequence is cut at
    such gaps first, and stretches with no candidate are dropped before gathering.
    """
    by_time = Window.partitionBy("account_id").orderBy(*_ORDER)
    ts = F.col("txn_timestamp")
    previous = F.lag("txn_timestamp").over(by_time)
    marked = rows.select(
        "*",
        F.when(previous + _hours(hours) >= ts, 0).otherwise(1).alias("_new"),
        F.coalesce(F.lead("txn_timestamp", min_count - 1).over(by_time) <= ts + _hours(hours), F.lit(False)).alias("opens"),
    ).withColumn("stretch", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = (
        marked.groupBy("account_id", "stretch")
        .agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "customer_id", "amount_base", "opens"))).alias("seq"),
             F.max("opens").alias("any_opens"))
        .where("any_opens"))
    picked = gathered.select("account_id", "seq", _pick(F.col("seq"), hours).alias("spans"))
    spans = picked.select(
        "account_id",
        F.explode(F.transform("spans", lambda s: F.slice(F.col("seq"), s["lo"], s["hi"] - s["lo"] + 1))).alias("members"))
    first = F.element_at("members", 1)
    return spans.select(
        "account_id", first["txn_timestamp"].alias("cluster_ts"), first["transaction_id"].alias("cluster_txn_id"),
        first["customer_id"].alias("cluster_customer_id"), F.explode("members").alias("m"),
    ).select("account_id", "cluster_ts", "cluster_txn_id", "cluster_customer_id",
             "m.transaction_id", "m.txn_timestamp", "m.amount_base")


def _pick(seq: Column, hours: int) -> Column:
    """Fold the sequence into the (lo, hi) positions of its clusters."""
    never = F.lit(None).cast("timestamp_ntz")
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lo"), never.alias("until"), empty.alias("done"))

    def close(acc):
        span = F.struct(acc["lo"].alias("lo"), acc["at"].alias("hi"))
        return F.when(acc["until"].isNotNull(), F.concat(acc["done"], F.array(span))).otherwise(acc["done"])

    def step(acc, x):
        here = acc["at"] + 1
        inside = F.coalesce(x["txn_timestamp"] <= acc["until"], F.lit(False))
        return F.when(
            inside, F.struct(here.alias("at"), acc["lo"].alias("lo"), acc["until"].alias("until"), acc["done"].alias("done"))
        ).otherwise(F.struct(
            here.alias("at"), here.alias("lo"),
            F.when(x["opens"], x["txn_timestamp"] + _hours(hours)).alias("until"), close(acc).alias("done")))

    return F.aggregate(seq, start, step, close)


def _split_accounts(rows: DataFrame, hours: int, min_count: int) -> DataFrame:
    """The same clusters for accounts too large for one task.

    Every step is keyed by (account, position) or runs piece by piece. The chain
    of picks is followed by doubling: after k rounds 2^k picks are known, so
    the rounds grow with log2(time span / window).
    """
    key = ["account_id"]
    cut = skew.cut_into_pieces(rows, key, _ORDER)
    placed = cut_lineage(skew.running_sum(cut, key, _ORDER, {"pos": F.lit(1).cast("long")}))

    ahead = placed.select("account_id", (F.col("pos") - (min_count - 1)).alias("pos"),
                          F.col("txn_timestamp").alias("ahead_ts"))
    openers = (
        placed.join(ahead, ["account_id", "pos"])
        .where(F.col("ahead_ts") <= F.col("txn_timestamp") + _hours(hours))
        .groupBy("account_id", "txn_timestamp").agg(F.min("pos").alias("pos")))
    openers = cut_lineage(openers)

    # For each opener, the first opener more than a window later.
    asked = openers.select(
        "account_id", "pos",
        F.explode(F.array(
            F.struct(F.col("txn_timestamp").alias("at"), F.lit(0).alias("asks")),
            F.struct((F.col("txn_timestamp") + _hours(hours)).alias("at"), F.lit(1).alias("asks")))).alias("q"),
    ).select("account_id", "pos", "q.at", "q.asks")
    asked = skew.cut_into_pieces(asked, key, ["at", "asks", "pos"])
    found = skew.running_last(asked, key, ["at", "asks", "pos"], F.when(F.col("asks") == 0, F.col("pos")),
                              "next_pos", backward=True)
    jumps = cut_lineage(found.where("asks = 1 and next_pos is not null").select("account_id", "pos", "next_pos"))

    reached = cut_lineage(openers.groupBy("account_id").agg(F.min("pos").alias("pos")))
    while not jumps.isEmpty():
        onward = reached.join(jumps, ["account_id", "pos"]).select("account_id", F.col("next_pos").alias("pos"))
        reached = cut_lineage(reached.unionByName(onward).distinct())
        further = jumps.select("account_id", F.col("pos").alias("next_pos"), F.col("next_pos").alias("far_pos"))
        jumps = cut_lineage(jumps.join(further, ["account_id", "next_pos"])
                            .select("account_id", "pos", F.col("far_pos").alias("next_pos")))

    chosen = reached.withColumn("_chosen", F.lit(True))
    opened = placed.join(chosen, ["account_id", "pos"], "left")
    opening = F.when(F.col("_chosen"), F.struct("txn_timestamp", "transaction_id", "customer_id"))
    covered = skew.running_last(opened, key, _ORDER, opening, "c")
    return (
        covered.where(F.col("txn_timestamp") <= F.col("c.txn_timestamp") + _hours(hours))
        .select("account_id", F.col("c.txn_timestamp").alias("cluster_ts"), F.col("c.transaction_id").alias("cluster_txn_id"),
                F.col("c.customer_id").alias("cluster_customer_id"), "transaction_id", "txn_timestamp", "amount_base"))


def summarise(members: DataFrame) -> DataFrame:
    """One row per cluster. Grouping starts with account_id, so ordinary accounts
    need no further shuffle."""
    return members.groupBy("account_id", "cluster_ts", "cluster_txn_id", "cluster_customer_id").agg(
        F.count(F.lit(1)).alias("size"), F.sum("amount_base").alias("total"),
        F.max("txn_timestamp").alias("last_ts"))
