"""Account-window rules with state in the engine: low latency, bounded lateness.

The continuous job (`streaming.job`) re-reads the ledger around every batch, so rows may be any amount late.
Here the rows an account's open windows may still need are kept in a state store instead, and nothing is
read back. A window is judged once, when the watermark has passed its end: rows that arrive within `delay`
of the latest row are counted whatever their order, later ones are dropped by the engine. The findings
are those of the batch rules over all rows that were not late, for windows that have ended, however the
rows were cut into micro-batches and across restarts.

One shuffle on the account serves all three rules. Accounts share the state of a group, a hash of their id, and
what a micro-batch brings for a group is one value: a call to the store costs more than an account's rows do, so their
number is to go neither with the accounts nor with the rows. New rows are appended to the group's list without reading it;
a timer at the end of the group's earliest open window judges what has ended, account by account, writes the rest
back and sets the next timer. An account keeps the rows of its longest window and `delay`.

Repeated transaction ids are to be dropped before (`streaming.job.drop_repeats`): a window that was judged
is not judged again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyhound.functions.params import RuleSetting
from tallyhound.operators import rules
from tallyhound.plans import store

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CLUSTER_RULES = {"STRUCTURING": 1, "ROUND_AMOUNT_PATTERN": 2}
FLOW_RULE = "RAPID_MOVEMENT"
DEPOSIT, DEBIT = 4, 8
# Microseconds.
HOUR, MS = 3_600_000_000, 1_000

# A kept row: time, id, owner, amount in hundredths, which rules it may count for.
Row = tuple[int, str, str, int, int]
# The store keeps rows in chunks, one list per column: the engine describes every stored value anew when it is read.
STATE = "account_id array<string>, at array<bigint>, transaction_id array<string>, customer_id array<string>, cents array<bigint>, marks array<int>"
STATE_COLUMNS = [c.split(" ")[0] for c in STATE.split(", ")]
CHUNK = 10_000
# Groups of accounts. A group's kept rows and those of one micro-batch pass through one task at once, so their number
# goes with the rows of a batch; a checkpoint keeps it.
GROUPS = 1024
# For clusters one row per member; for deposits one row each, with what left after it.
CLOSED = ("rule_code string, account_id string, anchor_ts bigint, anchor_txn_id string, anchor_customer_id string, anchor_cents bigint, "
          "at bigint, transaction_id string, cents decimal(28,0), outflow_count bigint")


def ended_clusters(rows: list[Row], span: int, least: int, until: int) -> tuple[list[list[Row]], int]:
    """(clusters whose window ended at `until` or before, number of rows that are done with). `rows` in order."""
    at = [r[0] for r in rows]
    out, i = [], 0
    while i < len(rows) and at[i] + span <= until:
        j = bisect_right(at, at[i] + span)
        if j - i >= least:
            out.append(rows[i:j])
            i = j
        else:
            i += 1
    return out, i


def ended_deposits(deposits: list[Row], debits: list[Row], span: int, until: int) -> tuple[list[tuple[Row, int, int]], int]:
    """(deposits whose window ended, with sum and count of the debits in it, both ends included; number of deposits done with)."""
    at = [r[0] for r in debits]
    total = [0]
    for r in debits:
        total.append(total[-1] + r[3])
    out, i = [], 0
    while i < len(deposits) and deposits[i][0] + span <= until:
        a, b = bisect_left(at, deposits[i][0]), bisect_right(at, deposits[i][0] + span)
        if b > a:
            out.append((deposits[i], total[b] - total[a], b - a))
        i += 1
    return out, i


@dataclass(frozen=True)
class Spans:
    """Window lengths in microseconds; a rule that is not active has none."""
    clusters: dict[str, tuple[int, int]]   # rule: (span, least count)
    flow: int | None

    def shortest(self, marks: int) -> int | None:
        """How long a row is kept at least: the shortest window it can open or close."""
        spans = [span for code, (span, _) in self.clusters.items() if marks & CLUSTER_RULES[code]]
        if self.flow is not None and marks & (DEPOSIT | DEBIT):
            spans.append(self.flow)
        return min(spans, default=None)


def spans_of(settings: dict[str, RuleSetting]) -> Spans:
    on = {r.code for r in rules.active_rules(settings)}
    found = {c: (int(settings[c].params["windowHours"]) * HOUR, int(settings[c].params["minCount"])) for c in CLUSTER_RULES if c in on}
    return Spans({c: x for c, x in found.items() if x[1] > 0}, int(settings[FLOW_RULE].params["windowHours"]) * HOUR if FLOW_RULE in on else None)


def judge(kept: list[Row], done: dict[str, tuple[int, str]], spans: Spans, until: int) -> tuple[list[tuple], list[Row], dict[str, tuple[int, str]], int | None]:
    """(what has ended, as CLOSED rows without the account; rows still needed; how far each rule is; end of the next window)."""
    kept = sorted(kept, key=lambda r: r[:2])
    done, out, ends, needed = dict(done), [], [], [False] * len(kept)

    def pending(code: str, mark: int) -> list[int]:
        behind = done.get(code)
        return [i for i, r in enumerate(kept) if r[4] & mark and (behind is None or r[:2] > behind)]

    def advance(code: str, places: list[int], n: int, span: int) -> None:
        if n:
            done[code] = kept[places[n - 1]][:2]
        for i in places[n:]:
            needed[i] = True
        if n < len(places):
            ends.append(kept[places[n]][0] + span)

    for code, (span, least) in spans.clusters.items():
        places = pending(code, CLUSTER_RULES[code])
        found, n = ended_clusters([kept[i] for i in places], span, least, until)
        for c in found:
            out += [(code, c[0][0], c[0][1], c[0][2], c[0][3], r[0], r[1], Decimal(r[3]), 0) for r in c]
        advance(code, places, n, span)
    if spans.flow is not None:
        places = pending(FLOW_RULE, DEPOSIT)
        debits = [r for r in kept if r[4] & DEBIT]
        found, n = ended_deposits([kept[i] for i in places], debits, spans.flow, until)
        out += [(FLOW_RULE, r[0], r[1], r[2], r[3], r[0], r[1], Decimal(total), count) for r, total, count in found]
        advance(FLOW_RULE, places, n, spans.flow)
        # Debits before every open deposit, and before any that may still arrive, are done with.
        first = min([kept[i][0] for i in places[n:]] + [until])
        for i, r in enumerate(kept):
            needed[i] |= bool(r[4] & DEBIT) and r[0] >= first
    return out, [r for r, n in zip(kept, needed) if n], done, min(ends, default=None)


def without_done(kept: list[Row], done: dict[str, tuple[int, str]]) -> list[Row]:
    """Kept rows without the marks of rules that are done with them: all that the next look has to know of this one."""
    behind = [(CLUSTER_RULES.get(code, DEPOSIT), place) for code, place in done.items()]
    return [(*r[:4], r[4] & ~sum(mark for mark, place in behind if r[:2] <= place)) for r in kept]


class AccountWindows(StatefulProcessor):
    """Keeps a group of accounts' rows until their windows have ended."""

    def __init__(self, spans: Spans):
        self.spans = spans
        self.shortest = {marks: spans.shortest(marks) for marks in range(2 * DEBIT)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", STATE)
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = []
        for part in rows:
            fresh = tuple(part[c].tolist() for c in STATE_COLUMNS)
            self.rows.appendValue(fresh)
            ends += [at + self.shortest[marks] for at, marks in zip(fresh[1], fresh[5]) if self.shortest[marks] is not None]
        if ends:
            self._wake(min(ends))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * MS
        accounts: dict[str, list[Row]] = {}
        for account_ids, *columns in self.rows.get():
            for account_id, r in zip(account_ids, zip(*columns)):
                accounts.setdefault(account_id, []).append(r)
        out, left, ends = [], [], []
        for account_id, rows in accounts.items():
            found, kept, done, end = judge(rows, {}, self.spans, until)
            out += [(o[0], account_id, *o[1:]) for o in found]
            left += [(account_id, *r) for r in without_done(kept, done)]
            # Debits alone open no window, but are kept while a deposit may still arrive before them.
            if kept:
                ends.append(end if end is not None else kept[-1][0] + self.spans.flow)
        self.timer.clear()
        if left:
            self.rows.put([tuple(map(list, zip(*left[i:i + CHUNK]))) for i in range(0, len(left), CHUNK)])
            self._wake(min(ends))
        else:
            self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CLOSED.split(", ")])

    def _wake(self, end: int) -> None:
        at = -(-end // MS)
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def closed_windows(ledger_stream: DataFrame, settings: dict[str, RuleSetting], delay: str, groups: int = GROUPS) -> DataFrame:
    """The stream of CLOSED rows of a ledger stream."""
    spans = spans_of(settings)
    marks = F.lit(0)
    tests = {1: ("STRUCTURING", rules.is_structuring), 2: ("ROUND_AMOUNT_PATTERN", rules.is_round), DEPOSIT: (FLOW_RULE, rules.is_deposit), DEBIT: (FLOW_RULE, lambda s: rules.is_debit())}
    for mark, (code, test) in tests.items():
        if code in spans.clusters or (code == FLOW_RULE and spans.flow is not None):
            marks = marks + F.when(test(settings[code]), mark).otherwise(0)
    timed = ledger_stream.withColumn("event_time", F.col("txn_timestamp").cast("timestamp")).withWatermark("event_time", delay)
    rows = timed.select(store.bucket_of(F.col("account_id"), groups).alias("account_group"), "account_id", "event_time", F.unix_micros("event_time").alias("at"), "transaction_id", "customer_id",
                        F.coalesce((F.col("amount_base") * 100).cast("long"), F.lit(0)).alias("cents"), marks.cast("int").alias("marks"))
    # Every row moves the watermark: a condition on its column is not pushed below it.
    rows = rows.where(F.when(F.col("event_time").isNotNull(), F.col("marks")) != 0)
    return rows.groupBy("account_group").transformWithStateInPandas(AccountWindows(spans), CLOSED, "append", "eventTime")


def findings_of(closed: DataFrame, settings: dict[str, RuleSetting]) -> rules.Findings:
    """Hits and evidence of CLOSED rows, as the batch rules write them."""
    ctx = rules.RuleContext(closed)
    time = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("anchor_ts", "at")}
    amount = (F.col("cents").cast("decimal(28,2)") / 100)
    found = []
    for code, shape in (("STRUCTURING", rules.structuring_findings), ("ROUND_AMOUNT_PATTERN", rules.round_findings)):
        if code in settings:
            members = closed.where(F.col("rule_code") == code).select(
                "account_id", time["anchor_ts"].alias("cluster_ts"), F.col("anchor_txn_id").alias("cluster_txn_id"),
                F.col("anchor_customer_id").alias("cluster_customer_id"), "transaction_id", time["at"].alias("txn_timestamp"), amount.cast("decimal(18,2)").alias("amount_base"))
            found.append(shape(ctx, members, settings[code]))
    if FLOW_RULE in settings:
        deposits = closed.where(F.col("rule_code") == FLOW_RULE).select(
            "account_id", "transaction_id", time["at"].alias("txn_timestamp"), F.col("anchor_customer_id").alias("customer_id"),
            (F.col("anchor_cents").cast("decimal(20,2)") / 100).cast("decimal(18,2)").alias("deposit_amount"),
            amount.cast("decimal(28,2)").alias("outflow_total"), "outflow_count")
        found.append(rules.rapid_findings(ctx, deposits, settings[FLOW_RULE]))
    return rules.Findings(reduce(DataFrame.unionByName, [f.hits for f in found]), reduce(DataFrame.unionByName, [f.evidence for f in found]))


@dataclass(frozen=True)
class StatefulJob:
    """Findings of a ledger stream, one folder per micro-batch under `path`."""
    path: str
    settings: dict[str, RuleSetting]
    delay: str = "1 day"
    groups: int = GROUPS

    def start(self, ledger_stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        spark = ledger_stream.sparkSession
        closed = closed_windows(ledger_stream, self.settings, self.delay, self.groups)
        before = spark.conf.get(STORE[0], None)
        spark.conf.set(*STORE)
        try:  # a query keeps the settings it was started with
            return (closed.writeStream.foreachBatch(self.log).outputMode("append").option("checkpointLocation", checkpoint)
                    .trigger(**(trigger or {"availableNow": True})).start())
        finally:
            spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)

    def log(self, closed: DataFrame, batch_id: int) -> None:
        kept = store.kept(closed, f"{self.path}/closed", batch_id)
        found = findings_of(kept, self.settings)
        # Evidence first: hits appear only once everything they cite is in place.
        store.write_batch(found.evidence, f"{self.path}/evidence", batch_id)
        store.write_batch(found.hits, f"{self.path}/hits", batch_id)

    def hits(self, spark: SparkSession) -> DataFrame:
        return store.read_log(spark, f"{self.path}/hits", rules.HIT_DDL)

    def evidence(self, spark: SparkSession) -> DataFrame:
        return store.read_log(spark, f"{self.path}/evidence", rules.EVIDENCE_DDL)
