"""The continuous job: validate, store, detect and log, one micro-batch at a time.

Rows may arrive any amount of time late: every batch re-reads the history around its own rows
or, on request, around the whole batch (see `plans.context`), so no watermark cuts anything off and no batch reads more days than
that.

A batch's summary is written last and commits it: readers see the tables of committed batches only, so
never hits without their evidence or half a batch. A batch that stopped on the way is written anew, in the same
folders; one that is committed is not touched again. Batches come in order, numbered from 0.

A rule that fails holds up nothing. It is noted as pending, and runs with the next batch over the rows of all
batches it has missed; its findings are logged there.
"""

from __future__ import annotations

import dataclasses
import time
from dataclasses import dataclass
from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhound import refs
from tallyhound.functions.params import load_settings
from tallyhound.operators import flows, rules
from tallyhound.plans import context, detection, store
from tallyhound.plans.keys import KeyTable
from tallyhound.plans.ingest import audit_row, ingest, source_ref, summarise
from tallyhound.schemas import LEDGER_COLUMNS


@dataclass(frozen=True)
class StreamJob:
    """Where the job reads its masters and keeps its tables.

    The loaders are called for every batch, so changed settings and lists take
    effect with the next one.
    """
    path: str
    accounts: Callable[[], DataFrame]
    now: Callable[[], datetime]
    fx: Callable[[], DataFrame] | None = None
    config: Callable[[], DataFrame] | None = None
    jurisdictions: Callable[[], DataFrame] | None = None
    watchlist: Callable[[], DataFrame] | None = None
    strict: bool = True
    buckets: int = store.BUCKETS
    # Tasks to deal a batch's raw rows to, where they come in few files.
    spread: int | None = None
    # Account rules read one window over the whole batch for all its accounts, not only the surroundings of each account's own rows.
    whole_window: bool = False

    @property
    def keys(self) -> KeyTable:
        """Keys of all alerts opened so far."""
        return KeyTable(f"{self.path}/alert_keys", "dedup_key")

    @property
    def ledger_path(self) -> str:
        return f"{self.path}/ledger"

    def start(self, raw: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (raw.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())

    def process(self, raw: DataFrame, batch_id: int) -> None:
        spark = raw.sparkSession
        if batch_id <= self.last_committed(spark):
            return
        as_of = self.now()
        if "row_number" not in raw.columns:
            raw = raw.withColumn("row_number", F.monotonically_increasing_id() + 1)
        began = time.monotonic()
        source = f"stream-{batch_id}"
        rates = self.fx() if self.fx else refs.fx_rates(spark)
        # The raw rows are read once; everything after reads the checked rows as stored.
        done = ingest(raw, self.accounts(), rates, as_of, strict=self.strict, keep=lambda df: store.kept(df, f"{self.path}/checked", batch_id),
                      spread=self.spread)
        store.write_ledger(done.accepted, self.ledger_path, batch_id, self.buckets)
        store.write_batch(done.rejected.withColumn("batch_ref", source_ref(source, as_of)), f"{self.path}/rejects", batch_id)
        self._detect_and_commit(done.checked, batch_id, as_of, began)

    def process_accepted(self, ledger: DataFrame, batch_id: int) -> None:
        """A batch of ledger rows that were accepted elsewhere: stored and judged as they are, none is refused."""
        spark = ledger.sparkSession
        if batch_id <= self.last_committed(spark):
            return
        as_of, began = self.now(), time.monotonic()
        store.write_ledger(ledger.select(*LEDGER_COLUMNS), self.ledger_path, batch_id, self.buckets)
        kept = store.read_ledger_log(spark, self.ledger_path).where(F.col("batch_id") == batch_id)
        self._detect_and_commit(kept.withColumn("failed", F.lit(None).cast("int")), batch_id, as_of, began)

    def _detect_and_commit(self, checked: DataFrame, batch_id: int, as_of: datetime, began: float) -> None:
        """Run the rules over a stored batch, then write its summary."""
        spark = checked.sparkSession
        result, opened = self.detect(spark, batch_id, as_of)
        summary = summarise(checked, f"stream-{batch_id}", as_of, alerts=opened, duration_ms=int((time.monotonic() - began) * 1000))
        stamped = summary.withColumns({"hits": F.lit(result.hits).cast("long"), "failed_rules": F.lit(",".join(result.failed_rules))})
        made = spark.createDataFrame([stamped.first()], stamped.schema)
        store.write_batch(audit_row(made, as_of), f"{self.path}/audit", batch_id)
        store.write_batch(made, f"{self.path}/batches", batch_id)

    def last_committed(self, spark: SparkSession) -> int:
        return store.last_committed(spark, f"{self.path}/batches")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the job (ledger, rejects, batches, audit, answers ...), committed batches only."""
        return spark.read.parquet(f"{self.path}/{name}").where(F.col("batch_id") <= self.last_committed(spark))

    def contexts(self, spark: SparkSession, batches: list[int], settings, batch_id: int) -> dict[str, rules.RuleContext]:
        """What the rules read for the rows of some batches: nothing written after the last of them. The history
        that three account rules share is written once, under the running batch."""
        log = store.read_ledger_log(spark, self.ledger_path).where(F.col("batch_id") <= max(batches))
        rewritten = store.rewrites(spark, self.ledger_path).where(F.col("batch_id") <= max(batches))
        fresh = log.where(F.col("batch_id").isin(batches)).select(*LEDGER_COLUMNS)
        lists = dict(jurisdictions=self.jurisdictions() if self.jurisdictions else None,
                     watchlist=self.watchlist() if self.watchlist else None, fresh=fresh)

        def history(key: str, reach) -> DataFrame:
            return context.rows_in_reach(log, reach(fresh, settings), key, self.buckets, rewritten).select(*LEDGER_COLUMNS)
        if self.whole_window:
            near = context.account_window(log, fresh, settings, rewritten).select(*LEDGER_COLUMNS)
        else:
            near = history("account_id", context.account_reach)
        around = store.kept(near, f"{self.path}/history", batch_id)
        return {
            rules.TRANSACTION: rules.RuleContext(fresh, **lists),
            rules.ACCOUNT_WINDOW: rules.RuleContext(around, **lists),
            rules.CUSTOMER_WINDOW: rules.RuleContext(history("customer_id", context.customer_reach), **lists),
        }

    def detect(self, spark: SparkSession, batch_id: int, as_of: datetime) -> tuple[detection.RunResult, int]:
        """Run the rules over a batch and those that earlier batches miss; also the number of alerts opened."""
        settings = load_settings(self.config() if self.config else refs.rule_config(spark))
        contexts = self.contexts(spark, [batch_id], settings, batch_id)
        result = detection.run_detection(contexts, settings, f"{self.path}/findings", batch_id, as_of)
        missed = self.pending(spark, batch_id - 1)
        left = {code: [batch_id] for code in result.failed_rules}
        for code, batches in missed.items():
            late = detection.run_detection(self.contexts(spark, batches, settings, batch_id), settings, f"{self.path}/findings", batch_id, as_of, [code], "{}-late")
            result = dataclasses.replace(result, hits=result.hits + late.hits)
            if late.failed_rules:
                left[code] = sorted({*batches, *left.get(code, [])})
        store.write_batch(spark.createDataFrame([(c, b) for c, n in sorted(left.items()) for b in n], "rule_code string, missed bigint"), f"{self.path}/pending", batch_id)

        found = detection.read_hits(spark, f"{self.path}/findings").where(F.col("batch_id") == batch_id)
        evidence = detection.read_evidence(spark, f"{self.path}/findings").where(F.col("batch_id") == batch_id)
        asked = store.kept(found.select("dedup_key").distinct(), f"{self.path}/keys", batch_id)
        self.keys.add(self.keys.new(asked, batch_id), batch_id)
        new = spark.read.schema("dedup_key string").parquet(self.keys.folder(0, batch_id))
        answers = event_answers(contexts[rules.TRANSACTION].fresh, found, evidence, asked.join(new, "dedup_key", "left_anti"), result.duration_ms)
        store.write_batch(answers, f"{self.path}/answers", batch_id)
        return result, new.count()

    def pending(self, spark: SparkSession, batch_id: int) -> dict[str, list[int]]:
        """Rules that had failed by then, each with the batches it has missed."""
        out: dict[str, list[int]] = {}
        for r in store.read_log(spark, f"{self.path}/pending", "rule_code string, missed bigint").where(F.col("batch_id") == batch_id).orderBy("rule_code", "missed").collect():
            out.setdefault(r["rule_code"], []).append(r["missed"])
        return out

    def hits(self, spark: SparkSession) -> DataFrame:
        return detection.read_hits(spark, f"{self.path}/findings").where(F.col("batch_id") <= self.last_committed(spark))

    def evidence(self, spark: SparkSession) -> DataFrame:
        return detection.read_evidence(spark, f"{self.path}/findings").where(F.col("batch_id") <= self.last_committed(spark))


def event_answers(fresh: DataFrame, hits: DataFrame, evidence: DataFrame, earlier: DataFrame, latency_ms: int) -> DataFrame:
    """Per event: hits of this batch that cite it, and how many of those opened a new alert."""
    known = earlier.select("dedup_key").distinct().withColumn("_known", F.lit(True))
    marked = hits.join(known, "dedup_key", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
    listed = (
        evidence.select("transaction_id", "dedup_key").distinct()
        .join(marked.select("dedup_key", "is_new").distinct(), "dedup_key")
        .groupBy("transaction_id").agg(F.count(F.lit(1)).alias("covered"), F.count_if("is_new").alias("covered_new")))
    windows = marked.where(F.col("rule_code").isin(rules.RANGED)).select("account_id", "first_ts", "last_ts", "is_new")
    debits = fresh.where("direction = 'DEBIT'").select("account_id", "transaction_id", "txn_timestamp")
    cited = listed.unionByName(flows.windows_covering(debits, windows)).groupBy("transaction_id").agg(
        F.sum("covered").alias("rules_triggered"), F.sum("covered_new").alias("alerts_created"))
    return fresh.select("transaction_id").join(cited, "transaction_id", "left").select(
        "transaction_id", F.lit(True).alias("accepted"), F.coalesce("rules_triggered", F.lit(0)).alias("rules_triggered"),
        F.coalesce("alerts_created", F.lit(0)).alias("alerts_created"), F.lit(latency_ms).cast("long").alias("detection_ms"))


def stateless_hits(ledger_stream: DataFrame, settings, jurisdictions: DataFrame | None = None,
                   watchlist: DataFrame | None = None) -> DataFrame:
    """Hits of the single-transaction rules straight from the stream, in append mode."""
    ctx = rules.RuleContext(ledger_stream, jurisdictions, watchlist)
    found = [r.find(ctx, settings[r.code]).hits for r in rules.active_rules(settings) if r.scope == rules.TRANSACTION]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_repeats(raw_stream: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Optional: forget repeated transaction ids that arrive within `delay` of each other."""
    return raw_stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["transaction_id"])
