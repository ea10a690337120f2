"""Tables the registered queries share, derived from the given test tables.

The rule thresholds are set so that every rule fires on this data. Findings and
alerts are written once per session and data folder, as the detection job does.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound import refs
from tallyhound.functions.params import RuleSetting, load_settings
from tallyhound.operators import alerts as al
from tallyhound.operators import cases as cs
from tallyhound.operators import lifecycle as lc
from tallyhound.operators import rules
from tallyhound.plans.ingest import load_masters
from tallyhound.plans.settings_log import SettingsLog
from tallyhound.session import stored, work_folder
from tallyhound.streaming.job import StreamJob
from checks import sampledata as sd

AS_OF = datetime(2024, 2, 1)
OPENED_AT = "2024-02-01 00:00:00"
# Days at which the stream query cuts its micro-batches; together they hold the whole ledger.
STREAM_CUTS = ["0001-01-01", "2024-01-06", "2024-01-12", "2024-01-18", "2024-01-24", "9999-01-01"]
INSTITUTION = "First Example Bank"

RULES = [
    ("CTR_THRESHOLD", "THRESHOLD_BREACH", True, 25, "MEDIUM", '{"thresholdBase":10000}'),
    ("STRUCTURING", "STRUCTURING", True, 35, "HIGH", '{"minCount":3,"windowHours":24,"lowerBound":5000,"upperBound":9999.99}'),
    ("RAPID_MOVEMENT", "LAYERING", True, 35, "HIGH", '{"windowHours":48,"outflowRatio":0.80,"minDepositBase":10000}'),
    ("HIGH_RISK_JURISDICTION", "JURISDICTION_RISK", True, 30, "HIGH", "{}"),
    ("BEHAVIORAL_DEVIATION", "BEHAVIOURAL_ANOMALY", True, 25, "MEDIUM",
     '{"multiplier":3.0,"baselineDays":20,"minBaselineTxns":5,"minDailyBase":25000}'),
    ("ROUND_AMOUNT_PATTERN", "ROUND_AMOUNT", True, 15, "LOW",
     '{"minCount":2,"windowHours":240,"roundingUnit":10000,"minAmountBase":50000}'),
]

_settings: dict[str, dict[str, RuleSetting]] = {}
_tables: dict[tuple[str, str, str], str] = {}
_found: dict[tuple[str, str], rules.Findings] = {}


def settings(spark: SparkSession) -> dict[str, RuleSetting]:
    app = spark.sparkContext.applicationId
    if app not in _settings:
        _settings[app] = load_settings(refs.rule_config(spark, RULES))
    return _settings[app]


def findings(spark: SparkSession, sf: str, code: str) -> rules.Findings:
    return rules.registered(code).find(rules.RuleContext(sd.ledger(spark, sf)), settings(spark)[code])


def _written(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _tables:
        path = work_folder(spark, name)
        build().write.parquet(path)
        _tables[key] = path
    return spark.read.parquet(_tables[key])


def stored_job(spark: SparkSession, sf: str) -> str:
    """Folder of the continuous job after one batch, the feed with faults, under the threshold rule."""
    key = (spark.sparkContext.applicationId, sf, "job")
    if key not in _tables:
        job = StreamJob(work_folder(spark, "job"), lambda: sd.accounts(spark, sf), lambda: AS_OF,
                        config=lambda: refs.rule_config(spark, RULES[:1]), strict=False)
        job.process(sd.dirty_transactions(spark, sf), 0)
        _tables[key] = job.path
    return _tables[key]


def stored_stream(spark: SparkSession, sf: str, raw: DataFrame, whole_window: bool = False) -> StreamJob:
    """The continuous job after the whole ledger went through it in micro-batches, under all rules."""
    key = (spark.sparkContext.applicationId, sf, "stream-whole" if whole_window else "stream")
    job = StreamJob(_tables.get(key) or work_folder(spark, "stream-job"), lambda: sd.accounts(spark, sf), lambda: AS_OF,
                    config=lambda: refs.rule_config(spark, RULES), strict=False, whole_window=whole_window)
    if key not in _tables:
        for i, (start, end) in enumerate(zip(STREAM_CUTS, STREAM_CUTS[1:])):
            job.process(raw.where(f"txn_timestamp >= '{start}' and txn_timestamp < '{end}'"), i)
        _tables[key] = job.path
    return job


def written_files(spark: SparkSession, sf: str, kind: str, write) -> str:
    """Folder of files that `write` made once per session."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _tables:
        path = work_folder(spark, kind)
        write(path)
        _tables[key] = path
    return _tables[key]


def stored_masters(spark: SparkSession, sf: str, customers: DataFrame, accounts: DataFrame) -> str:
    key = (spark.sparkContext.applicationId, sf, "masters")
    if key not in _tables:
        path = work_folder(spark, "masters")
        load_masters(customers, accounts, path, 0, AS_OF, spread=spark.sparkContext.defaultParallelism)
        _tables[key] = path
    return _tables[key]


def stored_settings(spark: SparkSession, sf: str) -> SettingsLog:
    """The change logs after two batches of changes, parted at the middle of their numbers."""
    key = (spark.sparkContext.applicationId, sf, "settings-log")
    if key not in _tables:
        log = SettingsLog(work_folder(spark, "settings-log"))
        installed, changes = sd.settings_changes(spark, sf)
        log.install(installed, AS_OF)
        middle = F.lit(changes["fx"].agg(F.max("seq")).first()[0] // 2)
        log.apply(1, **{k: c.where(F.col("seq") <= middle) for k, c in changes.items()})
        log.apply(2, **{k: c.where(F.col("seq") > middle) for k, c in changes.items()})
        _tables[key] = log.path
    return SettingsLog(_tables[key])


def all_findings(spark: SparkSession, sf: str) -> rules.Findings:
    return rules.detect(rules.RuleContext(sd.ledger(spark, sf)), settings(spark))


def kept_findings(spark: SparkSession, sf: str) -> rules.Findings:
    """All findings over stored patterns, so that hits and evidence do not search for them anew."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _found:
        _found[key] = rules.detect(rules.RuleContext(sd.ledger(spark, sf), keep=lambda df: stored(df, "patterns")), settings(spark))
    return _found[key]


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf, "hits", lambda: kept_findings(spark, sf).hits)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return rules.expand_evidence(kept_findings(spark, sf).evidence, hits(spark, sf), sd.ledger(spark, sf), settings(spark))
    return _written(spark, sf, "evidence", build)


def logged_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence as the job logs it: of rapid movements the anchor alone."""
    return _written(spark, sf, "logged_evidence", lambda: kept_findings(spark, sf).evidence)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """The hits whose evidence is an anchor and a window."""
    return hits(spark, sf).where(F.col("rule_code").isin(rules.RANGED))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf, "alerts", lambda: al.derive_alerts(hits(spark, sf), sd.customers(spark, sf), settings(spark)))


def disposed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts with a decision on nine in ten, taken some hours after detection."""
    a = alerts(spark, sf)
    n = F.regexp_extract("dedup_key", "([0-9]+)[^0-9]*$", 1).cast("long")
    kind = (
        F.when(n % 10 == 9, F.lit(None)).when(n % 10 < 6, "FALSE_POSITIVE").when(n % 10 == 6, "TRUE_POSITIVE")
        .when(n % 10 == 7, "ESCALATED_TO_SAR").otherwise("CLEARED_NO_ACTION"))
    hours = F.make_dt_interval(hours=(n % 50 - 1).cast("int"), mins=(n % 60).cast("int"))
    return a.withColumns({
        "disposition": kind.cast("string"),
        "status": F.when(kind.isNotNull(), "CLOSED").when(n % 20 == 9, "IN_REVIEW").otherwise("OPEN"),
        "disposed_at": F.when(kind.isNotNull(), F.col("first_detected_at") + hours)})


def case_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One case per customer over all its alerts; some customers also ask for a
    foreign alert or an unknown one and must be refused."""
    a = alerts(spark, sf).select("alert_ref", "customer_id")
    number = F.substring("customer_id", 6, 20).cast("long")
    base = a.select(F.concat(F.lit("CASE|"), F.col("customer_id")).alias("case_key"), "customer_id", "alert_ref",
                    number.alias("n"))
    unknown = base.where("n % 10 = 7").select("case_key", "customer_id", F.lit("ALT-UNKNOWN").alias("alert_ref"), "n").distinct()
    foreign = a.groupBy((number + 1).alias("n")).agg(F.min("alert_ref").alias("alert_ref")).where(
        "n % 10 = 5").select(F.concat(F.lit("CASE|CUST_"), F.col("n").cast("string")).alias("case_key"),
                             F.concat(F.lit("CUST_"), F.col("n").cast("string")).alias("customer_id"), "alert_ref", "n")
    rows = base.unionByName(unknown).unionByName(foreign)
    return rows.select(
        "case_key", "customer_id", F.when(F.col("n") % 2 == 0, " ").otherwise(F.concat(F.lit("Review of "), F.col("customer_id"))).alias("title"),
        F.concat(F.lit("analyst"), (F.col("n") % 3).cast("string")).alias("opened_by"),
        F.lit(OPENED_AT).cast("timestamp_ntz").alias("opened_at"), "alert_ref")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf, "cases", lambda: cs.open_cases(case_requests(spark, sf), alerts(spark, sf)))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf, "members", lambda: cs.members(case_requests(spark, sf), cases(spark, sf)))


def case_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests to move the case of their user."""
    kind = F.col("event_type")
    e = F.col("event_id")
    named = sd.table(spark, sf, "events").withColumn("customer_id", F.concat(F.lit("CUST_"), F.col("user_id").cast("string")))
    return named.join(cases(spark, sf).select("case_ref", "customer_id"), "customer_id").select(
        F.col("case_ref").alias("entity_id"), F.col("ts").alias("occurred_at"), e.alias("event_seq"),
        F.when(kind.isin("click", "error"), "INVESTIGATING").when(kind == "view", "PENDING_APPROVAL").otherwise("CLOSED").alias("target"),
        F.when(kind == "purchase", F.when(e % 4 == 0, "ESCALATED_TO_SAR").when(e % 4 == 1, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE")).alias("disposition"),
        F.when(kind == "purchase", F.when(e % 7 == 0, " ").otherwise("reviewed")).alias("reason"),
        F.concat(F.lit("analyst"), (e % 5).cast("string")).alias("actor"), (e % 3 == 0).alias("is_senior"))


def replayed_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf, "replayed_cases", lambda: lc.replay(case_events(spark, sf), lc.CASE))


def closed_cases(spark: SparkSession, sf: str) -> DataFrame:
    return cs.with_state(cases(spark, sf), lc.current_state(replayed_cases(spark, sf), lc.CASE))
