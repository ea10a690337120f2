"""Alerts derived from the hit log: scored, de-duplicated, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import scoring, text
from tallyhound.functions.params import RuleSetting
from tallyhound.operators import flows, skew
from tallyhound.operators.rules import RANGED


def rule_weights(settings: dict[str, RuleSetting]) -> Column:
    """Weight of the rule in `rule_code`; 0 for a rule without settings."""
    out = F.lit(0)
    for code, s in settings.items():
        out = F.when(F.col("rule_code") == code, F.lit(s.weight)).otherwise(out)
    return out


def score_hits(hits: DataFrame, customers: DataFrame, settings: dict[str, RuleSetting],
               prior: Column | None = None) -> DataFrame:
    """Add the score breakdown. A hit without a known customer gets no customer uplift."""
    known = customers.select("customer_id", F.col("risk_rating").alias("_rating"),
                             F.col("is_politically_exposed").alias("_pep"))
    rating = F.when(F.col("_pep").isNotNull() | F.col("_rating").isNotNull(), F.coalesce("_rating", F.lit("LOW")))
    parts = scoring.breakdown(rule_weights(settings), F.col("jurisdiction_uplift"), rating, F.col("_pep"),
                              F.col("magnitude_ratio"), prior if prior is not None else F.lit(0).cast("long"))
    return hits.join(known, "customer_id", "left").withColumn("score_breakdown", parts).drop("_rating", "_pep")


def undisposed(hits: DataFrame, disposals: DataFrame) -> DataFrame:
    """Hits that still count: a repeat after its alert was disposed is ignored."""
    done = disposals.groupBy("dedup_key").agg(F.min("disposed_at").alias("_disposed"))
    return hits.join(done, "dedup_key", "left").where(
        "_disposed is null or detected_at <= _disposed").drop("_disposed")


def derive_alerts(hits: DataFrame, customers: DataFrame, settings: dict[str, RuleSetting],
                  evidence: DataFrame | None = None) -> DataFrame:
    """One alert per dedup key, from all hits ever logged.

    The first hit gives the alert its subject and text; amount is the largest seen;
    the last hit is scored again with the number of hits before it. All of this is
    one aggregate with a map-side combine, whatever the number of hits per key.

    With `evidence` (the log over several runs) repeated citations count once. In
    a single run no transaction is cited twice under a key, so the counts add up.
    """
    has_batch = "batch_id" in hits.columns
    order = F.struct(*([F.col("batch_id")] if has_batch else []), "first_ts", "anchor_txn_id")
    at = F.col("detected_at") if "detected_at" in hits.columns else F.col("last_ts")
    merged = hits.groupBy("dedup_key").agg(
        F.count(F.lit(1)).alias("trigger_count"),
        F.max("evidence_amount_base").alias("evidence_amount_base"),
        F.sum("evidence_count").alias("evidence_count"), F.max("evidence_count").alias("_largest"),
        F.min_by(F.struct("rule_code", "typology", "customer_id", "account_id", "explanation"), order).alias("first_hit"),
        F.max_by(F.struct("jurisdiction_uplift", "magnitude_ratio"), order).alias("last_hit"),
        F.min(at).alias("first_detected_at"), F.max(at).alias("last_detected_at"))
    if evidence is not None:
        cited = evidence.select("dedup_key", "transaction_id").distinct().groupBy("dedup_key").agg(
            F.count(F.lit(1)).alias("evidence_count"))
        # A time window's evidence only grows from run to run, so its last count holds all of it.
        ranged = F.col("first_hit.rule_code").isin(RANGED)
        merged = merged.drop("evidence_count").join(cited, "dedup_key", "left").withColumn(
            "evidence_count", F.when(ranged, F.col("_largest")).otherwise(F.coalesce("evidence_count", F.lit(0))))
    flat = merged.select("*", "first_hit.*", "last_hit.*").drop("first_hit", "last_hit")
    scored = score_hits(flat, customers, settings, F.col("trigger_count") - 1)
    return scored.select(
        text.readable_ref("ALT", F.col("first_detected_at"), F.col("dedup_key")).alias("alert_ref"),
        "dedup_key", "customer_id", "account_id", "rule_code", "typology",
        F.col("score_breakdown.total").alias("risk_score"),
        scoring.score_band(F.col("score_breakdown.total")).alias("severity"),
        F.lit("OPEN").alias("status"), "explanation", "evidence_amount_base", "evidence_count", "score_breakdown",
        "trigger_count", "first_detected_at", "last_detected_at",
        F.lit(None).cast("string").alias("disposition"), F.lit(None).cast("string").alias("disposition_reason"),
        F.lit(None).cast("string").alias("disposed_by"), F.lit(None).cast("timestamp_ntz").alias("disposed_at"))


def merged_evidence(evidence: DataFrame) -> DataFrame:
    """Each alert's cited transactions once, with the place of the first citation."""
    has_batch = "batch_id" in evidence.columns
    order = F.struct(*([F.col("batch_id")] if has_batch else []), "position", "txn_timestamp")
    return evidence.groupBy("dedup_key", "transaction_id").agg(
        F.min(order).alias("cited_order"), F.first("rule_code").alias("rule_code"))


def with_status(alerts: DataFrame, replayed: DataFrame) -> DataFrame:
    """Alerts with the state the lifecycle replay ended in (keyed by alert_ref)."""
    state = replayed.select(F.col("entity_id").alias("alert_ref"), F.col("state").alias("_state"),
                            *[F.col(c).alias(f"_{c}") for c in _DISPOSED])
    joined = alerts.join(state, "alert_ref", "left")
    return joined.withColumns({"status": F.coalesce("_state", "status"), **{c: F.col(f"_{c}") for c in _DISPOSED}}).drop(
        "_state", *[f"_{c}" for c in _DISPOSED])


_DISPOSED = ["disposition", "disposition_reason", "disposed_by", "disposed_at"]


# --- queue and lookups -----------------------------------------------------

def search(alerts: DataFrame, status: str | None = None, severity: str | None = None, rule_code: str | None = None,
           customer_id: str | None = None, min_score: int | None = None) -> DataFrame:
    wanted = {"status": status, "severity": severity, "rule_code": rule_code, "customer_id": customer_id}
    for column, value in wanted.items():
        if value is not None:
            alerts = alerts.where(F.col(column) == value)
    return alerts if min_score is None else alerts.where(F.col("risk_score") >= min_score)


PAGE_LIMIT = 200


def page(df: DataFrame, number: int, size: int, sort_by: str, unique: str, descending: bool = True,
         limit: int = PAGE_LIMIT) -> DataFrame:
    """One page. `unique` breaks ties, so pages never overlap."""
    size = min(size, limit)
    first = F.desc(sort_by) if descending else F.asc(sort_by)
    return df.orderBy(first, F.asc(unique)).offset(number * size).limit(size)


def page_envelope(df: DataFrame, number: int, size: int, limit: int = PAGE_LIMIT) -> DataFrame:
    """Totals that go with a page."""
    size = min(size, limit)
    pages = F.ceil(F.col("total_elements") / size)
    return df.agg(F.count(F.lit(1)).alias("total_elements")).select(
        F.lit(number).alias("page"), F.lit(size).alias("size"), "total_elements", pages.alias("total_pages"),
        F.lit(number == 0).alias("first"), (F.lit(number + 1) >= pages).alias("last"))


def queue_rows(alerts: DataFrame, customers: DataFrame) -> DataFrame:
    """List view: names and accounts masked, evidence counted."""
    names = customers.select("customer_id", text.full_name(F.col("first_name"), F.col("last_name")).alias("_name"))
    return alerts.join(names, "customer_id", "left").select(
        "alert_ref", "customer_id", text.mask_name(F.coalesce("_name", F.lit("Unknown"))).alias("customer_name_masked"),
        text.mask_account(F.col("account_id")).alias("account_masked"), "rule_code", "typology", "risk_score", "severity",
        "status", "evidence_amount_base", "evidence_count", "trigger_count", "disposition",
        "first_detected_at", "last_detected_at")


def detail(alerts: DataFrame, customers: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Full view of each alert, with its case if it has one."""
    names = customers.select("customer_id", text.full_name(F.col("first_name"), F.col("last_name")).alias("_name"))
    out = alerts.join(names, "customer_id", "left").withColumn("customer_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name")
    if members is None:
        return out.withColumn("case_ref", F.lit(None).cast("string"))
    return out.join(members.select("alert_ref", "case_ref"), "alert_ref", "left")


def detail_evidence(alerts: DataFrame, evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """The transactions behind each alert, one row each, sorted on read by time."""
    cited = evidence.select("dedup_key", "transaction_id").distinct()
    wanted = alerts.select("alert_ref", "dedup_key").join(cited, "dedup_key")
    rows = ledger.select("transaction_id", "txn_timestamp", "direction", "amount", "currency", "amount_base",
                         "channel", "counterparty_name", "counterparty_country")
    return wanted.join(rows, "transaction_id").drop("dedup_key")


def _matching(rows: DataFrame, key: str, wanted: str | DataFrame) -> DataFrame:
    """Rows with one value of `key`, or with any that the column of that name in `wanted` holds."""
    if isinstance(wanted, DataFrame):
        return rows.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.where(F.col(key) == wanted)


def by_customer(alerts: DataFrame, customers: str | DataFrame) -> DataFrame:
    """Alerts of one or more customers, each customer's from the highest score down."""
    return _matching(alerts, "customer_id", customers).orderBy("customer_id", F.desc("risk_score"), "alert_ref")


def by_ref(alerts: DataFrame, refs: str | DataFrame) -> DataFrame:
    return _matching(alerts, "alert_ref", refs)


def by_key(alerts: DataFrame, keys: str | DataFrame) -> DataFrame:
    return _matching(alerts, "dedup_key", keys)


def by_case(members: DataFrame, alerts: DataFrame, cases: str | DataFrame) -> DataFrame:
    return alerts.join(_matching(members, "case_ref", cases).select("alert_ref").distinct(), "alert_ref", "left_semi")


def timeline(ledger: DataFrame, alerts: DataFrame, evidence: DataFrame, limit: int = 100, cap: int = 500, windows: DataFrame | None = None,
             hours: int = 48) -> DataFrame:
    """Each customer's newest transactions with the alerts that cite them.

    One row per (transaction, alert), ranked by score; a transaction no alert
    cites keeps one row. `windows` are the hits (dedup_key, account_id, first_ts) whose evidence is logged as an anchor and
    a window of `hours`; only the transactions that are shown are looked up in them.
    """
    n = min(limit, cap)
    top = skew.top_n(ledger, ["customer_id"], [F.desc("txn_timestamp"), F.asc("transaction_id")], n, "place").select(
        "customer_id", "place", "transaction_id", "txn_timestamp", "account_id", "direction", "amount", "currency",
        "amount_base", "channel", "counterparty_name", "counterparty_country")
    listed = evidence.select("dedup_key", "transaction_id")
    if windows is not None:
        shown = flows.outflows_of(windows.select("dedup_key", "account_id", "first_ts").distinct(), top, F.col("direction") == "DEBIT", hours)
        listed = listed.unionByName(shown.select("dedup_key", "transaction_id"))
    cited = (
        listed.withColumnRenamed("transaction_id", "_txn").distinct()
        .join(alerts.select("dedup_key", "alert_ref", "risk_score", F.col("customer_id").alias("_customer")), "dedup_key")
        .drop("dedup_key"))
    mine = (F.col("transaction_id") == F.col("_txn")) & (F.col("customer_id") == F.col("_customer"))
    return top.join(cited, mine, "left").drop("_txn", "_customer")
