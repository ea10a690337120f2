"""Cases: opened over alerts, replayed, queued; and the audit rows they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import scoring, text


def check_requests(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per requested case (case_key) with its `problem`, if it may not be opened.

    `requests` has case_key, customer_id, title, opened_by, opened_at and alert_ref, one
    row per alert asked for; a request without alerts has a null alert_ref. Where the rows
    of a request differ in the rest, the least in (opened_at, opened_by, title, customer_id) counts.
    """
    known = alerts.select("alert_ref", F.col("customer_id").alias("_owner"), "risk_score")
    linked = requests.join(known, "alert_ref", "left")
    first = requests.groupBy("case_key").agg(F.min(F.struct("opened_at", "opened_by", "title", "customer_id")).alias("_first"))
    linked = linked.join(first, "case_key")
    summary = linked.groupBy("case_key").agg(
        *[F.min(F.col("_first")[c]).alias(c) for c in ("customer_id", "title", "opened_by", "opened_at")],
        F.count("alert_ref").alias("alert_count"),
        F.count_if(F.col("alert_ref").isNotNull() & F.col("_owner").isNull()).alias("_unknown"),
        F.count_if(F.col("_owner") != F.col("_first.customer_id")).alias("_foreign"))
    scores = scoring.noisy_or(linked.where("alert_ref is not null"), ["case_key"], "risk_score", "aggregate_risk_score")
    problem = (
        F.when(F.col("alert_count") == 0, "A case must be opened against at least one alert.")
        .when(F.col("_unknown") > 0, "unknown alert reference")
        .when(F.col("_foreign") > 0, F.concat(F.lit("All alerts in a case must belong to customer "), F.col("customer_id"))))
    return (
        summary.join(scores.select("case_key", "aggregate_risk_score"), "case_key", "left")
        .withColumn("aggregate_risk_score", F.coalesce("aggregate_risk_score", F.lit(0)))
        .withColumn("problem", problem).drop("_unknown", "_foreign"))


def open_cases(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """The cases that may be opened, with score, priority and title."""
    title = F.coalesce(text.text_or(F.col("title")), F.concat(F.lit("Investigation — "), F.col("customer_id")))
    return check_requests(requests, alerts).where("problem is null").select(
        text.readable_ref("CASE", F.col("opened_at"), F.col("case_key")).alias("case_ref"), "case_key", "customer_id",
        title.alias("title"), F.lit("NEW").alias("status"), "aggregate_risk_score",
        scoring.score_band(F.col("aggregate_risk_score")).alias("priority"),
        "opened_by", F.col("opened_by").alias("assigned_to"), "opened_at", "alert_count")


def members(requests: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_ref, alert_ref) of opened cases."""
    return requests.where("alert_ref is not null").join(cases.select("case_key", "case_ref"), "case_key").select(
        "case_ref", "alert_ref").distinct()


def link_events(member_rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Linking moves an OPEN alert to IN_REVIEW and leaves any other state alone."""
    return member_rows.join(cases.select("case_ref", "opened_at", "opened_by"), "case_ref").select(
        F.col("alert_ref").alias("entity_id"), F.col("opened_at").alias("occurred_at"), F.lit(-1).cast("long").alias("event_seq"),
        F.lit("IN_REVIEW").alias("target"), F.lit(None).cast("string").alias("disposition"),
        F.lit(None).cast("string").alias("reason"), F.col("opened_by").alias("actor"), F.lit(False).alias("is_senior"),
        F.lit("OPEN").alias("only_from"))


def cascade_events(replayed_cases: DataFrame, member_rows: DataFrame) -> DataFrame:
    """Closing a case closes its member alerts with the same decision."""
    closed = replayed_cases.where("outcome = 'APPLIED' and target = 'CLOSED'")
    return closed.join(member_rows, F.col("entity_id") == F.col("case_ref")).select(
        F.col("alert_ref").alias("entity_id"), "occurred_at", F.col("event_seq"), F.lit("CLOSED").alias("target"), "disposition",
        F.concat(F.lit("Closed via case "), F.col("case_ref"), F.lit(": "), F.col("reason")).alias("reason"),
        "actor", "is_senior", F.lit(None).cast("string").alias("only_from"))


def with_state(cases: DataFrame, states: DataFrame) -> DataFrame:
    """Cases with their replayed state and closing decision."""
    s = states.select(F.col("entity_id").alias("case_ref"), "state", "disposition", "disposition_reason",
                      F.col("disposed_at").alias("closed_at"))
    return cases.join(s, "case_ref", "left").withColumn("status", F.coalesce("state", "status")).drop("state")


def with_assignee(cases: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cases with the analyst of their last assignment; unassigned ones stay with their opener."""
    last = assignments.groupBy("case_ref").agg(F.max_by("assignee", "seq").alias("_last"))
    return cases.join(last, "case_ref", "left").withColumn("assigned_to", F.coalesce("_last", "assigned_to")).drop("_last")


def search(cases: DataFrame, status: str | None = None, assigned_to: str | None = None,
           customer_id: str | None = None) -> DataFrame:
    for column, value in {"status": status, "assigned_to": assigned_to, "customer_id": customer_id}.items():
        if value is not None:
            cases = cases.where(F.col(column) == value)
    return cases


def queue_rows(cases: DataFrame, member_rows: DataFrame) -> DataFrame:
    """List view with the number of member alerts."""
    counts = member_rows.groupBy("case_ref").agg(F.count(F.lit(1)).alias("member_count"))
    return cases.join(counts, "case_ref", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))


def detail(cases: DataFrame, customers: DataFrame) -> DataFrame:
    names = customers.select("customer_id", text.mask_name(text.full_name(F.col("first_name"), F.col("last_name"))).alias("_name"))
    return cases.join(names, "customer_id", "left").withColumn("customer_name_masked", F.coalesce("_name", F.lit("Unknown"))).drop("_name")


def member_alerts(member_rows: DataFrame, alert_queue: DataFrame) -> DataFrame:
    """The list view of each case's alerts, one row each (`alert_queue` as from alerts.queue_rows)."""
    return member_rows.select("case_ref", "alert_ref").join(alert_queue, "alert_ref")


TRAIL_ROWS = 100


def trail(case_audit_rows: DataFrame, rows: int = TRAIL_ROWS) -> DataFrame:
    """Each case's newest audit rows, numbered from the newest. Ranks above `rows` are cut
    before the shuffle."""
    newest = Window.partitionBy("entity_id").orderBy(F.desc("occurred_at"), F.desc("event_seq"), "action", "to_state")
    return case_audit_rows.where("entity_type = 'CASE'").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= rows)


# --- audit rows ------------------------------------------------------------

def audit(entity_type: str, action: str, rows: DataFrame, entity: Column, at: Column, details: Column,
          actor: Column | None = None, from_state: Column | None = None, to_state: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    state = lambda c: none if c is None else text.clip(c, 32)
    return rows.select(
        F.lit(entity_type).alias("entity_type"), entity.alias("entity_id"), F.lit(action).alias("action"),
        (actor if actor is not None else F.lit("system")).alias("actor"), none.alias("actor_roles"),
        state(from_state).alias("from_state"), state(to_state).alias("to_state"), details.alias("details"),
        at.alias("occurred_at"), F.lit(0).cast("long").alias("event_seq"))


def alert_audit(alerts: DataFrame) -> DataFrame:
    """Creation of each alert, and one row for its merges if there were any."""
    made = audit("ALERT", "ALERT_CREATED", alerts, F.col("alert_ref"), F.col("first_detected_at"),
                 F.concat(F.lit("Rule "), F.col("rule_code"), F.lit(" fired with score "), F.col("risk_score").cast("string")),
                 to_state=F.lit("OPEN"))
    merged = audit("ALERT", "ALERT_MERGED", alerts.where("trigger_count > 1"), F.col("alert_ref"), F.col("last_detected_at"),
                   F.concat(F.lit("Repeat detection folded in; trigger count now "), F.col("trigger_count").cast("string"),
                            F.lit(", score "), F.col("risk_score").cast("string")))
    return made.unionByName(merged)


def case_audit(cases: DataFrame) -> DataFrame:
    return audit("CASE", "CASE_OPENED", cases, F.col("case_ref"), F.col("opened_at"),
                 F.concat(F.lit("Opened over "), F.col("alert_count").cast("string"), F.lit(" alert(s), aggregate score "),
                          F.col("aggregate_risk_score").cast("string")),
                 actor=F.col("opened_by"), to_state=F.lit("NEW"))


def link_audit(member_rows: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per alert that a case took in."""
    linked = member_rows.select("case_ref", "alert_ref").distinct().join(cases.select("case_ref", "opened_at", "opened_by"), "case_ref")
    return audit("ALERT", "ALERT_LINKED_TO_CASE", linked, F.col("alert_ref"), F.col("opened_at"),
                 F.concat(F.lit("Linked to case "), F.col("case_ref")), actor=F.col("opened_by"))
