from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhound.operators import alerts as al
from tallyhound.operators import cases as cs
from tallyhound.operators import reports, rules, sar
from tallyhound.schemas import HIT_DDL
from tests.helpers import BASE, settings

LOG = HIT_DDL + ", batch_id long, detected_at timestamp_ntz"
CUSTOMERS = "customer_id string, first_name string, last_name string, risk_rating string, is_politically_exposed boolean"


def hit(batch, amount, ratio="1", key="K1", anchor="T1"):
    return ("CTR_THRESHOLD", "THRESHOLD_BREACH", "C1", "ACC_12345", key, f"text {batch}", D(amount), 1, 0, D(ratio), BASE, BASE, anchor, batch,
            BASE + timedelta(days=batch))


def test_repeats_fold_into_one_alert(spark):
    log = spark.createDataFrame([hit(0, 10), hit(1, 30, "4"), hit(2, 20, "2")], LOG)
    people = spark.createDataFrame([("C1", "Ann", "Lee", "HIGH", True)], CUSTOMERS)
    ev = spark.createDataFrame([("CTR_THRESHOLD", "K1", 0, BASE, t) for t in ("T1", "T1", "T2")],
                               "rule_code string, dedup_key string, position int, txn_timestamp timestamp_ntz, transaction_id string")
    a, = al.derive_alerts(log, people, settings(spark), ev).collect()
    # Last hit: 25 + HIGH 15 + PEP 10 + ratio 2 -> 5, two hits before it -> 6.
    assert (a["trigger_count"], a["evidence_amount_base"], a["risk_score"], a["severity"], a["evidence_count"]) == (3, D("30.00"), 61, "HIGH", 2)
    assert (a["explanation"], a["first_detected_at"], a["last_detected_at"]) == ("text 0", BASE, BASE + timedelta(days=2))
    stopped = spark.createDataFrame([("K1", BASE + timedelta(hours=1))], "dedup_key string, disposed_at timestamp_ntz")
    a, = al.derive_alerts(al.undisposed(log, stopped), people, settings(spark)).collect()
    assert (a["trigger_count"], a["risk_score"]) == (1, 50)


def test_unknown_customer_and_rule(spark):
    log = spark.createDataFrame([hit(0, 10)], LOG)
    nobody = spark.createDataFrame([], CUSTOMERS)
    assert al.derive_alerts(log, nobody, settings(spark)).first()["risk_score"] == 25
    assert al.derive_alerts(log, nobody, {}).first()["risk_score"] == 0
    row = al.queue_rows(al.derive_alerts(log, nobody, {}), nobody).first()
    assert (row["customer_name_masked"], row["account_masked"]) == ("U******", "*****2345")


def test_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(f"R{i:03d}", i % 3) for i in range(50)], "ref string, score int")
    seen = [r["ref"] for n in range(5) for r in al.page(df, n, 12, "score", "ref").collect()]
    assert len(seen) == len(set(seen)) == 50 and al.page(df, 0, 1000, "score", "ref", limit=20).count() == 20
    e = al.page_envelope(df, 4, 12).first()
    assert (e["total_pages"], e["first"], e["last"]) == (5, False, True)


T0 = datetime(2026, 9, 1, 9)


def records(spark, rows):
    """(rule, disposition, hours) triples."""
    return spark.createDataFrame(
        [(r, d, T0, None if h is None else T0 + timedelta(hours=h), "CLOSED" if d else "OPEN") for r, d, h in rows],
        "rule_code string, disposition string, first_detected_at timestamp_ntz, disposed_at timestamp_ntz, status string")


def test_productivity(spark):
    none = reports.productivity(records(spark, [("R", None, None)])).first()
    assert (none["total_alerts"], none["open_alerts"], none["false_positive_rate_pct"], none["median_hours"]) == (1, 1, None, None)
    rows = [("R", "FALSE_POSITIVE", 1), ("R", "FALSE_POSITIVE", 2), ("R", "FALSE_POSITIVE", 300), ("R", "ESCALATED_TO_SAR", None)]
    p = reports.productivity(records(spark, rows)).first()
    assert (p["false_positive_rate_pct"], p["mean_hours"], p["median_hours"], p["sar_count"]) == (75.0, 101.0, 2.0, 1)
    even = reports.productivity(records(spark, [("R", "TRUE_POSITIVE", 4), ("R", "TRUE_POSITIVE", 6), ("R", "TRUE_POSITIVE", -5)])).first()
    assert (even["mean_hours"], even["median_hours"]) == (5.0, 5.0)


def test_rule_quality_order(spark):
    rows = ([("FEW", "FALSE_POSITIVE", 1)] * 3 + [("NOISY", "FALSE_POSITIVE", 1)] * 18 + [("NOISY", "TRUE_POSITIVE", 1)] * 2
            + [("CLEAN", "TRUE_POSITIVE", 1)] * 20)
    got = [(r["rule_code"], r["false_positive_rate_pct"]) for r in reports.quality_by_rule(records(spark, rows)).collect()]
    assert got == [("NOISY", 90.0), ("CLEAN", 0.0), ("FEW", None)]
    counts = {r["disposition"]: r["n"] for r in reports.disposition_breakdown(records(spark, rows)).collect()}
    assert counts == {"TRUE_POSITIVE": 22, "FALSE_POSITIVE": 21, "ESCALATED_TO_SAR": 0, "CLEARED_NO_ACTION": 0}


def test_trend(spark):
    df = records(spark, [("R", None, None)] * 3)
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    assert [(str(r["day"]), r["alerts"]) for r in reports.daily_alerts(df, at("2026-09-05 00:00:00")).collect()] == [("2026-09-01", 3)]
    assert reports.daily_alerts(df, at("2026-09-05 00:00:00"), 2).count() == 0
    assert [reports.trend_days(d) for d in (None, 0, 999, 7)] == [90, 1, 365, 7]


def test_case_requests(spark):
    alerts = spark.createDataFrame([("A1", "C1", 50), ("A2", "C1", 50), ("A3", "C2", 10)], "alert_ref string, customer_id string, risk_score int")
    ask = spark.createDataFrame(
        [("ok", "C1", None, "A1"), ("ok", "C1", None, "A2"), ("mixed", "C1", "t", "A1"), ("mixed", "C1", "t", "A3"), ("none", "C1", "t", None), ("lost", "C1", "t", "A9")],
        "case_key string, customer_id string, title string, alert_ref string").withColumns(
        {"opened_by": F.lit("ann"), "opened_at": F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")})
    case, = cs.open_cases(ask, alerts).collect()
    assert (case["case_key"], case["aggregate_risk_score"], case["priority"], case["title"], case["alert_count"]) == ("ok", 75, "HIGH", "Investigation — C1", 2)
    problems = {r["case_key"]: r["problem"] for r in cs.check_requests(ask, alerts).collect()}
    assert problems["none"].startswith("A case must be opened") and problems["lost"] == "unknown alert reference"
    assert problems["mixed"] == "All alerts in a case must belong to customer C1"


def test_every_customer_number_may_ask_for_a_foreign_alert(spark, monkeypatch):
    """Numbers above 99,999 are not folded onto lower ones: each fifth case asks for its neighbour's alert and is refused."""
    from checks import scenario as sc
    numbers = [4, 5, 99_999, 100_000, 100_004, 100_005, 200_004, 200_005, 200_014]
    alerts = spark.createDataFrame([(f"A{n}{x}", f"CUST_{n}", 50) for n in numbers for x in "ab"] + [("A-", None, 50)],
                                   "alert_ref string, customer_id string, risk_score int")
    monkeypatch.setattr(sc, "alerts", lambda spark, sf: alerts)
    asked = sc.case_requests(spark, "")
    foreign = {(r["case_key"], r["alert_ref"]) for r in asked.collect()} - {(f"CASE|CUST_{n}", f"A{n}{x}") for n in numbers for x in "ab"}
    assert foreign == {(None, "A-")} | {(f"CASE|CUST_{n + 1}", f"A{n}a") for n in (4, 100_004, 200_004, 200_014)}
    opened = {r["case_key"] for r in cs.open_cases(asked, alerts).collect()}
    assert opened == {f"CASE|CUST_{n}" for n in (4, 99_999, 100_000, 100_004, 200_004, 200_014)}


# --- report drafts ---------------------------------------------------------

def reports_for(spark, disposition=None, pep=False, findings=1, days=0, with_accounts=True, evidence=True):
    none = F.lit(None).cast("string")
    case = spark.createDataFrame([("CASE-1", "C1", disposition)], "case_ref string, customer_id string, disposition string")
    refs = [f"ALT-{i}" for i in range(findings)]
    member = spark.createDataFrame([("CASE-1", r) for r in refs], "case_ref string, alert_ref string")
    alert = spark.createDataFrame(
        [(r, f"K{i}", "STRUCTURING" if i % 2 == 0 else "CTR_THRESHOLD", "STRUCTURING" if i % 2 == 0 else "THRESHOLD_BREACH", 70 - i, "HIGH", f"Reason {i}.", 2)
         for i, r in enumerate(refs)],
        "alert_ref string, dedup_key string, rule_code string, typology string, risk_score int, severity string, explanation string, evidence_count long")
    ev = spark.createDataFrame([(f"K{i}", t) for i in range(findings) for t in ("T1", "T2")] if evidence else [], "dedup_key string, transaction_id string")
    money = "amount_base decimal(18,2), amount decimal(18,2), currency string, channel string, counterparty_name string, counterparty_country string"
    led = spark.createDataFrame(
        [("T1", BASE, "ACC_1", "CREDIT", D("100.00"), D("100.00"), "INR", "X", "Bob", "IR"),
         ("T2", BASE + timedelta(days=days, hours=1), "ACC_1", "DEBIT", D("1234.50"), D("50.00"), "USD", "X", None, None)],
        f"transaction_id string, txn_timestamp timestamp_ntz, account_id string, direction string, {money}")
    who = spark.createDataFrame(
        [("C1", "Ann", "Lee", "IDN1", datetime(1980, 1, 2).date(), "Pune", " ", "IN", "411", None, "RETAIL", "VERIFIED", "HIGH", pep, None)],
        "customer_id string, first_name string, last_name string, national_id string, date_of_birth date, city string, state string, country string, postal_code string, "
        "occupation string, customer_segment string, kyc_status string, risk_rating string, is_politically_exposed boolean, customer_since date")
    acc = spark.createDataFrame([(a, "C1", "SAVINGS", "INR", None, "B1", None) for a in (["ACC_1", "ACC_2"] if with_accounts else [])],
                                "account_id string, customer_id string, account_type string, currency string, open_date date, branch_code string, branch_city string")
    return sar.draft(case, member, alert, ev, led, who, acc, "Test Bank", "ann", F.lit("2026-09-20 00:00:00").cast("timestamp_ntz"))


def prose(r):
    rows = r.narrative.orderBy("case_ref", "paragraph", "place", "part").collect()
    return "".join(x["fragment"] for x in rows)


def test_narrative_essentials(spark):
    text = prose(reports_for(spark))
    assert text.startswith("Test Bank is reporting suspicious activity identified on ACC_1 held by Ann Lee (customer reference C1).")
    assert "system on 11 Mar 2025 and comprises 2 transaction(s) with an aggregate value of INR 1,334.50." in text
    assert "SUBJECT: Ann Lee, national identifier IDN1, date of birth 1980-01-02, resident at Pune, IN, 411. The customer has been" in text
    assert "since an unrecorded date and is classified high risk with KYC status VERIFIED." in text
    assert "typology: structuring." in text and "the finding set out above" in text and "POLITICALLY" not in text
    assert "FINDING ALT-0 (STRUCTURING, risk score 70, severity HIGH): Reason 0." in text and "%" not in text


def test_narrative_variants(spark):
    text = prose(reports_for(spark, pep=True, findings=3, days=2))
    assert "between 11 Mar 2025 and 13 Mar 2025" in text and "POLITICALLY EXPOSED PERSON" in text
    assert "typologies: structuring, threshold breach." in text and "the 3 findings set out above, taken together" in text
    assert text.index("ALT-0") < text.index("ALT-1") < text.index("ALT-2")
    assert "identified on accounts held at this institution held by" in prose(reports_for(spark, with_accounts=False))
    assert "identified on ACC_1, ACC_2 held by" in prose(reports_for(spark, evidence=False))


@pytest.mark.parametrize("disposition,part", [
    (None, "provisional"), ("ESCALATED_TO_SAR", "File this report"), ("TRUE_POSITIVE", "Refer to a senior analyst"), ("FALSE_POSITIVE", "should NOT be filed"),
    ("CLEARED_NO_ACTION", "should NOT be filed"), ("OTHER", "Review the case disposition")])
def test_recommendation(spark, disposition, part):
    df = spark.createDataFrame([(disposition,)], "d string")
    assert part in df.select(sar.recommendation(F.col("d"))).first()[0]


def test_text_whole_in_any_number_of_volumes(spark):
    r = reports_for(spark, findings=2)
    one, = sar.volumes(sar.rendered(r)).collect()
    parts = sar.volumes(sar.rendered(r), limit=3).orderBy("volume").collect()
    assert len(parts) > 2 and "".join(p["text"] for p in parts) == one["text"]
    assert "T1                     11 Mar 2025 07:30 CREDIT            100.00  Bob (IR)\n" in one["text"]
    assert "DEBIT            1234.50  —\n" in one["text"]
    assert "TRANSACTION SCHEDULE (2 line(s))\n" in one["text"] and one["text"].endswith("Source alerts: ALT-0, ALT-1\n")


def test_patterns_are_searched_once_for_hits_and_evidence(spark, sf, monkeypatch):
    from checks import scenario as sc
    calls, real = [], rules.detect
    monkeypatch.setattr(rules, "detect", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(sc, "_tables", {})
    monkeypatch.setattr(sc, "_found", {})
    hits, logged, full = sc.hits(spark, sf), sc.logged_evidence(spark, sf), sc.evidence(spark, sf)
    assert calls == [1]
    assert hits.count() > 0 and full.count() > logged.count() > 0
    assert logged.join(hits, "dedup_key", "left_anti").count() == 0
