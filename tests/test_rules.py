import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhound import refs
from tallyhound.operators import clusters, flows, rules, skew
from tests.helpers import BASE, find, hits, ledger, settings, txn


# --- threshold -------------------------------------------------------------

@pytest.mark.parametrize("amount,fires", [("9999.99", False), ("10000.00", True), ("10000.01", True)])
@pytest.mark.parametrize("direction", ["CREDIT", "DEBIT"])
def test_threshold_boundary(spark, amount, fires, direction):
    found = hits(spark, "CTR_THRESHOLD", [txn("T1", amount, direction=direction)])
    assert len(found) == fires
    if fires:
        assert found[0]["dedup_key"] == "CTR_THRESHOLD|TXN|T1" and "INR 10,000.00" in found[0]["explanation"]


def test_threshold_is_configurable(spark):
    assert len(hits(spark, "CTR_THRESHOLD", [txn("T1", 500)], thresholdBase=500)) == 1
    assert hits(spark, "CTR_THRESHOLD", [txn("T1", 500)], thresholdBase=0)[0]["magnitude_ratio"] == 1


# --- structuring -----------------------------------------------------------

def test_structuring_counts_and_window(spark):
    rows = lambda n, step: [txn(f"T{i}", 9500, i * step) for i in range(n)]
    assert len(hits(spark, "STRUCTURING", rows(2, 1))) == 0
    assert len(hits(spark, "STRUCTURING", rows(3, 1))) == 1
    assert len(hits(spark, "STRUCTURING", rows(3, 12))) == 1
    assert len(hits(spark, "STRUCTURING", rows(3, 13))) == 0
    assert len(hits(spark, "STRUCTURING", rows(2, 1), minCount=2)) == 1


@pytest.mark.parametrize("amount,fires", [("9000.00", 1), ("9999.99", 1), ("8999.99", 0), ("10000.00", 0)])
def test_structuring_band(spark, amount, fires):
    assert len(hits(spark, "STRUCTURING", [txn(f"T{i}", amount, i) for i in range(3)])) == fires


def test_many_make_one_cluster(spark):
    amounts = ["9042.10", "9871.55", "9310.00", "9666.66", "9199.01", "9500.50"]
    rows = [txn(f"S{i}", a, 3.75 * i) for i, a in enumerate(amounts)]
    found = find(spark, "STRUCTURING", rows)
    hit, = found.hits.collect()
    assert (hit["evidence_count"], hit["evidence_amount_base"], hit["magnitude_ratio"]) == (6, sum(map(D, amounts)), D("2.0000"))
    assert hit["dedup_key"] == "STRUCTURING|ACCT|ACC_K7|2025-03-11"
    assert hit["explanation"].startswith("6 transactions totalling INR 56,589.82 were made on account ACC_K7 within 24 hours")
    assert sorted(r["transaction_id"] for r in found.evidence.collect()) == [f"S{i}" for i in range(6)]


# --- rapid movement --------------------------------------------------------

def outflow(total, parts=1, start=1.0):
    each = D(total) / parts
    return [txn("DEP", 100000)] + [txn(f"OUT{i}", each, start + i, "DEBIT") for i in range(parts)]


def test_rapid_ratio(spark):
    assert len(hits(spark, "RAPID_MOVEMENT", outflow(79000))) == 0
    hit, = hits(spark, "RAPID_MOVEMENT", outflow(80000))
    assert (hit["dedup_key"], hit["magnitude_ratio"], hit["evidence_amount_base"]) == ("RAPID_MOVEMENT|ANCH|ACC_K7|DEP", D("1.0000"), D("80000.00"))
    assert hit["explanation"].startswith("80.0% of a INR 100,000.00 deposit (transaction DEP received 11 Mar 2025 07:30) left account")


def test_rapid_window_floor_and_order(spark):
    assert len(hits(spark, "RAPID_MOVEMENT", outflow(90000, start=48))) == 1
    assert len(hits(spark, "RAPID_MOVEMENT", outflow(90000, start=48.01))) == 0
    assert len(hits(spark, "RAPID_MOVEMENT", outflow(90000, start=-1))) == 0
    assert len(hits(spark, "RAPID_MOVEMENT", outflow(90000, start=0))) == 1
    assert len(hits(spark, "RAPID_MOVEMENT", [txn("DEP", 49999.99), txn("OUT", 49000, 1, "DEBIT")])) == 0
    assert len(hits(spark, "RAPID_MOVEMENT", [txn("DEP", 100000)])) == 0
    found = find(spark, "RAPID_MOVEMENT", outflow(90000, parts=3))
    assert found.hits.count() == 1
    full = rules.expand_evidence(found.evidence, found.hits, ledger(spark, outflow(90000, parts=3)), settings(spark))
    assert [r["transaction_id"] for r in full.orderBy("position", "txn_timestamp").collect()] == ["DEP", "OUT0", "OUT1", "OUT2"]
    assert found.evidence.count() == 1 and found.hits.first()["evidence_count"] == 4


# --- listed parties --------------------------------------------------------

def test_listed_party(spark):
    hit, = hits(spark, "HIGH_RISK_JURISDICTION", [txn("T1", 1, country="ir ")])
    assert hit["jurisdiction_uplift"] == 40 and "involves Iran, listed as SANCTIONED (source: FATF Call for Action)." in hit["explanation"]
    assert hits(spark, "HIGH_RISK_JURISDICTION", [txn("T1", 1)]) == []
    hit, = hits(spark, "HIGH_RISK_JURISDICTION", [txn("T1", 1, party="Delta-Bridge exchange")])
    assert hit["jurisdiction_uplift"] == 40 and "Counterparty 'Delta Bridge Exchange' appears on the SANCTIONS watchlist — Designated" in hit["explanation"]
    hit, = hits(spark, "HIGH_RISK_JURISDICTION", [txn("T1", 1, country="AE", party="ZENITH HOLDINGS FZE")])
    assert hit["jurisdiction_uplift"] == 30
    assert hits(spark, "HIGH_RISK_JURISDICTION", [txn("T1", 1, country=None, party=None)]) == []


# --- behaviour -------------------------------------------------------------

def history(daily, last, days=90):
    rows = [txn(f"H{d}_{k}", D(daily) / 2, at=BASE - timedelta(days=d, hours=k)) for d in range(1, days + 1) for k in range(2)]
    return rows + [txn("NOW", last)]


def test_behaviour_multiplier_is_strict(spark):
    assert hits(spark, "BEHAVIORAL_DEVIATION", history(10000, 30000)) == []
    hit, = hits(spark, "BEHAVIORAL_DEVIATION", history(10000, 30001))
    assert hit["dedup_key"] == "BEHAVIORAL_DEVIATION|CUST|CUST_K7|2025-03-11" and hit["account_id"] == "ACC_K7"
    assert "transacted INR 30,001.00 across 1 transaction(s) on 2025-03-11 — 3.0x their 90-day rolling average of INR 10,000.00 per day" in hit["explanation"]


def test_behaviour_guards(spark):
    assert hits(spark, "BEHAVIORAL_DEVIATION", history(10000, 90000, days=2)) == []
    assert hits(spark, "BEHAVIORAL_DEVIATION", history(1000, 24999)) == []


def test_behaviour_only_looks_at_days_of_the_batch(spark):
    rows = history(10000, 90000)
    assert len(hits(spark, "BEHAVIORAL_DEVIATION", rows, fresh=rows[-1:])) == 1
    assert hits(spark, "BEHAVIORAL_DEVIATION", rows, fresh=rows[:1]) == []


# --- round amounts ---------------------------------------------------------

def test_round_amounts(spark):
    rows = [txn(f"T{i}", a, 2 * i) for i, a in enumerate([50000, 100000, 150000])]
    hit, = hits(spark, "ROUND_AMOUNT_PATTERN", rows)
    assert hit["evidence_amount_base"] == D("300000.00") and "exact multiples of INR 10,000.00, totalling INR 300,000.00" in hit["explanation"]
    assert hits(spark, "ROUND_AMOUNT_PATTERN", [txn(f"T{i}", 50001, i) for i in range(3)]) == []
    assert hits(spark, "ROUND_AMOUNT_PATTERN", [txn(f"T{i}", 40000, i) for i in range(3)]) == []


# --- brute force -----------------------------------------------------------

def greedy(rows, hours, least):
    out = []
    by_account = {}
    for r in rows:
        by_account.setdefault(r["account_id"], []).append(r)
    for account, items in by_account.items():
        items.sort(key=lambda r: (r["txn_timestamp"], r["transaction_id"]))
        i = 0
        while i < len(items):
            j = i
            while j + 1 < len(items) and items[j + 1]["txn_timestamp"] - items[i]["txn_timestamp"] <= timedelta(hours=hours):
                j += 1
            if j - i + 1 >= least:
                out.append((account, items[i]["transaction_id"], tuple(r["transaction_id"] for r in items[i:j + 1])))
                i = j + 1
            else:
                i += 1
    return sorted(out)


def random_rows(seed, n, accounts=4, span=200, grain=1):
    rng = random.Random(seed)
    # The first account holds half of all rows; coarse hours make many ties.
    return [txn(f"T{i:05d}", rng.randint(1, 999), at=datetime(2026, 1, 1) + timedelta(hours=rng.randrange(0, span) // grain * grain),
                direction=rng.choice(["CREDIT", "DEBIT"]), account=f"A{0 if rng.random() < .5 else rng.randrange(accounts)}") for i in range(n)]


def grouped(members):
    seen = {}
    for r in members.collect():
        seen.setdefault((r["account_id"], r["cluster_txn_id"]), []).append((r["txn_timestamp"], r["transaction_id"]))
    return sorted((a, t, tuple(x for _, x in sorted(v))) for (a, t), v in seen.items())


@pytest.mark.parametrize("seed,hours,least,grain", [(1, 24, 3, 1), (2, 5, 2, 1), (3, 24, 4, 12), (4, 1, 1, 1), (5, 48, 9, 24)])
def test_clusters_match_brute_force(spark, seed, hours, least, grain):
    rows = random_rows(seed, 250, grain=grain, span=600)
    want = greedy(rows, hours, least)
    df = ledger(spark, rows)
    assert grouped(clusters.find_clusters(df, hours, least)) == want
    assert grouped(clusters.find_clusters(df, hours, least, hot_limit=20)) == want


def test_no_cluster_asked_for(spark):
    assert clusters.find_clusters(ledger(spark, random_rows(1, 10)), 24, 0).count() == 0


@pytest.mark.parametrize("seed,hours", [(1, 24), (2, 3)])
def test_outflows_match_brute_force(spark, seed, hours):
    rows = random_rows(seed, 250, grain=2)
    want = []
    for d in rows:
        if d["direction"] == "CREDIT" and d["amount_base"] >= 500:
            outs = [o["amount_base"] for o in rows if o["account_id"] == d["account_id"] and o["direction"] == "DEBIT"
                    and timedelta(0) <= o["txn_timestamp"] - d["txn_timestamp"] <= timedelta(hours=hours)]
            if outs:
                want.append((d["transaction_id"], len(outs), sum(outs)))
    df = ledger(spark, rows)
    for limit in (None, 15):
        found = flows.outflow_after_deposits(df, (F.col("direction") == "CREDIT") & (F.col("amount_base") >= 500),
                                             F.col("direction") == "DEBIT", hours, limit)
        assert sorted((r["transaction_id"], r["outflow_count"], r["outflow_total"]) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("limit", [None, 10])
def test_windows_covering_matches_brute_force(spark, limit):
    rows = random_rows(9, 120, grain=3)
    spans = [(r["account_id"], r["txn_timestamp"], r["txn_timestamp"] + timedelta(hours=9), i % 2 == 0) for i, r in enumerate(random_rows(8, 40, grain=3))]
    want = sorted((r["transaction_id"], sum(a == r["account_id"] and lo <= r["txn_timestamp"] <= hi for a, lo, hi, _ in spans),
                   sum(a == r["account_id"] and lo <= r["txn_timestamp"] <= hi and new for a, lo, hi, new in spans)) for r in rows)
    windows = spark.createDataFrame(spans, "account_id string, first_ts timestamp_ntz, last_ts timestamp_ntz, is_new boolean")
    got = flows.windows_covering(ledger(spark, rows).select("account_id", "transaction_id", "txn_timestamp"), windows, limit)
    assert sorted(map(tuple, got.collect())) == want


# --- engine ----------------------------------------------------------------

def test_active_rules_and_lookback(spark):
    s = settings(spark)
    assert len(rules.active_rules(s)) == 6 and rules.max_lookback_hours(s) == 48
    del s["CTR_THRESHOLD"]
    assert "CTR_THRESHOLD" not in [r.code for r in rules.active_rules(s)]
    assert rules.detect(rules.RuleContext(ledger(spark, [txn("T", 20000)])), {}).hits.count() == 0


def test_a_new_rule_needs_only_registration(spark):
    @rules.rule("ANY_DEBIT", "TEST", rules.TRANSACTION)
    def any_debit(ctx, s):
        t = F.col("txn_timestamp")
        rows = rules.hit_rows(ctx.current.where("direction = 'DEBIT'"), s.code, "TEST", dedup_key=F.col("transaction_id"), explanation=F.lit("x"),
                              evidence_amount_base=F.col("amount_base"), evidence_count=F.lit(1), first_ts=t, last_ts=t, anchor_txn_id=F.col("transaction_id"))
        return rules.Findings(rows, rules.evidence_rows(rows, s.code, txn_timestamp=F.col("first_ts"), transaction_id=F.col("anchor_txn_id")))
    try:
        from tallyhound import refs
        from tallyhound.functions.params import load_settings
        cfg = refs.rule_config(spark, [*refs.RULE_CONFIG, ("ANY_DEBIT", "TEST", True, 5, "LOW", "{}")])
        found = rules.detect(rules.RuleContext(ledger(spark, [txn("T1", 5, direction="DEBIT")])), load_settings(cfg))
        assert [r["rule_code"] for r in found.hits.collect()] == ["ANY_DEBIT"]
    finally:
        rules.unregister("ANY_DEBIT")


def test_small_file_with_one_busy_account_is_split(spark, tmp_path):
    """120,000 qualifying rows of one account compress to a few hundred kilobytes."""
    rows = spark.range(120_000).select(
        F.lit("ACC").alias("account_id"), F.lit("CUST").alias("customer_id"), F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("transaction_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("txn_timestamp"), F.lit(1).cast("decimal(18,2)").alias("amount_base"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 2_000_000
    stored = spark.read.parquet(str(tmp_path / "rows"))
    hot = skew.hot_keys(stored, ["account_id"])
    assert [r["account_id"] for r in hot.collect()] == ["ACC"]
    members = clusters.find_clusters(stored, 1, 3)
    got = clusters.summarise(members).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows"), F.max("size").alias("most")).first()
    # 61 rows lie within an hour, both ends included.
    assert (got["n"], got["rows"], got["most"]) == (-(-120_000 // 61), 120_000, 61)


def test_lists_keep_codes_of_any_form(spark):
    rates = spark.createDataFrame([("A1B", "2.5"), (" usd ", "80")], "currency string, rate_to_base string")
    assert {r["fx_currency"]: float(r["fx_rate"]) for r in refs.active_fx(rates).collect()} == {"A1B": 2.5, "USD": 80.0}
    listed = refs.inline(spark, [("x1", "Somewhere", "FATF", 30, "list", True)], ["country_code", "country_name", "category", "risk_weight", "source", "active"])
    rows = spark.createDataFrame([("X1",), ("IN",), (None,)], "country string")
    assert {r["country"]: r["country_risk_weight"] for r in refs.country_weight(rows, "country", listed).collect()} == {"X1": 30, "IN": 0, None: 0}
