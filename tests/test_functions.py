import hashlib
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhound import refs
from tallyhound.functions import money, params, scoring, text


def values(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_masking(spark):
    assert values(spark, text.mask_name, ["Krishna Sharma", "Anika Rose Fernandes", None, "", "A bc"]) == [
        "K****** S*****", "A**** R*** F********", None, "", "A b*"]
    assert values(spark, text.mask_identifier, ["IDN12344821", "ACC_000123", "AB", None, "abcd"]) == [
        "*******4821", "******0123", "**", None, "****"]
    assert values(spark, text.mask_email, ["krishna.sharma@gmail.com", "not-an-email", "a@b", None, "x@y@z.co"]) == [
        "k*************@g****.com", "********mail", "a@b", None, "x@y**.co"]
    assert values(spark, text.mask_phone, ["+91-6939042955", "12", "12345678", "+1-99", None]) == [
        "+91-******2955", "**", "****5678", "+1-**", None]


def test_timestamps(spark):
    at = datetime(2026, 3, 4, 5, 6, 7)
    shown = ["2026-03-04T05:06:07", "2026-03-04 05:06:07", "04/03/2026 05:06:07", "04-03-2026 05:06:07", "2026-03-04T05:06:07Z", " 2026-03-04T05:06:07 "]
    assert values(spark, text.parse_timestamp, shown) == [at] * len(shown)
    assert values(spark, text.parse_timestamp, [
        "2026-03-04T05:06:07.250000", "2026-03-04 05:06", "03/25/2026 05:06:07", "2026-03-04", "04/03/2026", "31/02/2026", "2026-02-31",
        "2026-02-31T01:00:00", "25:00", None, "", "2026-03-04 05:06:07.5", "2026-03-04 24:01:00"]) == [
        datetime(2026, 3, 4, 5, 6, 7, 250000), datetime(2026, 3, 4, 5, 6), datetime(2026, 3, 25, 5, 6, 7), datetime(2026, 3, 4), datetime(2026, 3, 4),
        datetime(2026, 2, 28), None, datetime(2026, 2, 28, 1), None, None, None, None, None]


def test_lenient_values(spark):
    assert values(spark, text.parse_flag, ["Y", " yes", "TRUE", "1", "no", "", None]) == [True] * 4 + [False] * 3
    assert values(spark, text.parse_int, ["2.9", "-2.9", "x", None, " 7 ", "1e10"]) == [2, -2, None, None, 7, 2147483647]
    assert values(spark, text.parse_decimal, ["2.345", "x", None]) == [D("2.35"), None, None]
    assert values(spark, text.parse_direction, ["cr", "Deposit", "IN", "dr", "OUT", "x", None]) == ["CREDIT"] * 3 + ["DEBIT"] * 2 + [None] * 2
    assert values(spark, text.parse_rating, ["high", " Medium ", "odd", None]) == ["HIGH", "MEDIUM", "LOW", "LOW"]
    assert values(spark, text.normalise_party, ["Zenith Holdings F.Z.E.", None]) == ["ZENITHHOLDINGSFZE", ""]
    assert values(spark, lambda c: text.clip(c, 8), ["12345678", "123456789"]) == ["12345678", "12345..."]
    assert values(spark, lambda c: text.join_ids(text.split_ids(c)), ["a, b,,c ", None]) == ["a,b,c", ""]


def test_stand_in_national_id(spark):
    ids = ["CUST_1", "CUST_2", "", "ü"]
    want = ["IDN%08d" % (int(hashlib.sha256(i.encode()).hexdigest()[:12], 16) % 10**8) for i in ids]
    assert values(spark, text.stand_in_national_id, [*ids, None]) == [*want, None]


def test_display(spark):
    assert values(spark, text.money_text, [D("1234567.50"), None], "decimal(18,2)") == ["INR 1,234,567.50", "INR 0.00"]
    assert values(spark, text.percent_text, [D("0.80000"), D("2.45099"), None], "decimal(18,6)") == ["80.0%", "245.1%", "0%"]
    assert values(spark, text.multiplier_text, [D("3.25"), None], "decimal(18,4)") == ["3.3x", "0x"]
    assert values(spark, text.timestamp_text, [datetime(2026, 9, 18, 9, 5), None], "timestamp_ntz") == ["18 Sep 2026 09:05", "unknown"]


def test_money(spark):
    a, b = F.lit(D("10.00")), F.lit(D("3.00"))
    inr, usd = F.lit("INR"), F.lit("USD")
    row = spark.range(1).select(
        money.plus(a, inr, b, inr), money.minus(a, inr, b, inr), money.times(a, F.lit(D("0.335"))), money.ratio(a, b), money.ratio(a, F.lit(D("0.00"))),
        money.is_multiple_of(a, F.lit(D("5.00"))), money.is_multiple_of(a, F.lit(D("0.00"))), money.to_base(F.lit(D("1.005")), F.lit(D("83.2")))).first()
    assert list(row) == [D("13.00"), D("7.00"), D("3.35"), D("3.333333"), D("0"), True, False, D("84.03")]
    with pytest.raises(Exception, match="currency mismatch"):
        spark.range(1).select(money.plus(a, inr, b, usd)).collect()


def test_ratio_is_rounded_once(spark):
    # 0.12344999999999 would round up in two steps.
    row = spark.range(1).select(money.divide_half_up(F.lit(D("12344999.99")), F.lit(D("100000000.00")), 4),
                                money.divide_half_up(F.lit(D("12345000.00")), F.lit(D("100000000.00")), 4)).first()
    assert list(row) == [D("0.1234"), D("0.1235")]


def score(spark, weight=30, jurisdiction=0, rating="LOW", pep=False, ratio="1.0", prior=0):
    b = scoring.breakdown(F.lit(weight), F.lit(jurisdiction), F.lit(rating), F.lit(pep), F.lit(D(ratio)), F.lit(prior).cast("long"))
    return spark.range(1).select(b.alias("b")).first()["b"]


def test_scoring(spark):
    assert score(spark)["total"] == 30
    assert score(spark, rating="HIGH", pep=True)["total"] == 55
    assert score(spark, 100, 40, "HIGH", True, "1000", 10)["total"] == 100
    assert score(spark, ratio="2")["magnitudeUplift"] == 5
    assert score(spark, ratio="1000")["magnitudeUplift"] == 15
    assert score(spark, prior=2)["recurrenceUplift"] == 6
    assert score(spark, prior=50)["recurrenceUplift"] == 12


def noisy(spark, scores):
    df = spark.createDataFrame([("k", s) for s in scores], "k string, s int")
    rows = scoring.noisy_or(df, ["k"], "s", "agg").collect()
    return rows[0]["agg"] if rows else 0


def test_noisy_or(spark):
    assert noisy(spark, [50, 50, 50]) == 88
    assert noisy(spark, [60, 40, 30]) >= noisy(spark, [60, 40])
    assert noisy(spark, [85, 80, 75]) > noisy(spark, [45, 45, 45])
    assert noisy(spark, []) == 0
    assert noisy(spark, [None, 50]) == 50


def test_params(spark):
    cfg = refs.inline(spark, [("CTR_THRESHOLD", "T", True, 25, "LOW", "{broken"), ("STRUCTURING", "S", False, 35, "LOW", '{"minCount":"4","lowerBound":"x","upperBound":9500}')],
                      ["rule_code", "typology", "enabled", "weight", "severity", "params"])
    s = params.load_settings(cfg)
    assert s["CTR_THRESHOLD"].params["thresholdBase"] == D("10000.00")
    assert (s["STRUCTURING"].params["minCount"], s["STRUCTURING"].params["lowerBound"], s["STRUCTURING"].enabled) == (4, D("9000.00"), False)


@pytest.mark.parametrize("code,text_,part", [
    ("STRUCTURING", '{"windowHours":0}', "windowHours"), ("STRUCTURING", '{"minCount":0}', "minCount"), ("STRUCTURING", '{"lowerBound":5,"upperBound":5}', "lowerBound"),
    ("RAPID_MOVEMENT", '{"outflowRatio":1.5}', "outflowRatio"), ("BEHAVIORAL_DEVIATION", '{"multiplier":0}', "multiplier"), ("BEHAVIORAL_DEVIATION", '{"baselineDays":0}', "baselineDays")])
def test_bad_settings_stop_the_run(spark, code, text_, part):
    cfg = refs.inline(spark, [(code, "T", True, 25, "LOW", text_)], ["rule_code", "typology", "enabled", "weight", "severity", "params"])
    with pytest.raises(ValueError, match=part):
        params.load_settings(cfg)


def test_fx_check(spark):
    rows = params.check_fx(refs.fx_rates(spark, [("INR", "1"), ("BAD", "0")])).collect()
    assert {r["currency"]: r["problem"] for r in rows} == {"INR": None, "BAD": "rate must be greater than zero"}


def test_reference_lists(spark):
    log = spark.createDataFrame([("IR", 1, 40, True), ("IR", 2, 40, False), ("RU", 1, 30, True)], "country_code string, seq int, risk_weight int, active boolean")
    rows = {r["country_code"]: r["active"] for r in refs.latest_by_key(log, "country_code", "seq").collect()}
    assert rows == {"IR": False, "RU": True}
    off = refs.jurisdictions(spark).withColumn("active", F.col("country_code") != "IR")
    assert refs.active_jurisdictions(off).count() == 15
    assert refs.active_fx(refs.fx_rates(spark)).count() == 10


def test_breakdown_json(spark):
    df = spark.createDataFrame([('{"total":5}',), ("nonsense",), ("",), (None,)], "t string")
    assert [dict(r[0]) for r in df.select(scoring.breakdown_from_json(F.col("t"))).collect()] == [{"total": 5}, {}, {}, {}]
