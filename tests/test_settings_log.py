"""Change logs of rules, lists and rates, against plain Python."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhound.plans import settings_log, store
from tallyhound.plans.settings_log import SettingsLog

AT = datetime(2024, 3, 1)


def rules(spark, rows):
    ddl = "rule_code string, enabled boolean, weight int, params string, seq long"
    return spark.createDataFrame(rows, ddl).withColumns({
        "typology": F.lit("T"), "severity": F.lit("LOW"), "changed_at": F.lit(AT).cast("timestamp_ntz"), "actor": F.lit("ann")})


@pytest.fixture
def log(spark, tmp_path):
    made = SettingsLog(str(tmp_path / "log"))
    made.install(rules(spark, [("A", True, 10, "{}", 0), ("B", True, 20, "{}", 0)]), AT)
    return made


def details(log, spark):
    return sorted(r["details"] for r in log.audit_rows(spark).collect())


def test_changes_cite_what_they_met(spark, log):
    assert details(log, spark) == [] and log.last_committed(spark) == 0
    log.apply(1, rules=rules(spark, [("A", False, 11, "{}", 1), ("A", True, 200, "{}", 2), ("A", True, 12, "{}", 3), ("C", True, 1, "{}", 4), (None, True, 1, "{}", 5)]))
    shown = lambda e, w: f"enabled={e},weight={w},severity=LOW,params={{}}"
    first = [f"Changed by ann | before: {shown('true', 10)} | after: {shown('false', 11)}", f"Changed by ann | before: {shown('false', 11)} | after: {shown('true', 12)}"]
    assert details(log, spark) == sorted(first)
    refused = {r["seq"]: (r["key"], r["problem"]) for r in log.refused(spark, "rules").collect()}
    assert refused == {2: ("A", "weight must be between 0 and 100"), 4: ("C", "Rule not found: C"), 5: (None, "key is required")}
    log.apply(2, rules=rules(spark, [("A", False, 1, "{}", 6)]), fx=spark.createDataFrame([], "currency string, rate_to_base int, seq long, changed_at timestamp_ntz, actor string"))
    assert details(log, spark) == sorted([*first, f"Changed by ann | before: {shown('true', 12)} | after: {shown('false', 1)}"])
    assert {r["rule_code"]: r["weight"] for r in log.current(spark, "rules").collect()} == {"A": 1, "B": 20}


def test_a_committed_batch_stays(spark, log):
    log.apply(1, rules=rules(spark, [("A", False, 11, "{}", 1)]))
    log.apply(1, rules=rules(spark, [("B", False, 99, "{}", 2)]))
    assert {r["rule_code"]: r["weight"] for r in log.current(spark, "rules").collect()} == {"A": 11, "B": 20}


def test_a_batch_that_stopped_is_not_read_and_is_written_anew(spark, log, monkeypatch):
    write = store.write_batch

    def stop(df, path, batch_id, *more):
        if path.endswith("/audit"):
            raise OSError("lost")
        write(df, path, batch_id, *more)
    monkeypatch.setattr(store, "write_batch", stop)
    change = rules(spark, [("A", False, 11, "{}", 1), ("A", True, 500, "{}", 2)])
    with pytest.raises(OSError):
        log.apply(1, rules=change)
    assert {r["weight"] for r in log.current(spark, "rules").collect()} == {10, 20}
    assert log.refused(spark, "rules").count() == 0 and details(log, spark) == []
    monkeypatch.undo()
    log.apply(1, rules=change)
    assert {r["weight"] for r in log.current(spark, "rules").collect()} == {11, 20} and log.refused(spark, "rules").count() == 1 and len(details(log, spark)) == 1


def test_a_key_with_most_changes_is_split(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), F.col("id").alias("seq"))
    want, last = {}, {}
    for i in range(3000):
        k = "hot" if i % 3 else f"k{i % 7}"
        want[i], last[k] = last.get(k), i
    for limit in (100, None):
        got = settings_log.with_previous(rows, "key", "before", F.col("seq"), limit)
        assert {r["seq"]: r["before"] for r in got.collect()} == want


def test_lists_and_rates_leave_rows(spark, log):
    stamp = {"seq": F.lit(1), "changed_at": F.lit(AT).cast("timestamp_ntz"), "actor": F.lit("ann")}
    log.apply(1, jurisdictions=spark.createDataFrame([("IR", "SANCTIONED", 40, True), ("KP", "SANCTIONED", 40, False)], "country_code string, category string, risk_weight int, active boolean").withColumns(stamp),
              watchlist=spark.createDataFrame([("Acme", "PEP", "XX", True)], "name string, list_type string, country string, active boolean").withColumns(stamp),
              fx=spark.createDataFrame([("USD", "83.5"), ("EUR", "0"), ("GBP", None)], "currency string, rate_to_base string").withColumns(stamp))
    assert details(log, spark) == ["FX rate set to 83.50000000 per base unit", "Jurisdiction IR set to SANCTIONED (weight 40)", "Jurisdiction deactivated", "Watchlist entry added: PEP"]
    assert {r["key"] for r in log.refused(spark, "fx").collect()} == {"EUR", "GBP"}
    assert {r["entity_type"] for r in log.audit_rows(spark).collect()} == {"REFERENCE"}


def test_params_are_parsed_once_a_row(spark):
    """Written out inside every check the text was parsed by each of them: 15 times in the plan."""
    from tallyhound.functions.params import check_config
    df = spark.createDataFrame([("A", 5, '{"minCount":0}')], "rule_code string, weight int, params string")
    checked = check_config(df)
    assert checked.columns == ["rule_code", "weight", "params", "problem"] and checked.first()["problem"] == "minCount must be at least 1"
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
