"""Top-n of hot keys in two levels, and united windows in place of pairs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyhound.operators import flows, skew


def test_top_n_of_a_key_in_many_partitions(spark):
    rows = spark.range(0, 20_000, 1, 200).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("c"), F.col("id") % 50)).otherwise("hot").alias("k"),
                                                  (F.col("id") * 7919 % 5003).alias("v"), "id")
    n, salts = 5, 16
    got = skew.top_n(rows, ["k"], [F.desc("v"), F.asc("id")], n, "place", salts)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (-r["v"], r["id"])):
        if len(want.setdefault(r["k"], [])) < n:
            want[r["k"]].append(r["id"])
    found = {}
    for r in got.orderBy("k", "place").collect():
        assert r["place"] == len(found.setdefault(r["k"], [])) + 1
        found[r["k"]].append(r["id"])
    assert found == want
    # Rows of the hot key that reach a task of each level.
    dealt = rows.where("k = 'hot'").withColumns({"p": F.spark_partition_id(), "s": F.pmod(F.spark_partition_id(), F.lit(salts))})
    first = dealt.groupBy("s", "p").count().groupBy("s").agg(F.sum(F.least("count", F.lit(n))).alias("rows")).agg(F.max("rows"), F.count("s")).first()
    assert first[0] <= 2 * n * salts and first[1] * n <= n * salts
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4, "both levels cut before their shuffle"


def test_united_windows_meet_each_debit_once(spark):
    at = datetime(2024, 1, 1)
    hours = [0, 1, 2, 30, 47, 50, 200, 200, 300]
    windows = spark.createDataFrame([("c1", "a", at + timedelta(hours=h)) for h in hours] + [("c2", "a", at + timedelta(hours=199)), ("c1", "b", at)], "case_ref string, account_id string, first_ts timestamp_ntz")
    debits = [(f"t{k}", acc, at + timedelta(hours=h), d) for k, (acc, h, d) in enumerate([("a", h, "DEBIT") for h in range(0, 400, 3)] + [("a", 1, "CREDIT"), ("b", 48, "DEBIT"), ("b", 49, "DEBIT"), ("z", 1, "DEBIT")])]
    ledger = spark.createDataFrame(debits, "transaction_id string, account_id string, txn_timestamp timestamp_ntz, direction string")
    got = [tuple(r) for r in flows.outflows_within(windows, ["case_ref"], ledger, 48).select("case_ref", "transaction_id").collect()]
    want = {(w["case_ref"], t) for w in windows.collect() for t, acc, ts, d in debits if d == "DEBIT" and acc == w["account_id"] and w["first_ts"] <= ts <= w["first_ts"] + timedelta(hours=48)}
    assert len(got) == len(set(got)) and set(got) == want
    assert "CartesianProduct" not in flows.outflows_within(windows, ["case_ref"], ledger, 48)._jdf.queryExecution().executedPlan().toString()
