from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhound import refs
from tallyhound.operators.validate import BUSINESS, Check
from tallyhound.plans import store
from tallyhound.plans.ingest import batch_report, ingest, ingest_accounts, ingest_customers, summarise
from tallyhound.sources import files
from checks import sampledata as sd

AS_OF = datetime(2026, 9, 19)
ACCOUNTS = "account_id string, customer_id string"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def accounts(spark):
    return spark.createDataFrame([("A1", "C1"), ("A2", "C2")], ACCOUNTS)


CSV = """ Account_ID ,TRANSACTION_ID,amount,direction,transaction_date,currency,customer_id,counterparty_country,description
A1,T1,100.005,CR,2026-09-18 10:00:00,,C1,ir,"two
lines, one ""quoted"" value"
A1,T2,5,DR,18/09/2026 10:00:00,usd,,IN,
A9,T3,5,DR,2026-09-18,INR,,,
A1,T1,7,DR,2026-09-18,INR,,,
A1,T4,0,DR,2026-09-18,INR,,,
A1,T4,9,DR,2026-09-18,INR,,,
A1,T5,9,DR,2026-09-19T00:05:01,INR,,,
A1,T6,9,DR,2026-09-19T00:05:00,INR,,,
A2,T7,9,DR,2026-09-18,INR,C1,,
"""


def test_csv_end_to_end(spark, tmp_path):
    rows = files.read_csv(spark, write(tmp_path / "t.csv", CSV), multi_line=True)
    raw = files.to_raw_transactions(rows)
    done = ingest(raw, accounts(spark), refs.fx_rates(spark), AS_OF)
    good = {r["transaction_id"]: r for r in done.accepted.collect()}
    # T4 is rejected first (amount 0), so its later good row is not a repeat.
    assert sorted(good) == ["T1", "T2", "T4", "T6"]
    assert str(good["T1"]["amount"]) == "100.01" and good["T1"]["counterparty_country"] == "IR" and good["T1"]["currency"] == "INR"
    assert good["T1"]["description"] == 'two\nlines, one "quoted" value' and good["T1"]["status"] == "POSTED"
    assert str(good["T2"]["amount_base"]) == "416.00" and good["T2"]["customer_id"] == "C1"
    bad = [(r["row_number"], r["record_key"], r["error_type"]) for r in done.rejected.orderBy("row_number").collect()]
    assert bad == [(3, "T3", "REFERENTIAL_INTEGRITY"), (4, "T1", "BUSINESS_RULE"), (5, "T4", "STRUCTURAL"), (7, "T5", "BUSINESS_RULE"),
                   (9, "T7", "REFERENTIAL_INTEGRITY")]
    summary = summarise(done.checked, "t.csv", AS_OF).first()
    assert (summary["total_records"], summary["accepted_records"], summary["rejected_records"], summary["status"]) == (9, 4, 5, "COMPLETED_WITH_ERRORS")
    one = summarise(done.checked, "t.csv", AS_OF)
    report = batch_report(one, done.rejected.withColumn("batch_ref", F.lit(summary["batch_ref"])))
    assert [r["row_number"] for r in report.collect()] == [3, 4, 5, 7, 9]


def test_row_numbers_run_on_over_files_and_splits(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"p{i}.csv", "id,v\n" + "".join(f"{i}-{k},x\n" for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = files.read_csv(spark, str(tmp_path), multi_line=False).orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_number"] for r in rows] == list(range(1, 1201))
    assert [r["id"] for r in rows] == [f"{i}-{k}" for i in range(3) for k in range(400)]


def test_unreadable_csv_stops_the_read(spark, tmp_path):
    with pytest.raises(Exception):
        files.read_csv(spark, write(tmp_path / "bad.csv", "a,b\n1,2,3,4\n")).collect()


def test_json(spark, tmp_path):
    path = write(tmp_path / "t.json", "\n".join([
        '{"transactionId":"T1","accountId":"A1","txnTimestamp":"2026-09-18T10:00:00","direction":"credit","amount":5.5,"currency":"INR"}',
        '{"transactionId":"T2","accountId":"A1","txnTimestamp":"2026-09-18T10:00:00","direction":"CR","amount":5.5,"currency":"INR"}',
        '{"transactionId":"T3","accountId":"A1","txnTimestamp":"2026-09-18T10:00:00","direction":"DEBIT","amount":0.001,"currency":"INR"}',
        '{"transactionId":"%s","accountId":"A1","txnTimestamp":"2026-09-18T10:00:00","direction":"DEBIT","amount":1,"currency":"INR"}' % ("X" * 41)]))
    done = ingest(files.read_json(spark, path), accounts(spark), refs.fx_rates(spark), AS_OF, strict=True)
    assert [(r["transaction_id"], r["direction"], r["status"]) for r in done.accepted.collect()] == [("T1", "CREDIT", "POSTED")]
    assert sorted(r["error_message"] for r in done.rejected.collect()) == [
        "amount must be greater than zero", "direction must be CREDIT or DEBIT", "size must be between 0 and 40"]


def test_extra_check_joins_the_chain(spark, sf):
    extra = Check(40, F.col("channel") == "BRANCH", BUSINESS, F.lit("closed channel"))
    raw = sd.dirty_transactions(spark, sf)
    with_it = ingest(raw, sd.accounts(spark, sf), refs.fx_rates(spark), datetime(2024, 2, 1), extra=[extra])
    assert with_it.accepted.where("channel = 'BRANCH'").count() == 0
    assert with_it.accepted.count() + with_it.rejected.count() == raw.count()


def test_a_bad_rate_stops_a_batch(spark, sf):
    rates = refs.fx_rates(spark)
    for bad in (0, -1, None):
        wrong = rates.withColumn("rate_to_base", F.when(F.col("currency") == "USD", F.lit(bad).cast("decimal(18,8)")).otherwise(F.col("rate_to_base")))
        with pytest.raises(ValueError, match="rate must be greater than zero: USD"):
            ingest(sd.dirty_transactions(spark, sf), sd.accounts(spark, sf), wrong, datetime(2024, 2, 1))


def test_message_is_clipped(spark):
    raw = spark.createDataFrame([(1, "T", "A" * 600, "2026-09-18", "CR", "1", "INR")],
                                "row_number long, transaction_id string, account_id string, txn_timestamp string, direction string, amount string, currency string")
    done = ingest(files.to_raw_transactions(raw), accounts(spark), refs.fx_rates(spark), AS_OF)
    message = done.rejected.first()["error_message"]
    assert len(message) == 500 and message.endswith("...")


def test_master_files(spark, tmp_path):
    people = files.read_csv(spark, write(tmp_path / "c.csv", "customer_id,first_name,risk_rating,is_politically_exposed\nC1,Ann,high,Y\n,Bob,,\nC1,Cid,,\nC2,,odd,0\n"))
    done = ingest_customers(people)
    good = done.accepted.orderBy("customer_id").collect()
    assert [(r["customer_id"], r["first_name"], r["last_name"], r["country"], r["kyc_status"], r["risk_rating"], r["is_politically_exposed"], r["num_complaints_last_year"]) for r in good] == [
        ("C1", "Ann", "Unknown", "IN", "PENDING", "HIGH", True, 0), ("C2", "Unknown", "Unknown", "IN", "PENDING", "LOW", False, 0)]
    assert [(r["row_number"], r["error_type"]) for r in done.rejected.orderBy("row_number").collect()] == [(2, "STRUCTURAL"), (3, "BUSINESS_RULE")]
    held = files.read_csv(spark, write(tmp_path / "a.csv", "account_id,customer_id,current_balance\nA1,CX,1\nA1,C1,2\nA2,C2,bad\n"))
    acc = ingest_accounts(held, done.accepted)
    # The first A1 row counts as seen although its owner is unknown.
    assert [(r["row_number"], r["error_type"]) for r in acc.rejected.orderBy("row_number").collect()] == [(1, "REFERENTIAL_INTEGRITY"), (2, "BUSINESS_RULE")]
    row = acc.accepted.first()
    assert (row["account_id"], row["account_type"], row["currency"], str(row["current_balance"])) == ("A2", "SAVINGS", "INR", "0.00")


def test_ledger_log(spark, tmp_path, sf):
    path = str(tmp_path / "ledger")
    rows = sd.ledger(spark, sf)
    store.write_ledger(rows, path, 0)
    again = rows.where("account_id = 'ACC_1'").withColumn("account_id", F.lit("ACC_2"))
    store.write_ledger(again, path, 1)
    store.write_ledger(again, path, 1)
    log = store.read_ledger_log(spark, path)
    now = store.current_ledger(log)
    assert now.count() == rows.count() and now.where("account_id = 'ACC_1'").count() == 0
    two = spark.createDataFrame([("ACC_2",)], "account_id string")
    expect = now.where("account_id = 'ACC_2'")
    assert store.current_rows_of(log, two, "account_id").exceptAll(expect).count() == 0
    assert store.current_rows_of(log, two, "account_id").count() == expect.count()
    # Read by places, as a job does, and with other days than the moved rows' closed.
    assert store.current_slice(spark, path, F.lit(True)).exceptAll(now).count() == 0
    assert store.current_slice(spark, path, F.lit(True)).count() == now.count()
    store.compact_ledger(spark, path, str(tmp_path / "compact"))
    assert store.read_ledger_log(spark, str(tmp_path / "compact")).count() == rows.count()
    order = store.in_detection_order(now).select("account_id", "txn_timestamp").rdd.glom().first()
    assert order == sorted(order)


def test_a_cut_ledger_knows_of_rows_moved_elsewhere(spark, tmp_path, sf):
    path = str(tmp_path / "ledger")
    rows = sd.ledger(spark, sf)
    day = F.to_date("txn_timestamp")
    first = rows.select(day.alias("d")).orderBy("d").first()["d"]
    mine = rows.where(day == F.lit(first)).limit(5)
    away = mine.withColumn("txn_timestamp", F.col("txn_timestamp") + F.expr("INTERVAL 400 DAYS"))
    mine, away = store.kept(mine, str(tmp_path / "m"), 0), store.kept(away, str(tmp_path / "a"), 0)
    for i, batch in enumerate([rows, away, *[rows.limit(0)] * 6, mine, away, away]):
        store.write_ledger(batch, path, i)
    here = F.col("txn_date") == F.lit(first)
    gone = {r["transaction_id"] for r in mine.collect()}
    seen = {r["transaction_id"] for r in store.current_slice(spark, path, here).collect()}
    assert seen == {r["transaction_id"] for r in rows.where(day == F.lit(first)).collect()} - gone
    later = store.current_slice(spark, path, F.col("txn_date") > F.lit(first))
    assert later.where(F.col("transaction_id").isin(sorted(gone))).count() == len(gone) == 5
    assert later.count() == rows.count() - len(seen)
    # Only the opened day is read, of the ledger and of the notes.
    plan = store.current_slice(spark, path, here)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(txn_date") >= 2


def test_masters_are_dealt_to_tasks(spark, sf, tmp_path):
    """A file in one split is parsed by as many tasks as asked for, with the same rows stored."""
    from checks.queries import _account_rows, _customer_rows
    from tallyhound.plans.ingest import load_masters
    customers, accounts = _customer_rows(spark, sf), _account_rows(spark, sf)
    kept = {}
    for spread in (None, 4):
        path = f"{tmp_path}/{spread}"
        load_masters(customers, accounts, path, 0, datetime(2024, 2, 1), spread=spread)
        kept[spread] = [sorted(map(str, spark.read.parquet(f"{path}/{t}").collect())) for t in ("customers", "accounts", "customer_rejects", "account_rejects", "master_batches")]
        files = spark.read.parquet(f"{path}/customers").inputFiles()
        assert len(files) == 1 if spread is None else len(files) == 4
    assert kept[None] == kept[4]
