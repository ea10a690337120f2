"""Rules with engine state: their arithmetic on generated rows, and a stream against the batch rules."""

from datetime import datetime, timedelta

from hypothesis import given, settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import sampledata as sd
from checks import scenario as sc
from tallyhound.operators import rules
from tallyhound.streaming import windows as w

SPANS = w.Spans({"STRUCTURING": (10, 2), "ROUND_AMOUNT_PATTERN": (25, 3)}, 15)
row = st.tuples(st.integers(0, 120), st.integers(1, 9), st.sampled_from([1, 2, 3, 4, 5, 8, 9, 11]))


def plain(rows, until):
    """What has ended by `until`, straight from the definition."""
    out = []
    for code, (span, least) in SPANS.clusters.items():
        left = [r for r in sorted(rows) if r[4] & w.CLUSTER_RULES[code]]
        while left and left[0][0] + span <= until:
            members = [r for r in left if r[0] <= left[0][0] + span]
            if len(members) >= least:
                out += [(code, left[0][1], r[1]) for r in members]
                left = left[len(members):]
            else:
                left = left[1:]
    for d in rows:
        inside = [r for r in rows if r[4] & w.DEBIT and d[0] <= r[0] <= d[0] + SPANS.flow]
        if d[4] & w.DEPOSIT and d[0] + SPANS.flow <= until and inside:
            out.append((w.FLOW_RULE, d[1], d[1], sum(r[3] for r in inside), len(inside)))
    return sorted(out)


@given(st.lists(row, max_size=40), st.lists(st.integers(0, 200), max_size=6))
@limits(max_examples=300, deadline=None)
def test_any_cuts_find_what_one_look_finds(made, watermarks):
    rows = [(at, f"t{i:03}", "c", cents, marks) for i, (at, cents, marks) in enumerate(made)]
    kept, done, got, before = [], {}, [], -1
    for until in sorted({*watermarks, 1000}):
        # Rows later than the next watermark may come with it; none behind the last one.
        kept += [r for r in rows if before < r[0] <= until]
        out, kept, done, end = w.judge(kept, done, SPANS, until)
        assert end is None or end > until
        got += [(o[0], o[2], o[6]) if o[0] != w.FLOW_RULE else (o[0], o[2], o[6], int(o[7]), o[8]) for o in out]
        before = until
    assert sorted(got) == plain(rows, 1000)
    assert all(r[0] >= 1000 for r in kept), "nothing behind the watermark is kept once all windows have ended"


@given(st.lists(row, max_size=40), st.lists(st.integers(0, 200), max_size=6))
@limits(max_examples=300, deadline=None)
def test_marks_tell_the_next_look_what_is_done(made, watermarks):
    rows = [(at, f"t{i:03}", "c", cents, marks) for i, (at, cents, marks) in enumerate(made)]
    kept, got, before = [], [], -1
    for until in sorted({*watermarks, 1000}):
        out, kept, done, _ = w.judge(kept + [r for r in rows if before < r[0] <= until], {}, SPANS, until)
        kept = w.without_done(kept, done)
        got += [(o[0], o[2], o[6]) if o[0] != w.FLOW_RULE else (o[0], o[2], o[6], int(o[7]), o[8]) for o in out]
        before = until
    assert sorted(got) == plain(rows, 1000)


def test_state_keeps_only_open_windows():
    rows = [(i, f"t{i:05}", "c", 1, 1 | w.DEBIT) for i in range(10_000)]
    _, kept, _, _ = w.judge(rows, {}, SPANS, 9_999)
    assert len(kept) <= 11


def test_stream_with_late_rows_and_a_restart(spark, tmp_path):
    at = datetime(2024, 1, 1)
    def rows(*given):
        made = [(f"T{k:03}", "ACC_1" if k % 2 else "ACC_2", "C", at + timedelta(hours=h), "CREDIT", 6000) for k, h in given]
        return spark.createDataFrame(made, "transaction_id string, account_id string, customer_id string, txn_timestamp timestamp_ntz, direction string, amount_base int").withColumn(
            "amount_base", F.col("amount_base").cast("decimal(18,2)"))
    settings = {k: v for k, v in sc.settings(spark).items() if k == "STRUCTURING"}
    job = w.StatefulJob(f"{tmp_path}/out", settings, "6 hours")
    (tmp_path / "in").mkdir()
    feed = spark.readStream.schema(rows((0, 0)).schema).parquet(f"{tmp_path}/in")
    # Three rows of account 1 within a day, the middle one late but within bounds; one row beyond them is dropped.
    for part in [((1, 0), (3, 20)), ((5, 15), (2, 16)), ((4, 60), (7, 61)), ((9, 1), (6, 120))]:
        rows(*part).write.mode("append").parquet(f"{tmp_path}/in")
        job.start(feed, f"{tmp_path}/state").awaitTermination()
    hits = job.hits(spark).collect()
    assert [(h["account_id"], h["evidence_count"], h["anchor_txn_id"], h["last_ts"]) for h in hits] == [("ACC_1", 3, "T001", at + timedelta(hours=20))]
    assert sorted(r["transaction_id"] for r in job.evidence(spark).collect()) == ["T001", "T003", "T005"]
    assert spark.conf.get(w.STORE[0], None) != w.STORE[1], "the session's own store is put back"


def test_accounts_share_the_state_of_a_group(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "transaction_id string, account_id string, customer_id string, txn_timestamp timestamp_ntz, direction string, amount_base decimal(18,2)"
    def rows(first, hours):
        made = [(f"T{first + h}_{a:03}", f"ACC_{a:03}", "C", at + timedelta(hours=h), "CREDIT" if h % 2 else "DEBIT", a % 7 * 1000 + 4000) for a in range(200) for h in hours]
        return spark.createDataFrame([(*r[:5], f"{r[5]}.00") for r in made], schema.replace("decimal(18,2)", "string")).withColumn("amount_base", F.col("amount_base").cast("decimal(18,2)"))
    settings = {k: v for k, v in sc.settings(spark).items() if k in ("STRUCTURING", "RAPID_MOVEMENT")}
    found = {}
    for groups in (1, 4):
        job = w.StatefulJob(f"{tmp_path}/out{groups}", settings, "6 hours", groups)
        (tmp_path / f"in{groups}").mkdir()
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in{groups}")
        held = []
        for part in (range(0, 40), range(40, 150)):
            rows(1000, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{groups}")
            run = job.start(feed, f"{tmp_path}/state{groups}")
            run.awaitTermination()
            held += [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
        # A group has its list of rows and its timer; 200 accounts would have as many lists.
        assert 0 < max(held) <= 2 * groups
        found[groups] = sorted(tuple(r) for r in job.hits(spark).drop("batch_id").collect())
    history = rows(1000, range(150))
    ended = {"STRUCTURING": 24, "RAPID_MOVEMENT": 48}
    for code, hours in ended.items():
        # The watermark is six hours behind the last row, at hour 149.
        batch = rules.registered(code).find(rules.RuleContext(history), settings[code]).hits.where(F.col("first_ts") <= F.lit(at + timedelta(hours=143 - hours)).cast("timestamp_ntz"))
        want = sorted(r["dedup_key"] for r in batch.collect())
        for groups in found:
            assert want and sorted(r[list(batch.columns).index("dedup_key")] for r in found[groups] if r[0] == code) == want
    assert found[1] == found[4]
