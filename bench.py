"""Headline timings on the given tables; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs
to its full result (a no-op sink), once, after one small warm-up job.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import scenario as sc  # noqa: E402
from checks.queries import REGISTRY, files_like  # noqa: E402
from tallyhound import refs  # noqa: E402
from tallyhound.operators import alerts as al  # noqa: E402
from tallyhound.operators import rules  # noqa: E402
from tallyhound.plans import detection, store  # noqa: E402
from tallyhound.plans.ingest import ingest  # noqa: E402
from tallyhound.session import build_session, work_folder  # noqa: E402
from tallyhound.streaming.job import StreamJob  # noqa: E402
from checks import sampledata as sd  # noqa: E402

# The rules, the chain from raw rows to alerts, and the reports on them.
QUERIES = [
    "det_threshold", "det_listed_party", "det_structuring", "det_round_amounts", "det_rapid_movement", "det_behaviour",
    "det_clusters", "det_clusters_with_ties", "det_daily_volume", "val_rejects", "val_accepted",
    "sco_scored_hits", "alr_merge_repeats", "alr_queue", "lim_timeline", "agg_heatmap_grid", "agg_productivity",
    "agg_rule_quality", "lif_alert_replay", "lif_open_cases", "rep_masked_customers", "rep_sar_narrative", "flagship_alert_queue",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def ingest_and_detect(spark, sf: str) -> None:
    """Raw rows to stored ledger, logged findings of all rules, and the alert table."""
    folder = work_folder(spark, "bench")
    done = ingest(files_like(sd.ledger(spark, sf)), sd.accounts(spark, sf), refs.fx_rates(spark), sc.AS_OF,
                  keep=lambda df: store.kept(df, f"{folder}/checked", 0), spread=spark.sparkContext.defaultParallelism)
    store.write_ledger(done.accepted, f"{folder}/ledger", 0)
    store.write_batch(done.rejected, f"{folder}/rejects", 0)
    ledger = store.read_ledger_log(spark, f"{folder}/ledger")
    detection.run_detection(rules.RuleContext(ledger), sc.settings(spark), f"{folder}/findings", 0, sc.AS_OF)
    run(al.derive_alerts(detection.read_hits(spark, f"{folder}/findings"), sd.customers(spark, sf), sc.settings(spark)))


def micro_batches(spark, sf: str) -> float:
    """Seconds of one micro-batch of some hundred rows on top of a stored ledger, after a warm-up one."""
    job = StreamJob(work_folder(spark, "bench-stream"), lambda: sd.accounts(spark, sf), lambda: sc.AS_OF,
                    config=lambda: refs.rule_config(spark, sc.RULES), strict=False, spread=spark.sparkContext.defaultParallelism)
    raw = files_like(sd.ledger(spark, sf))
    late = "txn_timestamp >= '2024-01-30'"
    job.process(raw.where(f"not ({late})"), 0)
    job.process(raw.where(f"{late} and row_number % 40 = 1"), 1)
    began = time.perf_counter()
    job.process(raw.where(f"{late} and row_number % 40 = 2"), 2)
    return round(time.perf_counter() - began, 3)


def detect_all_rules(spark, sf: str) -> None:
    """Hits of all six rules over the ledger, scored and de-duplicated."""
    run(al.derive_alerts(sc.all_findings(spark, sf).hits, sd.customers(spark, sf), sc.settings(spark)))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    run(sd.ledger(spark, sf).limit(10))
    sc.settings(spark)

    seconds = {}

    def timed(name: str, work) -> None:
        began = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - began, 3)

    timed("ingest_and_detect", lambda: ingest_and_detect(spark, sf))
    # The size the published figures are for, once everything is warm.
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    timed("ingest_and_detect_sf0.01", lambda: ingest_and_detect(spark, small))
    seconds["micro_batch_sf0.01"] = micro_batches(spark, small)
    timed("detect_all_rules", lambda: detect_all_rules(spark, sf))
    # Findings, alerts and cases the report queries read, written as the jobs write them.
    for name in ("hits", "evidence", "alerts", "cases", "replayed_cases"):
        timed(f"write_{name}", lambda: getattr(sc, name)(spark, sf))
    for name in QUERIES:
        timed(name, lambda: run(REGISTRY[name](spark, sf)))

    transactions = sd.table(spark, sf, "events").count()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "transactions": transactions,
        "ingest_and_detect_per_sec": round(transactions / seconds["ingest_and_detect"]),
        "detect_per_sec": round(transactions / seconds["detect_all_rules"])}))
    spark.stop()


if __name__ == "__main__":
    main()
