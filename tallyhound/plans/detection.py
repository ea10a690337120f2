"""The detection job: every active rule writes its own part of the hit log."""

from __future__ import annotations

import dataclasses
import logging
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyhound.functions.params import RuleSetting
from tallyhound.operators import rules
from tallyhound.plans.store import write_batch
from tallyhound.schemas import EVIDENCE_DDL, HIT_DDL
from tallyhound.session import cut_lineage

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunResult:
    evaluated: int
    hits: int
    failed_rules: list[str]
    duration_ms: int


def run_detection(contexts: rules.RuleContext | dict[str, rules.RuleContext], settings: dict[str, RuleSetting],
                  path: str, batch_id: int, detected_at, only: list[str] | None = None, label: str = "{}") -> RunResult:
    """Run each rule (of `only`, if given) as its own write. A rule that fails is reported and skipped;
    the findings of the others are kept. `contexts` may differ by rule scope; `label` names the
    runs, by rule, so that a rule may run twice for a batch."""
    if isinstance(contexts, rules.RuleContext):
        contexts = {scope: contexts for scope in rules.SCOPES}
    contexts = {scope: dataclasses.replace(c, keep=cut_lineage) for scope, c in contexts.items()}
    began = time.monotonic()
    active = [r for r in rules.active_rules(settings) if only is None or r.code in only]
    if any(r.scope == rules.ACCOUNT_WINDOW for r in active):
        contexts[rules.ACCOUNT_WINDOW] = contexts[rules.ACCOUNT_WINDOW].counted()

    def run_rule(r: rules.Rule) -> int | None:
        try:
            found = r.find(contexts[r.scope], settings[r.code])
            seen = Observation()
            stamped = found.hits.withColumn("detected_at", F.lit(detected_at).cast("timestamp_ntz"))
            # Evidence first: hits appear only once everything they cite is in place.
            run = label.format(r.code)
            write_batch(found.evidence, f"{path}/evidence/run={run}", batch_id)
            write_batch(stamped.observe(seen, F.count(F.lit(1)).alias("hits")), f"{path}/hits/run={run}", batch_id)
            return seen.get["hits"]
        except Exception:
            log.exception("rule %s failed and is skipped for batch %s", r.code, batch_id)
            # An earlier attempt at the batch may have got further.
            for kind, ddl in (("evidence", EVIDENCE_DDL), ("hits", HIT_DDL + ", detected_at timestamp_ntz")):
                write_batch(contexts[r.scope].current.sparkSession.createDataFrame([], ddl), f"{path}/{kind}/run={label.format(r.code)}", batch_id)
            return None

    # The rules' jobs share the cluster, so one rule's last tasks do not leave it idle.
    with ThreadPoolExecutor(max_workers=max(1, len(active))) as pool:
        evaluated = pool.submit(contexts[rules.TRANSACTION].current.count)
        counts = list(pool.map(run_rule, active))
    failed = [r.code for r, n in zip(active, counts) if n is None]
    return RunResult(evaluated.result(), sum(n or 0 for n in counts), failed, int((time.monotonic() - began) * 1000))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    ddl = HIT_DDL + ", detected_at timestamp_ntz, run string, batch_id bigint"
    return spark.read.schema(ddl).parquet(f"{path}/hits").drop("run")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    ddl = EVIDENCE_DDL + ", run string, batch_id bigint"
    return spark.read.schema(ddl).parquet(f"{path}/evidence").drop("run")
