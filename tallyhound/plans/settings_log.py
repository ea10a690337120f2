"""Rules, lists and rates kept as change logs, with an audit row per change.

A batch of changes is checked row by row; what fails is stored with its reason and changes nothing. Accepted rows
are appended, the current state is the last row per key, and every change leaves an audit row; that of a rule cites
the settings before and after it. The batch's audit rows are written last and commit it: readers see
committed batches only, and a batch that stopped on the way is written anew.

Changes of a key come in order of `seq`, which rises from batch to batch. A rule must be installed before it can be changed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound import refs
from tallyhound.functions.params import check_config, check_fx
from tallyhound.operators import skew
from tallyhound.operators.cases import audit
from tallyhound.plans import store

STAMP = "seq bigint, changed_at timestamp_ntz, actor string"
RULE_DDL = f"rule_code string, typology string, enabled boolean, weight int, severity string, params string, {STAMP}"
JURISDICTION_DDL = f"country_code string, category string, risk_weight int, active boolean, {STAMP}"
WATCHLIST_DDL = f"name string, list_type string, country string, active boolean, {STAMP}"
FX_DDL = f"currency string, rate_to_base decimal(18,8), {STAMP}"
KINDS = {"rules": ("rule_code", RULE_DDL), "jurisdictions": ("country_code", JURISDICTION_DDL),
         "watchlist": ("name", WATCHLIST_DDL), "fx": ("currency", FX_DDL)}

# Entity types and actions of the audit trail.
ENTITY_RULE, ENTITY_REFERENCE = "RULE", "REFERENCE"
RULE_UPDATED, REFERENCE_DATA_UPDATED = "RULE_UPDATED", "REFERENCE_DATA_UPDATED"


def described(row: Column) -> Column:
    """Settings of a rule as the audit trail cites them."""
    shown = lambda name: F.coalesce(row[name].cast("string"), F.lit("null"))
    return F.concat(F.lit("enabled="), shown("enabled"), F.lit(",weight="), shown("weight"),
                    F.lit(",severity="), shown("severity"), F.lit(",params="), shown("params"))


def with_previous(rows: DataFrame, key: str, name: str, value: Column, hot_limit: float | None = None) -> DataFrame:
    """Add the `value` of the row before, by `seq`, of the same key; null for the first. A key with more rows than a task
    may hold is split: each row asks just before it answers, and the last answer is carried from piece to piece."""
    hot = skew.hot_keys(rows, [key], hot_limit)
    usual, busy = skew.split_hot(rows, hot, [key])
    out = usual.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy("seq")))
    if busy is None:
        return out
    both = busy.withColumn("_value", value).withColumn("_phase", F.explode(F.array(F.lit(0), F.lit(1))))
    cut = skew.cut_into_pieces(both, [key], ["seq", "_phase"])
    found = skew.running_last(cut, [key], ["seq", "_phase"], F.when(F.col("_phase") == 1, F.col("_value")), name)
    return out.unionByName(found.where("_phase = 0").select(*out.columns))


def trail(kind: str, rows: DataFrame) -> DataFrame:
    """Audit rows of accepted changes of one kind; those of rules have a `before`."""
    entity, action = (ENTITY_RULE, RULE_UPDATED) if kind == "rules" else (ENTITY_REFERENCE, REFERENCE_DATA_UPDATED)
    if kind == "rules":
        details = F.concat(F.lit("Changed by "), F.col("actor"), F.lit(" | before: "), F.col("before"), F.lit(" | after: "),
                           described(F.struct("enabled", "weight", "severity", "params")))
    elif kind == "jurisdictions":
        details = F.when(F.col("active"), F.concat(
            F.lit("Jurisdiction "), F.col("country_code"), F.lit(" set to "), F.col("category"), F.lit(" (weight "),
            F.col("risk_weight").cast("string"), F.lit(")"))).otherwise("Jurisdiction deactivated")
    elif kind == "watchlist":
        details = F.when(F.col("active"), F.concat(F.lit("Watchlist entry added: "), F.col("list_type"))).otherwise("Watchlist entry deactivated")
    else:
        details = F.concat(F.lit("FX rate set to "), F.col("rate_to_base").cast("string"), F.lit(" per base unit"))
    return audit(entity, action, rows, F.col(KINDS[kind][0]), F.col("changed_at"), details, actor=F.col("actor"))


@dataclass(frozen=True)
class SettingsLog:
    """The change logs under a folder."""
    path: str

    def log(self, spark: SparkSession, kind: str, before: int | None = None) -> DataFrame:
        """All accepted changes of committed batches (of batches numbered below `before`)."""
        rows = store.read_log(spark, f"{self.path}/{kind}", KINDS[kind][1])
        return rows.where(F.col("batch_id") < before if before is not None else F.col("batch_id") <= self.last_committed(spark))

    def last_committed(self, spark: SparkSession) -> int:
        return store.last_committed(spark, f"{self.path}/audit")

    def current(self, spark: SparkSession, kind: str, before: int | None = None) -> DataFrame:
        """The last accepted row per key."""
        key = KINDS[kind][0]
        rows = self.log(spark, kind, before).select(*[part.split(" ", 1)[0] for part in KINDS[kind][1].split(", ")])
        return refs.latest_by_key(rows.withColumn("_at", F.col("seq")), key, "_at").drop("changes")

    def install(self, rules: DataFrame, at: datetime) -> None:
        """The first settings of all rules, as batch 0 and without audit rows."""
        spark = rules.sparkSession
        if self.last_committed(spark) >= 0:
            return
        rows = rules.select("rule_code", "typology", "enabled", "weight", "severity", "params").withColumns(
            {"seq": F.lit(-1), "changed_at": F.lit(at).cast("timestamp_ntz"), "actor": F.lit("system")})
        store.write_batch(_shaped(rows, RULE_DDL), f"{self.path}/rules", 0)
        empty = spark.createDataFrame([], RULE_DDL + ", before string")
        store.write_batch(trail("rules", empty).unionByName(_marker(spark)), f"{self.path}/audit", 0)

    def apply(self, batch_id: int, **changes: DataFrame) -> None:
        """Store a batch of changes by kind: the accepted ones, the refused ones with their `problem`, and audit rows."""
        spark = next(iter(changes.values())).sparkSession
        if batch_id <= self.last_committed(spark):
            return

        def stored_kind(kind: str) -> DataFrame:
            key, ddl = KINDS[kind]
            judged = store.kept(self.judge(kind, _shaped(changes[kind], ddl), batch_id), f"{self.path}/{kind}-judged", batch_id)
            good = judged.where("problem is null").drop("problem")
            refused = judged.where("problem is not null").select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "seq", "changed_at", "actor", "problem")
            store.write_batch(good, f"{self.path}/{kind}", batch_id)
            store.write_batch(refused, f"{self.path}/refused-{kind}", batch_id)
            return trail(kind, self.before(spark, good, batch_id) if kind == "rules" else good)

        # The kinds' jobs share the cluster, so one kind's last tasks do not leave it idle.
        with ThreadPoolExecutor(max_workers=len(changes)) as pool:
            rows = list(pool.map(stored_kind, changes))
        made = rows[0]
        for more in rows[1:]:
            made = made.unionByName(more)
        store.write_batch(made.unionByName(_marker(spark)), f"{self.path}/audit", batch_id)

    def judge(self, kind: str, given: DataFrame, batch_id: int) -> DataFrame:
        """Add `problem`, null where a change may be made."""
        nameless = F.when(F.col(KINDS[kind][0]).isNull(), F.lit("key is required"))
        if kind == "rules":
            known = skew.checked_side(self.current(given.sparkSession, "rules", batch_id).select(F.col("rule_code").alias("_known")))
            met = check_config(given).join(known, F.col("rule_code") == F.col("_known"), "left")
            unknown = F.when(F.col("_known").isNull(), F.concat(F.lit("Rule not found: "), F.col("rule_code")))
            return met.withColumn("problem", F.coalesce(nameless, unknown, F.col("problem"))).drop("_known")
        if kind == "fx":
            return check_fx(given).withColumn("problem", F.coalesce(nameless, F.col("problem")))
        return given.withColumn("problem", nameless)

    def before(self, spark: SparkSession, changed: DataFrame, batch_id: int) -> DataFrame:
        """Changed rules with `before`, the settings that each change met: those of the last change
        in the batch, or what stood before the batch."""
        stood = self.current(spark, "rules", batch_id).join(changed.select("rule_code").distinct(), "rule_code", "left_semi")
        rows = _shaped(stood, RULE_DDL).withColumn("_new", F.lit(False)).unionByName(_shaped(changed, RULE_DDL).withColumn("_new", F.lit(True)))
        return with_previous(rows, "rule_code", "before", described(F.struct("enabled", "weight", "severity", "params"))).where("_new").drop("_new")

    def audit_rows(self, spark: SparkSession) -> DataFrame:
        """Audit rows of committed batches."""
        rows = store.read_log(spark, f"{self.path}/audit", AUDIT_DDL)
        return rows.where((F.col("batch_id") <= self.last_committed(spark)) & (F.col("entity_type") != MARKER)).drop("batch_id")

    def refused(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = store.read_log(spark, f"{self.path}/refused-{kind}", "kind string, key string, seq bigint, changed_at timestamp_ntz, actor string, problem string")
        return rows.where(F.col("batch_id") <= self.last_committed(spark)).drop("batch_id")


AUDIT_DDL = ("entity_type string, entity_id string, action string, actor string, actor_roles string, from_state string, to_state string, "
             "details string, occurred_at timestamp_ntz, event_seq bigint")
# One row of a batch's audit folder says that the batch is whole, also where nothing was changed.
MARKER = "BATCH"


def _marker(spark: SparkSession) -> DataFrame:
    none = F.lit(None).cast("string")
    return _shaped(spark.range(1).select(
        F.lit(MARKER).alias("entity_type"), none.alias("entity_id"), none.alias("action"), none.alias("actor"), none.alias("actor_roles"), none.alias("from_state"),
        none.alias("to_state"), none.alias("details"), none.alias("occurred_at"), F.lit(0).alias("event_seq")), AUDIT_DDL)


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of `ddl`, others left behind."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (part.split(" ", 1) for part in ddl.split(", "))])
