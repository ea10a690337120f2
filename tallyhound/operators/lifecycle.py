"""Alert and case states, replayed from append-only event logs.

An event asks to move an entity to a state. It is applied if the move is legal from
the state reached so far, and refused otherwise, so each answer depends on
all events before it. A move to the state already held changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.functions import text
from tallyhound.operators import skew
from tallyhound.schemas import ALERT_MOVES, CASE_MOVES, SENIOR_DISPOSITIONS
from tallyhound.session import cut_lineage

CLOSED = "CLOSED"
# Events of one entity gathered into one row; longer histories are cut.
GATHER_LIMIT = 1_000
_ORDER = ["occurred_at", "event_seq"]
EVENT_COLUMNS = ["entity_id", *_ORDER, "target", "disposition", "reason", "actor", "is_senior", "only_from"]


@dataclass(frozen=True)
class Machine:
    moves: dict[str, list[str]]
    initial: str

    @property
    def states(self) -> list[str]:
        return list(self.moves)

    def legal(self, state: Column, target: Column) -> Column:
        out = F.lit(False)
        for source, targets in self.moves.items():
            if targets:
                out = out | ((state == source) & target.isin(targets))
        return out


ALERT = Machine(ALERT_MOVES, "OPEN")
CASE = Machine(CASE_MOVES, "NEW")


def _close_problem(e: Column) -> Column:
    """Why a move to CLOSED is refused, from the event alone; null if it is not."""
    return (
        F.when(e["target"] != CLOSED, F.lit(None))
        .when(e["disposition"].isNull(), "disposition required")
        .when(text.is_blank(e["reason"]), "reason required")
        .when(e["disposition"].isin(SENIOR_DISPOSITIONS) & ~F.coalesce(e["is_senior"], F.lit(False)), "senior role required"))


def _outcome(machine: Machine, state: Column, e: Column) -> Column:
    """APPLIED, SAME_STATE, or why the event is refused, given the state before it.

    An event with `only_from` set does nothing in any other state."""
    return (
        F.when((state == e["target"]) | (state != e["only_from"]), "SAME_STATE")
        .when(~machine.legal(state, e["target"]), "illegal move")
        .otherwise(F.coalesce(e["problem"], F.lit("APPLIED"))))


def _after(machine: Machine, state: Column, e: Column) -> Column:
    return F.when(_outcome(machine, state, e) == "APPLIED", e["target"]).otherwise(state)


def replay(events: DataFrame, machine: Machine, gather_limit: int | None = None) -> DataFrame:
    """Every event with `from_state`, `to_state` and `outcome`.

    Ordinary entities are folded whole. For an entity with a long history, each
    piece of it is first reduced to the map from the state before it to the
    state after it. These maps compose, so the state at the start of every piece is
    known without one task reading the whole history.
    """
    if "only_from" not in events.columns:
        events = events.withColumn("only_from", F.lit(None).cast("string"))
    named = events.select(*EVENT_COLUMNS).withColumn("problem", _close_problem(_Row()))
    limit = gather_limit or GATHER_LIMIT
    hot = skew.hot_keys(named, ["entity_id"], limit)
    plain, heavy = skew.split_hot(named, hot, ["entity_id"])
    whole = plain.groupBy("entity_id").agg(_gather().alias("events"))
    out = _unfold(whole.withColumn("start", F.lit(machine.initial)), machine)
    if heavy is not None:
        out = out.unionByName(_unfold(_pieces(heavy, machine, limit), machine))
    return out


class _Row:
    """Reads event fields as columns, as `e["field"]` does inside a fold."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def _gather() -> Column:
    fields = [c for c in EVENT_COLUMNS if c != "entity_id"] + ["problem"]
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _unfold(gathered: DataFrame, machine: Machine) -> DataFrame:
    empty = F.array().cast("array<string>")

    def step(acc, e):
        after = _after(machine, acc["state"], e)
        return F.struct(after.alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen"))

    start = F.struct(F.col("start").alias("state"), empty.alias("seen"))
    before = F.aggregate("events", start, step, lambda acc: acc["seen"])
    rows = gathered.select("entity_id", F.explode(F.arrays_zip(F.col("events").alias("event"), before.alias("before"))).alias("z"))
    e = F.col("event")
    rows = rows.select("entity_id", F.col("z.event").alias("event"), F.col("z.before").alias("from_state"))
    outcome = _outcome(machine, F.col("from_state"), e)
    return rows.select("entity_id", "event.*", "from_state", outcome.alias("outcome")).withColumn(
        "to_state", F.when(F.col("outcome") == "APPLIED", F.col("target")).otherwise(F.col("from_state"))).drop("problem", "only_from")


def _pieces(rows: DataFrame, machine: Machine, limit: int) -> DataFrame:
    """Pieces of `limit` events of long histories, with the state each starts in."""
    key = ["entity_id"]
    placed = skew.running_sum(skew.cut_into_pieces(rows, key, _ORDER), key, _ORDER, {"pos": F.lit(1).cast("long")})
    numbered = placed.withColumn("idx", F.floor((F.col("pos") - 1) / limit))
    gathered = cut_lineage(numbered.groupBy("entity_id", "idx").agg(_gather().alias("events")))

    def run_from(state: str) -> Column:
        return F.aggregate("events", F.lit(state), lambda at, e: _after(machine, at, e))

    maps = gathered.select("entity_id", "idx", _map_of(machine, run_from).alias("ends"))
    return gathered.join(_starts(maps, machine, limit), ["entity_id", "idx"]).drop("idx")


def _map_of(machine: Machine, run_from) -> Column:
    return F.create_map(*[x for s in machine.states for x in (F.lit(s), run_from(s))])


def _starts(maps: DataFrame, machine: Machine, limit: int) -> DataFrame:
    """The state before each map, per entity in `idx` order.

    Maps are gathered `limit` at a time. While an entity has more, each group is
    composed into one map and the groups are solved first, so the levels grow with
    the logarithm of the history and no row ever holds more than `limit` maps.
    """
    maps = cut_lineage(maps)
    group = F.floor(F.col("idx") / limit).alias("group")
    listed = F.array_sort(F.collect_list(F.struct("idx", F.map_entries("ends").alias("ends"))))
    grouped = maps.groupBy("entity_id", group).agg(listed.alias("maps"))

    def after(state: Column, m: Column) -> Column:
        return F.try_element_at(F.map_from_entries(m["ends"]), state)

    if grouped.where("group > 0").isEmpty():
        opened = grouped.select("entity_id", "group", "maps", F.lit(machine.initial).alias("start"))
    else:
        def run_from(state: str) -> Column:
            return F.aggregate("maps", F.lit(state), after)
        composed = grouped.select("entity_id", F.col("group").alias("idx"), _map_of(machine, run_from).alias("ends"))
        upper = _starts(composed, machine, limit).withColumnRenamed("idx", "group")
        opened = grouped.join(upper, ["entity_id", "group"])

    empty = F.array().cast("array<string>")
    first = F.struct(F.col("start").alias("state"), empty.alias("seen"))

    def step(acc, m):
        return F.struct(after(acc["state"], m).alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen"))

    seen = F.aggregate("maps", first, step, lambda acc: acc["seen"])
    zipped = F.arrays_zip(F.transform("maps", lambda m: m["idx"]).alias("idx"), seen.alias("start"))
    return opened.select("entity_id", F.inline(zipped))


def current_state(replayed: DataFrame, machine: Machine) -> DataFrame:
    """One row per entity: the state reached and, if closed, by what decision."""
    order = F.struct(*_ORDER)
    last = replayed.groupBy("entity_id").agg(
        F.max_by("to_state", order).alias("state"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("outcome") == "APPLIED").alias("applied"),
        F.count_if(~F.col("outcome").isin("APPLIED", "SAME_STATE")).alias("refused"),
        F.max(F.when((F.col("outcome") == "APPLIED") & (F.col("target") == CLOSED),
                     F.struct("occurred_at", "disposition", "reason", "actor"))).alias("close"))
    return last.select(
        "entity_id", "state", "events", "applied", "refused", F.col("close.disposition").alias("disposition"),
        F.col("close.reason").alias("disposition_reason"), F.col("close.actor").alias("disposed_by"),
        F.col("close.occurred_at").alias("disposed_at"))


def audit_rows(replayed: DataFrame, entity_type: str) -> DataFrame:
    """One audit row per applied change, states clipped to 32 characters."""
    details = F.when(F.col("disposition").isNotNull(), F.concat(
        F.lit("Disposition: "), F.col("disposition"), F.lit(" — "), F.coalesce("reason", F.lit("null"))))
    return replayed.where("outcome = 'APPLIED'").select(
        F.lit(entity_type).alias("entity_type"), "entity_id",
        F.lit(f"{entity_type}_STATUS_CHANGED").alias("action"), "actor",
        F.when(F.col("is_senior"), "SENIOR_ANALYST").otherwise("ANALYST").alias("actor_roles"),
        text.clip(F.col("from_state"), 32).alias("from_state"), text.clip(F.col("to_state"), 32).alias("to_state"),
        details.alias("details"), "occurred_at", "event_seq")


def audit_trail(audit: DataFrame, entity_type: str | None = None, entity_id: str | None = None, size: int = 50,
                cap: int = 500) -> DataFrame:
    """Newest audit rows first: `size` of them, and never more than `cap`."""
    if entity_type and entity_type.strip():
        audit = audit.where(F.col("entity_type") == entity_type)
    if entity_id and entity_id.strip():
        audit = audit.where(F.col("entity_id") == entity_id)
    return audit.orderBy(F.desc("occurred_at"), F.desc("event_seq"), F.asc("entity_id")).limit(min(size, cap))


def reassignments(assignments: DataFrame, cases: DataFrame) -> DataFrame:
    """Audit rows for changes of assignee, each with the assignee before it; before the
    first one that is the case's own `assigned_to`, its opener.

    Rows are linked to their predecessor by place in the sequence, so a case with a
    very long history is no larger a unit of work than any other."""
    opener = cases.select("case_ref", F.col("assigned_to").alias("_opener"))
    return skewed_lag(assignments, ["case_ref"], ["seq"], "assignee", "previous").join(opener, "case_ref", "left").select(
        "case_ref", "seq", text.clip(F.coalesce("previous", "_opener"), 32).alias("from_state"),
        text.clip(F.col("assignee"), 32).alias("to_state"), F.lit("CASE_ASSIGNED").alias("action"),
        F.lit("Reassigned").alias("details"))


def skewed_lag(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`lag(value)` per key; keys too large for one task are cut into pieces."""
    hot = skew.hot_keys(df, keys)
    plain, heavy = skew.split_hot(df, hot, keys)
    out = plain.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    if heavy is not None:
        cut = skew.cut_into_pieces(heavy, keys, order)
        cut = cut_lineage(skew.running_sum(cut, keys, order, {"_pos": F.lit(1).cast("long")}))
        ahead = cut.select(*keys, (F.col("_pos") + 1).alias("_pos"), F.col(value).alias(name))
        out = out.unionByName(cut.join(ahead, [*keys, "_pos"], "left").drop("_pos", "piece"))
    return out


def last_assignee(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("case_ref").agg(F.max_by("assignee", "seq").alias("assigned_to"),
                                               F.count(F.lit(1)).alias("assignments"))
