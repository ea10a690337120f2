"""Detection rules: each maps a ledger to findings.

A rule is a function registered with `@rule`. It returns `Findings`: one row per
hit, and the evidence in long form, one row per (hit, transaction). Evidence is
never gathered into one array, because a single hit may cite any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound import refs, wording
from tallyhound.functions import money, text
from tallyhound.functions.params import RuleSetting
from tallyhound.operators import clusters, flows, skew
from tallyhound.schemas import EVIDENCE_DDL, HIT_DDL

TRANSACTION, ACCOUNT_WINDOW, CUSTOMER_WINDOW = "TRANSACTION", "ACCOUNT_WINDOW", "CUSTOMER_WINDOW"
SCOPES = [TRANSACTION, ACCOUNT_WINDOW, CUSTOMER_WINDOW]


@dataclass(frozen=True)
class RuleContext:
    """What a rule may read.

    `ledger` is all history in range. `fresh` holds the rows of the current
    batch; rules on single transactions and on customer days look only at those.
    """
    ledger: DataFrame
    jurisdictions: DataFrame | None = None
    watchlist: DataFrame | None = None
    fresh: DataFrame | None = None
    hot_limit: float | None = None
    # Stores what hits and evidence are both made of; without it each is computed by itself.
    keep: Callable[[DataFrame], DataFrame] | None = None

    def kept(self, df: DataFrame) -> DataFrame:
        return self.keep(df) if self.keep else df

    def counted(self) -> RuleContext:
        """The same, after one count for all account rules: if no account has more rows than the lowest of
        their limits, none is hot for any rule, and no rule counts again."""
        if self.hot_limit is None and skew.busiest(self.ledger, ["account_id"]) <= min(clusters.FOLD_ROWS, skew.HOT_ROWS):
            return replace(self, hot_limit=skew.NEVER)
        return self

    @property
    def current(self) -> DataFrame:
        return self.ledger if self.fresh is None else self.fresh


@dataclass(frozen=True)
class Findings:
    hits: DataFrame
    evidence: DataFrame


@dataclass(frozen=True)
class Rule:
    code: str
    typology: str
    scope: str
    find: Callable[[RuleContext, RuleSetting], Findings] = field(repr=False)


_REGISTRY: dict[str, Rule] = {}


def rule(code: str, typology: str, scope: str):
    """Register a detection rule. It runs once a settings row enables it."""
    def register(find):
        _REGISTRY[code] = Rule(code, typology, scope, find)
        return find
    return register


def register(r: Rule) -> None:
    """Put a rule in, in place of one of the same code."""
    _REGISTRY[r.code] = r


def unregister(code: str) -> None:
    _REGISTRY.pop(code, None)


def registered_codes() -> list[str]:
    return list(_REGISTRY)


def registered(code: str) -> Rule:
    return _REGISTRY[code]


def active_rules(settings: dict[str, RuleSetting]) -> list[Rule]:
    """Registered rules whose settings row enables them; no row means not active."""
    return [r for code, r in _REGISTRY.items() if code in settings and settings[code].enabled]


def max_lookback_hours(settings: dict[str, RuleSetting]) -> int:
    """Longest window of any account rule, disabled ones included."""
    hours = [int(settings[c].params.get("windowHours", 24)) if c in settings else 24
             for c, r in _REGISTRY.items() if r.scope == ACCOUNT_WINDOW]
    return max(hours, default=48)


def _shape(df: DataFrame, ddl: str) -> DataFrame:
    wanted = [part.split(" ", 1) for part in ddl.split(", ")]
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted])


def hit_rows(df: DataFrame, code: str, typology: str, **columns: Column) -> DataFrame:
    given = {"jurisdiction_uplift": F.lit(0), "magnitude_ratio": F.lit(1), **columns}
    return _shape(df.withColumns({"rule_code": F.lit(code), "typology": F.lit(typology), **given}), HIT_DDL)


def evidence_rows(df: DataFrame, code: str, **columns: Column) -> DataFrame:
    given = {"position": F.lit(0), **columns}
    return _shape(df.withColumns({"rule_code": F.lit(code), **given}), EVIDENCE_DDL)


def _single_evidence(hits: DataFrame, code: str) -> DataFrame:
    return evidence_rows(hits, code, txn_timestamp=F.col("first_ts"), transaction_id=F.col("anchor_txn_id"))


@rule("CTR_THRESHOLD", "THRESHOLD_BREACH", TRANSACTION)
def threshold(ctx: RuleContext, s: RuleSetting) -> Findings:
    """Single transactions at or above the reporting threshold, in either direction."""
    limit = s.money("thresholdBase")
    a, t = F.col("amount_base"), F.col("txn_timestamp")
    ratio = F.lit(1) if s.number("thresholdBase") == 0 else money.divide_half_up(a, limit, 4)
    found = ctx.current.where(money.at_least(a, limit))
    hits = hit_rows(
        found, s.code, "THRESHOLD_BREACH",
        dedup_key=text.transaction_key(s.code, F.col("transaction_id")),
        explanation=wording.fill(
            wording.THRESHOLD, txn=F.col("transaction_id"), amount=text.money_text(a), time=text.timestamp_text(t),
            account=F.col("account_id"), limit=text.money_text(limit)),
        evidence_amount_base=a, evidence_count=F.lit(1), magnitude_ratio=ratio,
        first_ts=t, last_ts=t, anchor_txn_id=F.col("transaction_id"))
    return Findings(hits, _single_evidence(hits, s.code))


@rule("HIGH_RISK_JURISDICTION", "JURISDICTION_RISK", TRANSACTION)
def listed_party(ctx: RuleContext, s: RuleSetting) -> Findings:
    """Counterparties in a listed country or on the watchlist, at any amount."""
    spark = ctx.ledger.sparkSession
    countries = refs.active_jurisdictions(ctx.jurisdictions if ctx.jurisdictions is not None else refs.jurisdictions(spark))
    names = refs.active_watchlist(ctx.watchlist if ctx.watchlist is not None else refs.watchlist(spark))
    by_country = countries.select(F.col("country_code").alias("_code"), F.struct(
        "country_name", "category", "risk_weight", "source").alias("place"))
    by_name = names.select(F.col("normalized_name").alias("_name"), F.struct(
        "name", "list_type", "risk_weight", "notes").alias("party"))

    rows = ctx.current.withColumns({
        "_country": F.upper(text.strip(F.col("counterparty_country"))),
        "_party": F.nullif(text.normalise_party(F.col("counterparty_name")), F.lit(""))})
    # Neither list has a proven bound, so both are counted before they are broadcast.
    matched = (
        rows.join(skew.checked_side(by_country), F.col("_country") == F.col("_code"), "left")
        .join(skew.checked_side(by_name), F.col("_party") == F.col("_name"), "left")
        .where("place is not null or party is not null"))
    place, party = F.col("place"), F.col("party")
    uplift = F.when(place.isNotNull() & (party.isNull() | (place["risk_weight"] >= party["risk_weight"])),
                    place["risk_weight"]).otherwise(party["risk_weight"])
    a, t = F.col("amount_base"), F.col("txn_timestamp")
    place_text = F.when(place.isNotNull(), wording.fill(
        wording.LISTED_PLACE, country=place["country_name"], category=place["category"],
        source=F.coalesce(place["source"], F.lit(wording.LISTED_PLACE_SOURCE)))).otherwise("")
    note = F.when(text.is_blank(party["notes"]), "").otherwise(wording.fill(wording.LISTED_NOTE, note=party["notes"]))
    party_text = F.when(party.isNotNull(), wording.fill(
        wording.LISTED_PARTY, name=party["name"], kind=party["list_type"], note=note)).otherwise("")
    hits = hit_rows(
        matched, s.code, "JURISDICTION_RISK",
        dedup_key=text.transaction_key(s.code, F.col("transaction_id")),
        explanation=wording.fill(
            wording.LISTED, txn=F.col("transaction_id"), amount=text.money_text(a), time=text.timestamp_text(t),
            account=F.col("account_id"), place=place_text, party=party_text),
        evidence_amount_base=a, evidence_count=F.lit(1), jurisdiction_uplift=uplift,
        first_ts=t, last_ts=t, anchor_txn_id=F.col("transaction_id"))
    return Findings(hits, _single_evidence(hits, s.code))


def _cluster_findings(ctx: RuleContext, members: DataFrame, s: RuleSetting, typology: str, explain) -> Findings:
    members = ctx.kept(members)
    key = text.account_day_key(s.code, F.col("account_id"), F.col("cluster_ts"))
    grouped = clusters.summarise(members)
    least = F.lit(s.params["minCount"]).cast("decimal(18,2)")
    hits = hit_rows(
        grouped, s.code, typology,
        customer_id=F.col("cluster_customer_id"), dedup_key=key, explanation=explain,
        evidence_amount_base=F.col("total"), evidence_count=F.col("size"),
        magnitude_ratio=money.divide_half_up(F.col("size").cast("decimal(18,2)"), least, 4),
        first_ts=F.col("cluster_ts"), anchor_txn_id=F.col("cluster_txn_id"))
    return Findings(hits, evidence_rows(members, s.code, dedup_key=key))


def is_structuring(s: RuleSetting) -> Column:
    return money.within(F.col("amount_base"), s.money("lowerBound"), s.money("upperBound"))


def is_round(s: RuleSetting) -> Column:
    return money.at_least(F.col("amount_base"), s.money("minAmountBase")) & money.is_multiple_of(F.col("amount_base"), s.money("roundingUnit"))


def is_deposit(s: RuleSetting) -> Column:
    return (F.col("direction") == "CREDIT") & money.at_least(F.col("amount_base"), s.money("minDepositBase"))


def is_debit() -> Column:
    return F.col("direction") == "DEBIT"


@rule("STRUCTURING", "STRUCTURING", ACCOUNT_WINDOW)
def structuring(ctx: RuleContext, s: RuleSetting) -> Findings:
    """Several amounts just below the threshold on one account within a window."""
    hours, least = s.params["windowHours"], s.params["minCount"]
    rows = ctx.ledger.where(is_structuring(s))
    return structuring_findings(ctx, clusters.find_clusters(rows, hours, least, ctx.hot_limit), s)


def structuring_findings(ctx: RuleContext, members: DataFrame, s: RuleSetting) -> Findings:
    """Findings of clusters, given as members."""
    hours, low, high = s.params["windowHours"], s.money("lowerBound"), s.money("upperBound")
    explain = wording.fill(
        wording.STRUCTURING, count=F.col("size").cast("string"), total=text.money_text(F.col("total")), account=F.col("account_id"),
        hours=hours, start=text.timestamp_text(F.col("cluster_ts")), end=text.timestamp_text(F.col("last_ts")),
        low=text.money_text(low), high=text.money_text(high))
    return _cluster_findings(ctx, members, s, "STRUCTURING", explain)


@rule("ROUND_AMOUNT_PATTERN", "ROUND_AMOUNT", ACCOUNT_WINDOW)
def round_amounts(ctx: RuleContext, s: RuleSetting) -> Findings:
    """Several exact multiples of a round unit on one account within a window."""
    hours, least = s.params["windowHours"], s.params["minCount"]
    rows = ctx.ledger.where(is_round(s))
    return round_findings(ctx, clusters.find_clusters(rows, hours, least, ctx.hot_limit), s)


def round_findings(ctx: RuleContext, members: DataFrame, s: RuleSetting) -> Findings:
    """Findings of clusters, given as members."""
    hours, unit = s.params["windowHours"], s.money("roundingUnit")
    explain = wording.fill(
        wording.ROUND_AMOUNTS, count=F.col("size").cast("string"), account=F.col("account_id"), hours=hours,
        unit=text.money_text(unit), total=text.money_text(F.col("total")))
    return _cluster_findings(ctx, members, s, "ROUND_AMOUNT", explain)


@rule("RAPID_MOVEMENT", "LAYERING", ACCOUNT_WINDOW)
def rapid_movement(ctx: RuleContext, s: RuleSetting) -> Findings:
    """Deposits of which most leaves the same account within a window."""
    return rapid_findings(ctx, flows.outflow_after_deposits(ctx.ledger, is_deposit(s), is_debit(), s.params["windowHours"], ctx.hot_limit), s)


def rapid_findings(ctx: RuleContext, deposits: DataFrame, s: RuleSetting) -> Findings:
    """Findings of deposits with the count and sum of what left after them."""
    hours, needed = s.params["windowHours"], s.number("outflowRatio")
    needed_col = F.lit(needed).cast("decimal(9,6)")
    found = ctx.kept(deposits.withColumn(
        "ratio", money.divide_half_up(F.col("outflow_total"), F.col("deposit_amount"), 6)).where(F.col("ratio") >= needed_col))
    t = F.col("txn_timestamp")
    hits = hit_rows(
        found, s.code, "LAYERING",
        dedup_key=text.anchor_key(s.code, F.col("account_id"), F.col("transaction_id")),
        explanation=wording.fill(
            wording.RAPID_MOVEMENT, share=text.percent_text(F.col("ratio")), amount=text.money_text(F.col("deposit_amount")),
            txn=F.col("transaction_id"), time=text.timestamp_text(t), account=F.col("account_id"), hours=hours,
            count=F.col("outflow_count").cast("string"), total=text.money_text(F.col("outflow_total"))),
        evidence_amount_base=F.col("outflow_total"), evidence_count=F.col("outflow_count") + 1,
        magnitude_ratio=money.divide_half_up(F.col("ratio"), needed_col, 4, scale=6),
        first_ts=t, last_ts=t + clusters._hours(hours), anchor_txn_id=F.col("transaction_id"))
    return Findings(hits, _single_evidence(hits, s.code))


# Rules whose evidence is an anchor and a time window. Only the anchor is logged: one
# debit may count for any number of deposits, so the full lists could grow with the
# square of an account's rows.
RANGED = ["RAPID_MOVEMENT"]


def expand_evidence(evidence: DataFrame, hits: DataFrame, ledger: DataFrame, settings: dict[str, RuleSetting]) -> DataFrame:
    """Evidence with the debits behind each rapid-movement hit written out.

    Pass the hits to be shown or reported; the counts and sums of all others are
    on the hits already."""
    code = RANGED[0]
    wanted = hits.where(F.col("rule_code") == code).select("dedup_key", "account_id", "first_ts").distinct()
    debits = flows.outflows_of(wanted, ledger, F.col("direction") == "DEBIT", settings[code].params["windowHours"])
    return evidence.select(*[part.split(" ", 1)[0] for part in EVIDENCE_DDL.split(", ")]).unionByName(
        evidence_rows(debits, code, position=F.lit(1)))


def daily_volume(ledger: DataFrame) -> DataFrame:
    """Value and count per customer and calendar day."""
    return ledger.groupBy("customer_id", F.to_date("txn_timestamp").alias("day")).agg(
        F.sum("amount_base").alias("total_base"), F.count(F.lit(1)).alias("txn_count"))


@rule("BEHAVIORAL_DEVIATION", "BEHAVIOURAL_ANOMALY", CUSTOMER_WINDOW)
def deviation(ctx: RuleContext, s: RuleSetting) -> Findings:
    """Customer days far above the customer's own average over the days before."""
    days, least = s.params["baselineDays"], s.params["minBaselineTxns"]
    multiplier = F.lit(s.number("multiplier")).cast("decimal(9,4)")
    # One row per customer and day: a customer window holds at most the calendar.
    per_day = ctx.ledger.groupBy("customer_id", F.to_date("txn_timestamp").alias("day")).agg(
        F.sum("amount_base").alias("total_base"), F.count(F.lit(1)).alias("txn_count"),
        F.min("txn_timestamp").alias("first_ts"), F.max("txn_timestamp").alias("last_ts"))
    before = (Window.partitionBy("customer_id").orderBy(F.unix_date("day")).rangeBetween(-days, -1))
    scored = per_day.select(
        "*", F.sum("total_base").over(before).alias("base_total"), F.sum("txn_count").over(before).alias("base_count"))
    scored = scored.where((F.col("total_base") >= s.money("minDailyBase")) & (F.coalesce("base_count", F.lit(0)) >= least))
    average = money.divide_half_up(F.coalesce("base_total", F.lit(0)), F.lit(max(1, days)).cast("decimal(18,2)"), 2)
    scored = scored.withColumn("average", average).where("average <> 0").withColumn(
        "multiple", money.divide_half_up(F.col("total_base"), F.nullif("average", F.lit(0)), 4)
    ).where(F.col("multiple") > multiplier)

    # Accounts and evidence come from the batch's own rows on that day, in account then time order.
    touched = ctx.current.groupBy("customer_id", F.to_date("txn_timestamp").alias("day")).agg(
        F.min(F.struct("account_id", "txn_timestamp", "transaction_id")).alias("first"),
        F.count(F.lit(1)).alias("cited"))
    found = ctx.kept(scored.join(touched, ["customer_id", "day"]))
    key = text.customer_day_key(s.code, F.col("customer_id"), F.col("day"))
    hits = hit_rows(
        found, s.code, "BEHAVIOURAL_ANOMALY",
        account_id=F.col("first.account_id"), dedup_key=key,
        explanation=wording.fill(
            wording.DEVIATION, customer=F.col("customer_id"), total=text.money_text(F.col("total_base")),
            count=F.col("txn_count").cast("string"), day=F.col("day").cast("string"), multiple=text.multiplier_text(F.col("multiple")),
            days=days, average=text.money_text(F.col("average"))),
        evidence_amount_base=F.col("total_base"), evidence_count=F.col("cited"),
        magnitude_ratio=money.divide_half_up(F.col("multiple"), multiplier, 4, scale=4),
        anchor_txn_id=F.col("first.transaction_id"))
    cited = ctx.current.withColumn("day", F.to_date("txn_timestamp")).join(
        found.select("customer_id", "day"), ["customer_id", "day"])
    evidence = evidence_rows(cited, s.code, dedup_key=key)
    return Findings(hits, evidence)


def detect(ctx: RuleContext, settings: dict[str, RuleSetting]) -> Findings:
    """All active rules in one lazy plan. See `plans.detection` for the job that
    writes each rule's findings by itself, so that one failing rule stops no other."""
    active = active_rules(settings)
    if any(r.scope == ACCOUNT_WINDOW for r in active):
        ctx = ctx.counted()
    found = [r.find(ctx, settings[r.code]) for r in active]
    if not found:
        empty = ctx.ledger.sparkSession.range(0)
        none = {f.split(" ", 1)[0]: F.lit(None) for f in (HIT_DDL + ", " + EVIDENCE_DDL).split(", ")}
        empty = empty.withColumns(none)
        return Findings(_shape(empty, HIT_DDL), _shape(empty, EVIDENCE_DDL))
    return Findings(reduce(DataFrame.unionByName, [f.hits for f in found]),
                    reduce(DataFrame.unionByName, [f.evidence for f in found]))
