"""The given test tables read as banking data.

`events` becomes the ledger, `customer` the customers and their accounts. The
expressions mean the same in Spark and in the check SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound import refs
from tallyhound.functions import money, text
from tallyhound.schemas import LEDGER_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_transactions(events: DataFrame) -> DataFrame:
    """Events as typed transactions, before currency conversion."""
    e = F.col("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    amount = (
        F.when(e % 20 == 0, F.col("value").cast("decimal(18,2)"))
        .when(e % 50 == 7, (F.lit(10000) * (e % 9 + 1)).cast("decimal(18,2)"))
        .otherwise((F.col("value") * 100).cast("decimal(18,2)")))
    return events.select(
        F.concat(F.lit("TXN_"), e.cast("string")).alias("transaction_id"),
        F.concat(F.lit("ACC_"), F.col("user_id").cast("string")).alias("account_id"),
        F.concat(F.lit("CUST_"), F.col("user_id").cast("string")).alias("customer_id"),
        F.col("ts").alias("txn_timestamp"),
        F.when(F.col("event_type").isin("signup", "purchase"), "CREDIT").otherwise("DEBIT").alias("direction"),
        amount.alias("amount"),
        F.when(e % 20 == 0, "USD").when(e % 20 == 1, "JPY").otherwise("INR").alias("currency"),
        F.when(k % 2 == 0, "ONLINE").otherwise("BRANCH").alias("channel"),
        F.upper("event_type").alias("txn_type"),
        F.when(k == 0, "Kestrel Logistics OOO").when(k == 20, "Zenith Holdings F.Z.E.")
        .when(k == 21, "DELTA BRIDGE  exchange").otherwise("Bigbasket").alias("counterparty_name"),
        F.lit(None).cast("string").alias("counterparty_account"),
        F.lit(None).cast("string").alias("counterparty_bank"),
        F.when(k == 0, "IR").when(k == 1, "RU").when(k == 2, "PA").when(k == 3, "ae").when(k == 4, " KY")
        .when(k == 5, F.lit(None).cast("string")).otherwise("IN").alias("counterparty_country"),
        F.lit(None).cast("string").alias("description"),
        F.lit("POSTED").alias("status"))


def typed_ledger(rows: DataFrame) -> DataFrame:
    """Typed transactions with amounts in the base currency."""
    rates = refs.active_fx(refs.fx_rates(rows.sparkSession))
    return (
        rows.join(F.broadcast(rates), F.col("currency") == F.col("fx_currency"), "left")
        .withColumn("amount_base", money.to_base(F.col("amount"), F.col("fx_rate")))
        .withColumn("fx_rate_applied", F.col("fx_rate"))
        .select(*LEDGER_COLUMNS))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an already accepted ledger."""
    return typed_ledger(event_transactions(table(spark, sf_dir, "events")))


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger: day-grained times with real ties over several years."""
    orders = table(spark, sf_dir, "orders")
    owner = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cust = F.col("o_custkey").cast("string")
    none = F.lit(None).cast("string")
    return orders.join(owner, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("TXN_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("transaction_id"),
        F.concat(F.lit("ACC_"), cust).alias("account_id"), F.concat(F.lit("CUST_"), cust).alias("customer_id"),
        F.col("o_orderdate").alias("txn_timestamp"),
        F.when(F.col("o_orderstatus") == "F", "CREDIT").otherwise("DEBIT").alias("direction"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit("INR").alias("currency"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount_base"),
        F.lit(1).cast("decimal(18,8)").alias("fx_rate_applied"), F.col("o_orderpriority").alias("channel"),
        F.lit("ORDER").alias("txn_type"), none.alias("counterparty_name"), none.alias("counterparty_account"),
        none.alias("counterparty_bank"),
        F.when(F.col("c_nationkey") == 3, "KP").when(F.col("c_nationkey") == 4, "NG").otherwise("IN").alias("counterparty_country"),
        none.alias("description"), F.lit("POSTED").alias("status"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    key = F.col("c_custkey")
    m = key % 100
    cid = F.concat(F.lit("CUST_"), key.cast("string"))
    return c.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        cid.alias("customer_id"),
        F.substring_index("c_name", "#", 1).alias("first_name"),
        F.concat(F.lit("No"), F.substring_index("c_name", "#", -1)).alias("last_name"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        F.date_add(F.lit("1950-01-01").cast("date"), (key % 18000).cast("int")).alias("date_of_birth"),
        F.concat(F.lit("user"), key.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com")).alias("email"),
        F.concat(F.lit("+91-"), F.lpad(key.cast("string"), 10, "7")).alias("phone_number"),
        text.stand_in_national_id(cid).alias("national_id"),
        F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.lit("IN").alias("country"),
        F.lpad((key % 999999).cast("string"), 6, "0").alias("postal_code"),
        F.when(key % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Trader "), F.col("c_mktsegment"))).alias("occupation"),
        (F.col("c_acctbal") * 100).cast("decimal(18,2)").alias("annual_income"),
        F.lit(None).cast("string").alias("marital_status"), F.lit(None).cast("string").alias("education_level"),
        F.lit("EMPLOYED").alias("employment_status"),
        F.when(key % 7 == 0, F.lit(None).cast("date")).otherwise(
            F.date_add(F.lit("2010-01-01").cast("date"), (key % 4000).cast("int"))).alias("customer_since"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.when(key % 10 == 0, "PENDING").otherwise("VERIFIED").alias("kyc_status"),
        F.when(m < 65, "LOW").when(m < 92, "MEDIUM").otherwise("HIGH").alias("risk_rating"),
        (key % 33 == 0).alias("is_politically_exposed"),
        F.lit("EMAIL").alias("preferred_channel"), F.lit(True).alias("email_verified"), (key % 3 == 0).alias("phone_verified"),
        (key % 4).cast("int").alias("num_complaints_last_year"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts per customer: the one the events use, and a reserve account."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    return c.select("c_custkey", "c_acctbal", F.explode(F.array(F.lit("ACC_"), F.lit("RES_"))).alias("kind")).select(
        F.concat(F.col("kind"), key).alias("account_id"), F.concat(F.lit("CUST_"), key).alias("customer_id"),
        F.when(F.col("kind") == "ACC_", "CURRENT").otherwise("SAVINGS").alias("account_type"),
        F.lit("ACTIVE").alias("account_status"), F.lit("INR").alias("currency"),
        F.date_add(F.lit("2012-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).alias("open_date"),
        F.concat(F.lit("BR"), F.lpad((F.col("c_custkey") % 100).cast("string"), 3, "0")).alias("branch_code"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("City "), (F.col("c_custkey") % 12).cast("string"))).alias("branch_city"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("current_balance"))


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string transactions with one fault in some rows, for the validation chain."""
    rows = event_transactions(table(spark, sf_dir, "events"))
    e = F.substring("transaction_id", 5, 20).cast("long")
    f = e % 97
    blank = F.lit("  ")
    as_text = rows.select("*", e.alias("e"), f.alias("f"))
    e, f = F.col("e"), F.col("f")
    return as_text.select(
        (e + 1).alias("row_number"),
        F.when(f == 0, blank).when((f == 12) & (e >= 13), F.concat(F.lit("TXN_"), (e - 13).cast("string")))
        .when((f == 13) & (e >= 2), F.concat(F.lit("TXN_"), (e - 2).cast("string")))
        .otherwise(F.col("transaction_id")).alias("transaction_id"),
        F.when(f == 1, blank).when(f == 8, F.concat(F.lit("NOPE_"), e.cast("string"))).otherwise(F.col("account_id")).alias("account_id"),
        F.when(f == 9, F.lit("CUST_X")).when(e % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(f == 2, F.lit("yesterday")).when(f == 11, F.lit("2999-01-01 00:00:00"))
        .when(e % 4 == 0, F.date_format("txn_timestamp", "dd/MM/yyyy HH:mm:ss"))
        .when(e % 4 == 1, F.date_format("txn_timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(e % 4 == 2, F.date_format("txn_timestamp", "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format("txn_timestamp", "yyyy-MM-dd HH:mm:ss")).alias("txn_timestamp"),
        F.when(f == 3, F.lit("SIDEWAYS")).when((e % 2 == 0) & (F.col("direction") == "CREDIT"), F.lit(" deposit"))
        .when((e % 2 == 0), F.lit("dr")).otherwise(F.col("direction")).alias("direction"),
        F.when(f == 4, F.lit("abc")).when(f == 5, F.lit("-1")).otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(f == 6, F.lit("RUPEE")).when(f == 10, F.lit("XXX")).otherwise(F.lower("currency")).alias("currency"),
        "channel", "txn_type", "counterparty_name", "counterparty_account", "counterparty_bank",
        F.when(f == 7, F.lit("IND")).otherwise(F.col("counterparty_country")).alias("counterparty_country"),
        "description", F.when(e % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("status")).alias("status"),
        F.concat_ws(",", "transaction_id", "account_id", F.col("amount").cast("string")).alias("raw_line"))


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to move one alert per user through its states."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("ALT_"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("ts").alias("occurred_at"), F.col("event_id").alias("event_seq"),
        F.when(kind == "click", "IN_REVIEW").when(kind == "view", "OPEN").when(kind == "error", "ESCALATED")
        .otherwise("CLOSED").alias("target"),
        F.when(kind == "purchase", F.when(F.col("event_id") % 4 == 0, "ESCALATED_TO_SAR").otherwise("FALSE_POSITIVE")).alias("disposition"),
        F.when(kind == "purchase", F.when(F.col("event_id") % 7 == 0, " ").otherwise("reviewed")).alias("reason"),
        F.concat(F.lit("analyst"), (F.col("event_id") % 5).cast("string")).alias("actor"),
        (F.col("event_id") % 3 == 0).alias("is_senior"))


def settings_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rules to install, and a change of every kind of setting per event; some rules are unknown, some values unusable."""
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").withColumns({
        "seq": e, "changed_at": F.col("ts").cast("timestamp_ntz"), "actor": F.concat(F.lit("admin"), (e % 5).cast("string"))})
    numbered = lambda prefix, n: F.concat(F.lit(prefix), (e % n).cast("string"))
    severity = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (e % 3 + 1).cast("int"))
    fine = F.col("event_type") != "error"
    rules = events.where(e % 10 != 7).select(numbered("RULE_", 50).alias("rule_code")).distinct().select(
        "rule_code", F.lit("CUSTOM").alias("typology"), F.lit(True).alias("enabled"), F.lit(20).alias("weight"), F.lit("MEDIUM").alias("severity"), F.lit("{}").alias("params"))
    return rules, {
        "rules": events.select(
            numbered("RULE_", 50).alias("rule_code"), F.lit("CUSTOM").alias("typology"), fine.alias("enabled"), (e % 104 - 2).alias("weight"), severity.alias("severity"),
            F.concat(F.lit('{"minCount":'), (e % 7).cast("string"), F.lit("}")).alias("params"), "seq", "changed_at", "actor"),
        "jurisdictions": events.select(
            numbered("K", 200).alias("country_code"), severity.alias("category"), (e % 41).alias("risk_weight"), fine.alias("active"), "seq", "changed_at", "actor"),
        "watchlist": events.select(
            numbered("Party ", 90).alias("name"), severity.alias("list_type"), F.lit("XX").alias("country"), (e % 13 != 0).alias("active"), "seq", "changed_at", "actor"),
        "fx": events.select(numbered("C", 30).alias("currency"), (e % 7).alias("rate_to_base"), "seq", "changed_at", "actor")}
