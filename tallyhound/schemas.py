"""Explicit schemas and value domains. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(18, 8)
TOTAL = T.DecimalType(28, 2)
RATIO = T.DecimalType(18, 4)



RAW_TRANSACTION_COLUMNS = [
    "transaction_id", "account_id", "customer_id", "txn_timestamp", "direction", "amount",
    "currency", "channel", "txn_type", "counterparty_name", "counterparty_account",
    "counterparty_bank", "counterparty_country", "description", "status",
]

CUSTOMER_COLUMNS = [
    "customer_id", "first_name", "last_name", "gender", "date_of_birth", "email", "phone_number",
    "national_id", "city", "state", "country", "postal_code", "occupation", "annual_income",
    "marital_status", "education_level", "employment_status", "customer_since", "customer_segment",
    "kyc_status", "risk_rating", "is_politically_exposed", "preferred_channel", "email_verified",
    "phone_verified", "num_complaints_last_year",
]

ACCOUNT_COLUMNS = [
    "account_id", "customer_id", "account_type", "account_status", "currency", "open_date",
    "close_date", "branch_code", "branch_city", "current_balance", "avg_monthly_balance_6m",
    "credit_limit", "credit_utilization_pct", "overdraft_enabled", "card_type", "is_joint_account",
    "num_linked_devices", "mobile_banking_enrolled", "last_login_date", "avg_monthly_txn_count",
    "account_tier", "risk_rating",
]

LEDGER_DDL = (
    "transaction_id string, account_id string, customer_id string, txn_timestamp timestamp_ntz, "
    "direction string, amount decimal(18,2), currency string, amount_base decimal(18,2), "
    "fx_rate_applied decimal(18,8), channel string, txn_type string, counterparty_name string, "
    "counterparty_account string, counterparty_bank string, counterparty_country string, "
    "description string, status string"
)
LEDGER_COLUMNS = [f.split()[0] for f in LEDGER_DDL.replace("(18,2)", "").replace("(18,8)", "").split(", ")]

HIT_DDL = (
    "rule_code string, typology string, customer_id string, account_id string, dedup_key string, "
    "explanation string, evidence_amount_base decimal(28,2), evidence_count bigint, "
    "jurisdiction_uplift int, magnitude_ratio decimal(18,4), first_ts timestamp_ntz, "
    "last_ts timestamp_ntz, anchor_txn_id string"
)
EVIDENCE_DDL = (
    "rule_code string, dedup_key string, position int, txn_timestamp timestamp_ntz, transaction_id string"
)

# The state and outcome vocabularies.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_STATUSES = ["OPEN", "IN_REVIEW", "ESCALATED", "CLOSED"]
CASE_STATUSES = ["NEW", "INVESTIGATING", "PENDING_APPROVAL", "CLOSED"]
DISPOSITIONS = ["TRUE_POSITIVE", "FALSE_POSITIVE", "ESCALATED_TO_SAR", "CLEARED_NO_ACTION"]
SENIOR_DISPOSITIONS = ["ESCALATED_TO_SAR"]
ALERT_MOVES = {
    "OPEN": ["IN_REVIEW", "ESCALATED", "CLOSED"],
    "IN_REVIEW": ["ESCALATED", "CLOSED", "OPEN"],
    "ESCALATED": ["CLOSED", "IN_REVIEW"],
    "CLOSED": [],
}
CASE_MOVES = {
    "NEW": ["INVESTIGATING", "CLOSED"],
    "INVESTIGATING": ["PENDING_APPROVAL", "CLOSED"],
    "PENDING_APPROVAL": ["CLOSED", "INVESTIGATING"],
    "CLOSED": [],
}
