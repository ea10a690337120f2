import copy
from datetime import datetime, timedelta
from decimal import Decimal

from tallyhound import refs
from tallyhound.functions.params import load_settings
from tallyhound.operators import rules
from tallyhound.schemas import LEDGER_COLUMNS, LEDGER_DDL

BASE = datetime(2025, 3, 11, 7, 30)


def txn(tid, amount, hours=0.0, direction="CREDIT", account="ACC_K7", customer="CUST_K7", country="IN", party="Someone", at=None):
    value = Decimal(str(amount))
    row = dict.fromkeys(LEDGER_COLUMNS)
    row.update(transaction_id=tid, account_id=account, customer_id=customer, txn_timestamp=at or BASE + timedelta(hours=hours), direction=direction,
               amount=value, currency="INR", amount_base=value, fx_rate_applied=Decimal("1"), counterparty_name=party,
               counterparty_country=country, status="POSTED")
    return row


def ledger(spark, rows):
    return spark.createDataFrame([[r[c] for c in LEDGER_COLUMNS] for r in rows], LEDGER_DDL)


_loaded = {}


def settings(spark, **overrides):
    if not _loaded:
        _loaded.update(load_settings(refs.rule_config(spark)))
    out = copy.deepcopy(_loaded)
    for code, params in overrides.items():
        out[code].params.update(params)
    return out


def find(spark, code, rows, fresh=None, hot_limit=None, **params):
    s = settings(spark, **{code: params})
    ctx = rules.RuleContext(ledger(spark, rows), fresh=None if fresh is None else ledger(spark, fresh), hot_limit=hot_limit)
    return rules.registered(code).find(ctx, s[code])


def hits(spark, code, rows, **kw):
    return find(spark, code, rows, **kw).hits.orderBy("first_ts", "dedup_key").collect()
