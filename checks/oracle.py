"""The same answers in plain SQL over the given tables, written independently."""

from __future__ import annotations

import re

from checks import scenario as sc
from tallyhound import refs

ORACLE: dict[str, str] = {}


def _values(rows) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def dbl(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def money_text(c: str) -> str:
    return f"('INR ' || format('{{:,.2f}}', CAST({c} AS DOUBLE)))"


def whole(c: str, scale: int) -> str:
    return f"CAST(CAST({c} AS DECIMAL(28,{scale})) * {10 ** scale} AS HUGEINT)"


def div(a: str, b: str, places: int, scale: int = 2) -> str:
    """a / b rounded half up, as a decimal number of `places` places."""
    x, y = whole(a, scale), whole(b, scale)
    return f"CAST(CAST((2 * {x} * {10 ** places} + {y}) // (2 * {y}) AS DECIMAL(24,0)) * CAST({10 ** -places:.{places}f} AS DECIMAL(9,{places})) AS DECIMAL(28,{places}))"


def stamp_text(c: str) -> str:
    return f"strftime({c}, '%d %b %Y %H:%M')"


def one_place(c: str) -> str:
    """Decimal to one place, half up, as text."""
    return f"CAST(CAST({c} AS DECIMAL(28,1)) AS VARCHAR)"


def ref(prefix: str, at: str, key: str) -> str:
    return f"('{prefix}-' || strftime({at}, '%Y%m%d') || '-' || upper(left(sha256({key}), 24)))"


def national_id(c: str) -> str:
    return f"'IDN' || lpad(CAST(CAST('0x' || left(sha256({c}), 12) AS BIGINT) % 100000000 AS VARCHAR), 8, '0')"


FX = f"fx(currency, rate) AS (SELECT c, CAST(r AS DECIMAL(18,8)) FROM (VALUES {_values(refs.FX_RATES)}) v(c, r))"

TXN = """txn AS (
  SELECT event_id AS e, user_id, 'TXN_' || event_id AS transaction_id, 'ACC_' || user_id AS account_id, 'CUST_' || user_id AS customer_id,
    ts AS txn_timestamp, CASE WHEN event_type IN ('signup', 'purchase') THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
    CASE WHEN event_id % 20 = 0 THEN CAST(value AS DECIMAL(18,2)) WHEN event_id % 50 = 7 THEN CAST(10000 * (event_id % 9 + 1) AS DECIMAL(18,2))
         ELSE CAST(value * 100 AS DECIMAL(18,2)) END AS amount,
    CASE WHEN event_id % 20 = 0 THEN 'USD' WHEN event_id % 20 = 1 THEN 'JPY' ELSE 'INR' END AS currency,
    CASE WHEN k % 2 = 0 THEN 'ONLINE' ELSE 'BRANCH' END AS channel, upper(event_type) AS txn_type,
    CASE k WHEN 0 THEN 'Kestrel Logistics OOO' WHEN 20 THEN 'Zenith Holdings F.Z.E.' WHEN 21 THEN 'DELTA BRIDGE  exchange' ELSE 'Bigbasket' END AS counterparty_name,
    CASE k WHEN 0 THEN 'IR' WHEN 1 THEN 'RU' WHEN 2 THEN 'PA' WHEN 3 THEN 'ae' WHEN 4 THEN ' KY' WHEN 5 THEN NULL ELSE 'IN' END AS counterparty_country
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""

LEDGER = f"""{FX}, {TXN},
ledger AS (SELECT t.*, CAST(t.amount * fx.rate AS DECIMAL(18,2)) AS amount_base, fx.rate AS fx_rate_applied
  FROM txn t LEFT JOIN fx ON t.currency = fx.currency)"""

CUSTOMERS = f"""customers AS (
  SELECT c_custkey AS n, 'CUST_' || c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name, 'No' || split_part(c_name, '#', 2) AS last_name,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, DATE '1950-01-01' + CAST(c_custkey % 18000 AS INT) AS date_of_birth,
    'user' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' AS email, '+91-' || lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS phone_number,
    {national_id("('CUST_' || c_custkey)")} AS national_id, n_name AS city, r_name AS state, 'IN' AS country,
    lpad(CAST(c_custkey % 999999 AS VARCHAR), 6, '0') AS postal_code,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Trader ' || c_mktsegment END AS occupation, CAST(c_acctbal * 100 AS DECIMAL(18,2)) AS annual_income,
    'EMPLOYED' AS employment_status,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE DATE '2010-01-01' + CAST(c_custkey % 4000 AS INT) END AS customer_since,
    c_mktsegment AS customer_segment, CASE WHEN c_custkey % 10 = 0 THEN 'PENDING' ELSE 'VERIFIED' END AS kyc_status,
    CASE WHEN c_custkey % 100 < 65 THEN 'LOW' WHEN c_custkey % 100 < 92 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_rating,
    c_custkey % 33 = 0 AS is_politically_exposed, c_custkey % 4 AS num_complaints_last_year
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

ACCOUNTS = """accounts AS (
  SELECT c_custkey AS n, kind || c_custkey AS account_id, 'CUST_' || c_custkey AS customer_id,
    CASE WHEN kind = 'ACC_' THEN 'CURRENT' ELSE 'SAVINGS' END AS account_type, 'ACTIVE' AS account_status, 'INR' AS currency,
    DATE '2012-01-01' + CAST(c_custkey % 3000 AS INT) AS open_date, 'BR' || lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') AS branch_code,
    CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'City ' || (c_custkey % 12) END AS branch_city, CAST(c_acctbal AS DECIMAL(18,2)) AS current_balance
  FROM customer, (VALUES ('ACC_'), ('RES_')) k(kind))"""

JUR = f"jur(code, place, category, w, source) AS (VALUES {_values(refs.JURISDICTIONS)})"
WATCH = f"watch(name, kind, country, notes) AS (VALUES {_values(refs.WATCHLIST)})"


def _mask_word(w: str) -> str:
    return f"(left({w}, 1) || repeat('*', greatest(length({w}) - 1, 0)))"


def mask_name(c: str) -> str:
    return f"array_to_string(list_transform(regexp_split_to_array(trim({c}), '\\s+'), lambda w: {_mask_word('w')}), ' ')"


def mask_id(c: str) -> str:
    return f"(CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) ELSE repeat('*', length({c}) - 4) || right({c}, 4) END)"


# --- scalar functions ------------------------------------------------------

ORACLE["fn_text_parsing"] = """
WITH raw AS (SELECT event_id,
    CASE event_id % 6 WHEN 0 THEN ' y ' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN '' END AS flag,
    CASE event_id % 5 WHEN 0 THEN 'x1' WHEN 1 THEN ' ' ELSE ' ' || CAST(value AS VARCHAR) || ' ' END AS number,
    CASE event_id % 4 WHEN 0 THEN lower(event_type) WHEN 1 THEN ' cr' WHEN 2 THEN 'Withdrawal' ELSE 'IN ' END AS way,
    CASE event_id % 7 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS rating,
    event_type || ' - ' || event_id || ' (A.B)' AS party, event_type FROM events)
SELECT event_id, coalesce(nullif(trim(flag), ''), 'none') AS text_or, coalesce(upper(trim(flag)) IN ('Y', 'YES', 'TRUE', '1'), false) AS flag,
  CAST(trunc(TRY_CAST(trim(number) AS DOUBLE)) AS BIGINT) AS whole, CAST(TRY_CAST(trim(number) AS DECIMAL(18,2)) AS DOUBLE) AS amount,
  CASE WHEN upper(trim(way)) IN ('CREDIT', 'CR', 'C', 'DEPOSIT', 'IN') THEN 'CREDIT'
       WHEN upper(trim(way)) IN ('DEBIT', 'DR', 'D', 'WITHDRAWAL', 'OUT') THEN 'DEBIT' END AS direction, rating,
  CASE rating WHEN 'MEDIUM' THEN 7 WHEN 'HIGH' THEN 15 ELSE 0 END AS rating_uplift,
  upper(event_type) || event_id || 'AB' AS party, CASE WHEN length(party) > 12 THEN left(party, 9) || '...' ELSE party END AS clipped FROM raw"""

_LAYOUTS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S",
            "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%dT%H:%M:%S.%f", "%m/%d/%Y %H:%M:%S"]
_FORMATS = ["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S",
            "%m/%d/%Y %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y"]
ORACLE["fn_parse_times"] = f"""
WITH raw AS (SELECT event_id, CASE event_id % 12 {' '.join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in enumerate(_LAYOUTS))}
    ELSE strftime(ts, '%Y/%m/%d') END AS shown FROM events),
parsed AS (SELECT event_id, CASE WHEN event_id % 12 = 11 THEN NULL ELSE try_strptime(shown, {_FORMATS}) END AS t FROM raw)
SELECT event_id, {ts('t')} AS "at", CAST(CAST(t AS DATE) AS VARCHAR) AS day FROM parsed"""

ORACLE["fn_money"] = f"""WITH {LEDGER} SELECT transaction_id, {dbl('amount_base')} AS amount_base, {dbl('fx_rate_applied')} AS fx_rate_applied,
  {dbl('amount_base + 250.25')} AS plus, {dbl('amount_base - 250.25')} AS minus,
  {dbl('CAST(amount_base * CAST(1.5 AS DECIMAL(4,1)) AS DECIMAL(18,2))')} AS times,
  CASE WHEN amount = 0 THEN 0.0 ELSE {dbl(div('amount_base', 'amount', 6))} END AS ratio, amount_base >= 10000 AS large,
  amount_base BETWEEN 5000 AND 9999.99 AS in_band, amount_base % 10000 = 0 AS round, amount > 0 AS positive, currency FROM ledger"""

_SHARE = div("amount_base", "3333.00", 6)
ORACLE["fn_display"] = f"""WITH {LEDGER}, x AS (SELECT *, {_SHARE} AS share FROM ledger)
SELECT transaction_id, {money_text('amount_base')} AS money, {one_place('share * 100')} || '%' AS percent, {one_place('share')} || 'x' AS multiplier,
  {stamp_text('txn_timestamp')} AS at, strftime(txn_timestamp, '%d %b %Y') AS day FROM x"""

_EMAIL = f"""({_mask_word("split_part(email, '@', 1)")} || '@' || {_mask_word("regexp_extract(split_part(email, '@', 2), '^(.*)[.][^.]*$', 1)")} || '.com')"""
_PHONE = "('+91-' || repeat('*', 6) || right(phone_number, 4))"
ORACLE["fn_masking"] = f"""WITH {CUSTOMERS} SELECT customer_id, {mask_name("first_name || ' ' || last_name")} AS name, {mask_id('national_id')} AS national_id,
  '***' AS short_id, {_EMAIL} AS email, {mask_id('customer_id')} AS not_email, {_PHONE} AS phone, {mask_id('customer_id')} AS no_prefix FROM customers"""

ORACLE["fn_keys_and_refs"] = f"""WITH {TXN} SELECT transaction_id, 'R|TXN|' || transaction_id AS txn_key,
  'R|ACCT|' || account_id || '|' || CAST(CAST(txn_timestamp AS DATE) AS VARCHAR) AS account_key,
  'R|CUST|' || customer_id || '|' || CAST(CAST(txn_timestamp AS DATE) AS VARCHAR) AS customer_key,
  'R|ANCH|' || account_id || '|' || transaction_id AS anchor_key, {ref('ALT', 'txn_timestamp', 'transaction_id')} AS ref,
  {national_id('customer_id')} AS national_id, transaction_id || ',' || account_id AS ids,
  channel || coalesce(', ' || counterparty_country, '') AS joined FROM txn"""

_PARAMS = """raw AS (SELECT 'RULE_' || event_id AS rule_code, event_id AS e, event_id % 104 - 2 AS weight, event_id % 11 >= 2 AS ok,
  event_id % 5 AS mc, event_id % 4 * 12 AS wh, event_id % 50 * 100 AS lo, event_id % 30 * 200 + 1 AS hi FROM events)"""
ORACLE["fn_rule_params"] = f"""WITH {_PARAMS} SELECT rule_code, CASE WHEN ok THEN mc ELSE 3 END AS min_count, CASE WHEN ok THEN wh ELSE 24 END AS window_hours,
  CASE WHEN ok THEN CAST(hi AS DOUBLE) ELSE 9999.99 END AS upper_bound, CASE WHEN ok THEN e % 2 = 0 ELSE true END AS regardless, 'none' AS note FROM raw"""
ORACLE["val_rule_settings"] = f"""WITH {_PARAMS} SELECT rule_code, CASE WHEN weight < 0 OR weight > 100 THEN 'weight must be between 0 and 100'
  WHEN ok AND wh <= 0 THEN 'windowHours must be greater than zero' WHEN ok AND mc < 1 THEN 'minCount must be at least 1'
  WHEN ok AND lo >= hi THEN 'lowerBound must be less than upperBound' END AS problem FROM raw"""
ORACLE["fn_country_weight"] = f"""WITH {TXN}, {JUR} SELECT transaction_id, coalesce(w, 0) AS country_risk_weight
  FROM txn LEFT JOIN jur ON upper(trim(counterparty_country)) = code"""

# --- sources and ingest ----------------------------------------------------

_CUST_ROWS = f"""{CUSTOMERS}, rows AS (SELECT *, n + 1 AS row_number,
  CASE WHEN n % 50 = 9 THEN NULL WHEN n % 50 = 11 THEN 'CUST_' || (n - 1) ELSE customer_id END AS id FROM customers),
checked AS (SELECT *, CASE WHEN id IS NULL THEN 'customer_id is required'
  WHEN row_number() OVER (PARTITION BY id ORDER BY row_number) > 1 THEN 'duplicate customer_id in file' END AS problem FROM rows)"""
ORACLE["src_customers"] = f"""WITH {_CUST_ROWS} SELECT id AS customer_id, CASE WHEN n % 4 = 0 THEN 'Unknown' ELSE first_name END AS first_name,
  CAST(date_of_birth AS VARCHAR) AS date_of_birth, {national_id('id')} AS national_id, CASE WHEN n % 3 = 0 THEN 'IN' ELSE 'SG' END AS country,
  CASE WHEN n % 6 = 0 THEN NULL ELSE {dbl('annual_income')} END AS annual_income, CAST(customer_since AS VARCHAR) AS customer_since,
  'PENDING' AS kyc_status, risk_rating, is_politically_exposed, false AS email_verified,
  CASE WHEN n % 8 = 0 THEN 0 ELSE n % 4 END AS num_complaints_last_year, CAST(NULL AS VARCHAR) AS state FROM checked WHERE problem IS NULL"""
ORACLE["val_customers_file"] = f"""WITH {_CUST_ROWS} SELECT row_number, coalesce(id, '') AS record_key,
  CASE WHEN id IS NULL THEN 'STRUCTURAL' ELSE 'BUSINESS_RULE' END AS error_type, problem AS error_message FROM checked WHERE problem IS NOT NULL"""

_ACC_ROWS = f"""{ACCOUNTS}, rows AS (SELECT *, n * 2 + CASE WHEN account_id LIKE 'ACC%' THEN 1 ELSE 2 END AS row_number,
  CASE WHEN n % 40 = 3 THEN NULL WHEN n % 40 = 5 THEN 'ACC_' || (n - 1) ELSE account_id END AS id,
  CASE WHEN n % 30 = 4 THEN 'CUST_GONE' ELSE customer_id END AS owner FROM accounts),
checked AS (SELECT *, CASE WHEN id IS NULL THEN 'account_id is required'
  WHEN row_number() OVER (PARTITION BY id ORDER BY row_number) > 1 THEN 'duplicate account_id in file'
  WHEN owner = 'CUST_GONE' THEN 'customer_id ''CUST_GONE'' does not exist — load customers first' END AS problem FROM rows)"""
ORACLE["src_accounts"] = f"""WITH {_ACC_ROWS} SELECT id AS account_id, owner AS customer_id, CASE WHEN n % 2 = 0 THEN 'SAVINGS' ELSE account_type END AS account_type,
  'ACTIVE' AS account_status, 'usd' AS currency, CAST(open_date AS VARCHAR) AS open_date, branch_code,
  CASE WHEN n % 5 = 0 THEN 0.0 ELSE {dbl('current_balance')} END AS current_balance, CAST(12.35 AS DOUBLE) AS credit_utilization_pct, n % 3 = 0 AS overdraft_enabled,
  false AS is_joint_account, 'LOW' AS risk_rating FROM checked WHERE problem IS NULL"""
ORACLE["val_accounts_file"] = f"""WITH {_ACC_ROWS} SELECT row_number, id AS record_key,
  CASE WHEN id IS NULL THEN 'STRUCTURAL' WHEN problem LIKE 'dup%' THEN 'BUSINESS_RULE' ELSE 'REFERENTIAL_INTEGRITY' END AS error_type,
  problem AS error_message FROM checked WHERE problem IS NOT NULL"""

# The dirty feed: each fault class is known from the row number.
_DIRTY = f"""{LEDGER}, dirty AS (SELECT e + 1 AS row_number, e, f,
    CASE WHEN f = 0 THEN '  ' WHEN f = 12 AND e >= 13 THEN 'TXN_' || (e - 13) WHEN f = 13 AND e >= 2 THEN 'TXN_' || (e - 2) ELSE transaction_id END AS transaction_id,
    CASE WHEN f = 1 THEN '  ' WHEN f = 8 THEN 'NOPE_' || e ELSE account_id END AS account_id,
    CASE WHEN f = 9 THEN 'CUST_X' WHEN e % 3 = 0 THEN NULL ELSE customer_id END AS customer_id,
    CASE WHEN f = 2 THEN 'yesterday' WHEN f = 11 THEN '2999-01-01 00:00:00' WHEN e % 4 = 0 THEN strftime(txn_timestamp, '%d/%m/%Y %H:%M:%S')
      WHEN e % 4 = 1 THEN strftime(txn_timestamp, '%Y-%m-%dT%H:%M:%S') WHEN e % 4 = 2 THEN strftime(txn_timestamp, '%Y-%m-%d %H:%M')
      ELSE strftime(txn_timestamp, '%Y-%m-%d %H:%M:%S') END AS txn_timestamp,
    date_trunc(CASE WHEN e % 4 = 2 THEN 'minute' ELSE 'second' END, txn_timestamp) AS parsed_ts, direction,
    CASE WHEN f = 3 THEN 'SIDEWAYS' WHEN e % 2 = 0 AND direction = 'CREDIT' THEN ' deposit' WHEN e % 2 = 0 THEN 'dr' ELSE direction END AS way,
    CASE WHEN f = 4 THEN 'abc' WHEN f = 5 THEN '-1' ELSE CAST(amount AS VARCHAR) END AS amount_text, amount, amount_base, fx_rate_applied,
    CASE WHEN f = 6 THEN 'RUPEE' WHEN f = 10 THEN 'XXX' ELSE lower(currency) END AS currency, upper(currency) AS good_currency,
    channel, txn_type, counterparty_name, CASE WHEN f = 7 THEN 'IND' ELSE counterparty_country END AS counterparty_country, customer_id AS owner,
    CASE WHEN e % 5 = 0 THEN NULL ELSE 'POSTED' END AS status,
    transaction_id || ',' || account_id || ',' || CAST(amount AS VARCHAR) AS raw_line
  FROM (SELECT *, e % 97 AS f FROM ledger))"""


def _checked(pre: str = "", dup_source: str = "dirty") -> str:
    return f"""faulted AS (SELECT *, CASE {pre} WHEN trim(transaction_id) = '' THEN 'S:transactionId is required' WHEN trim(account_id) = '' THEN 'S:accountId is required'
    WHEN f = 2 THEN 'S:txnTimestamp ''yesterday'' is not a recognised date-time' WHEN way = 'SIDEWAYS' THEN 'S:unknown direction: SIDEWAYS'
    WHEN f = 4 AND amount_text = 'abc' THEN 'S:amount ''abc'' is not a valid number'
    WHEN f = 5 AND amount_text = '-1' THEN 'S:amount must be greater than zero (was -1)'
    WHEN length(trim(currency)) <> 3 THEN 'S:currency must be a 3-letter ISO-4217 code (was ''' || currency || ''')'
    WHEN length(trim(counterparty_country)) <> 2 THEN 'S:counterpartyCountry must be a 2-letter ISO code (was ''' || counterparty_country || ''')'
    WHEN f = 8 THEN 'R:accountId ''' || account_id || ''' does not exist'
    WHEN customer_id <> owner THEN 'R:customerId ''' || customer_id || ''' does not own account ''' || account_id || ''' (owner is ''' || owner || ''')'
    WHEN f = 10 THEN 'B:unknown currency ''XXX'' — no rate configured in fx_rates, so the amount cannot be normalised for threshold comparison'
    WHEN f = 11 THEN 'B:txnTimestamp ''2999-01-01 00:00:00'' is in the future' END AS fault FROM {dup_source}),
checked AS (SELECT *, CASE WHEN fault IS NOT NULL THEN fault WHEN row_number() OVER (PARTITION BY trim(transaction_id), fault IS NULL ORDER BY row_number) > 1
    THEN 'B:duplicate transactionId ''' || transaction_id || ''' within this batch' END AS problem FROM faulted)"""


_TYPE = "CASE left(problem, 1) WHEN 'S' THEN 'STRUCTURAL' WHEN 'R' THEN 'REFERENTIAL_INTEGRITY' ELSE 'BUSINESS_RULE' END"
_VAL = f"{_DIRTY}, {_checked()}"
ORACLE["val_rejects"] = f"""WITH {_VAL} SELECT row_number, transaction_id AS record_key, {_TYPE} AS error_type, substr(problem, 3) AS error_message,
  raw_line AS raw_record FROM checked WHERE problem IS NOT NULL"""
ORACLE["val_accepted"] = f"""WITH {_VAL} SELECT trim(transaction_id) AS transaction_id, account_id, owner AS customer_id, {ts('parsed_ts')} AS txn_timestamp, direction,
  {dbl('amount')} AS amount, good_currency AS currency, {dbl('amount_base')} AS amount_base, {dbl('fx_rate_applied')} AS fx_rate_applied, channel, txn_type,
  counterparty_name, upper(trim(counterparty_country)) AS counterparty_country, coalesce(status, 'POSTED') AS status FROM checked WHERE problem IS NULL"""


def batch_ref_sql(key: str) -> str:
    return f"'BATCH-20240201-000000-' || upper(left(sha256('{key}|2024-02-01T00:00:00'), 8))"


_JOB_REF = batch_ref_sql("TRANSACTION|stream-0")
_OPENED = "(SELECT count(*) FROM checked WHERE problem IS NULL AND amount_base >= 10000)"
ORACLE["val_batch_summary"] = f"""WITH {_VAL} SELECT {_JOB_REF} AS batch_ref, 'TRANSACTION' AS entity_type, 'stream-0' AS source, count(*) AS total_records,
  count(*) FILTER (problem IS NULL) AS accepted_records, count(*) FILTER (problem IS NOT NULL) AS rejected_records, {_OPENED} AS alerts_generated,
  'COMPLETED_WITH_ERRORS' AS status, {_OPENED} AS hits, '' AS failed_rules, true AS timed FROM checked"""
ORACLE["src_batch_report"] = f"""WITH {_VAL} SELECT {_JOB_REF} AS batch_ref, 'COMPLETED_WITH_ERRORS' AS status, count(*) OVER () AS rejected_records, row_number,
  transaction_id AS record_key, {_TYPE} AS error_type FROM checked WHERE problem IS NOT NULL"""
ORACLE["snk_customers"] = f"""WITH {_CUST_ROWS} SELECT id AS customer_id, CASE WHEN n % 4 = 0 THEN 'Unknown' ELSE first_name END AS first_name,
  CASE WHEN n % 3 = 0 THEN 'IN' ELSE 'SG' END AS country, CASE WHEN n % 6 = 0 THEN NULL ELSE {dbl('annual_income')} END AS annual_income,
  'PENDING' AS kyc_status, risk_rating FROM checked WHERE problem IS NULL"""
_MASTER_ROWS = f"""{CUSTOMERS}, {ACCOUNTS}, crows AS (SELECT *, n + 1 AS row_number,
  CASE WHEN n % 50 = 9 THEN NULL WHEN n % 50 = 11 THEN 'CUST_' || (n - 1) ELSE customer_id END AS id FROM customers),
cust AS (SELECT *, CASE WHEN id IS NULL THEN 'customer_id is required'
  WHEN row_number() OVER (PARTITION BY id ORDER BY row_number) > 1 THEN 'duplicate customer_id in file' END AS problem FROM crows),
arows AS (SELECT *, n * 2 + CASE WHEN account_id LIKE 'ACC%' THEN 1 ELSE 2 END AS row_number,
  CASE WHEN n % 40 = 3 THEN NULL WHEN n % 40 = 5 THEN 'ACC_' || (n - 1) ELSE account_id END AS id,
  CASE WHEN n % 30 = 4 THEN 'CUST_GONE' ELSE customer_id END AS owner FROM accounts),
acc AS (SELECT *, CASE WHEN id IS NULL THEN 'account_id is required'
  WHEN row_number() OVER (PARTITION BY id ORDER BY row_number) > 1 THEN 'duplicate account_id in file'
  WHEN owner NOT IN (SELECT id FROM cust WHERE problem IS NULL) THEN 'customer_id ''' || owner || ''' does not exist — load customers first' END AS problem FROM arows)"""
_CREF, _AREF = batch_ref_sql("CUSTOMER|customers-0"), batch_ref_sql("ACCOUNT|accounts-0")
ORACLE["snk_accounts"] = f"""WITH {_MASTER_ROWS} SELECT id AS account_id, owner AS customer_id, CASE WHEN n % 2 = 0 THEN 'SAVINGS' ELSE account_type END AS account_type,
  'usd' AS currency, CASE WHEN n % 5 = 0 THEN 0.0 ELSE {dbl('current_balance')} END AS current_balance FROM acc WHERE problem IS NULL"""
ORACLE["snk_master_rejects"] = f"""WITH {_MASTER_ROWS} SELECT {_CREF} AS batch_ref, row_number, coalesce(id, '') AS record_key,
  CASE WHEN id IS NULL THEN 'STRUCTURAL' ELSE 'BUSINESS_RULE' END AS error_type, problem AS error_message FROM cust WHERE problem IS NOT NULL
UNION ALL SELECT {_AREF}, row_number, id, CASE WHEN id IS NULL THEN 'STRUCTURAL' WHEN problem LIKE 'dup%' THEN 'BUSINESS_RULE' ELSE 'REFERENTIAL_INTEGRITY' END, problem
  FROM acc WHERE problem IS NOT NULL"""
ORACLE["snk_ingest_audit"] = f"""WITH {_VAL}, {_MASTER_ROWS}, done AS (
  SELECT {_JOB_REF} AS ref, count(*) FILTER (problem IS NULL) AS a, count(*) FILTER (problem IS NOT NULL) AS r, {_OPENED} AS n FROM checked
  UNION ALL SELECT {_CREF}, count(*) FILTER (problem IS NULL), count(*) FILTER (problem IS NOT NULL), 0 FROM cust
  UNION ALL SELECT {_AREF}, count(*) FILTER (problem IS NULL), count(*) FILTER (problem IS NOT NULL), 0 FROM acc)
SELECT 'INGESTION' AS entity_type, ref AS entity_id, 'INGESTION_COMPLETED' AS action, 'system' AS actor,
  a || ' accepted, ' || r || ' rejected, ' || n || ' alerts' AS details, '2024-02-01 00:00:00.000000' AS occurred_at FROM done"""
ORACLE["src_transactions"] = f"""WITH {_DIRTY} SELECT row_number, nullif(trim(transaction_id), '') AS transaction_id, nullif(trim(account_id), '') AS account_id,
  CAST(NULL AS VARCHAR) AS customer_id, txn_timestamp, amount_text AS amount, CASE WHEN e % 6 = 0 THEN 'INR' ELSE currency END AS currency,
  nullif(trim(counterparty_country), '') AS counterparty_country, CAST(NULL AS VARCHAR) AS status FROM dirty"""

_FILE = "nullif(trim({0}), '') AS {0}"
ORACLE["src_csv_files"] = f"""WITH {_DIRTY}, t AS (SELECT {_FILE.format('transaction_id')}, {_FILE.format('account_id')}, txn_timestamp, amount_text AS amount, currency,
  {_FILE.format('counterparty_country')} FROM dirty) SELECT *, count(*) AS rows, count(*) AS numbers FROM t GROUP BY ALL"""
for _name in ("src_json_files", "src_json_stream"):
    ORACLE[_name] = f"""WITH {_DIRTY} SELECT transaction_id, account_id, txn_timestamp, amount_text AS amount, currency, counterparty_country, 'POSTED' AS status FROM dirty"""

_JSON = f"""{_DIRTY}, asked AS (SELECT * REPLACE (
    CASE WHEN e % 61 = 1 THEN repeat('X', 41) ELSE transaction_id END AS transaction_id,
    CASE WHEN e % 61 = 2 THEN repeat('A', 33) ELSE account_id END AS account_id, CASE WHEN e % 61 = 3 THEN 'deposit' WHEN e % 2 = 0 THEN 'Credit' ELSE 'DEBIT' END AS way,
    CASE WHEN e % 61 = 4 THEN '0.001' ELSE amount_text END AS amount_text, CASE WHEN e % 61 = 5 THEN 'U$D' ELSE currency END AS currency,
    CASE WHEN e % 61 = 6 THEN 'I1' ELSE trim(counterparty_country) END AS counterparty_country) FROM dirty),
{_checked('''WHEN length(transaction_id) > 40 THEN 'S:size must be between 0 and 40' WHEN length(account_id) > 32 THEN 'S:size must be between 0 and 32'
    WHEN way = 'deposit' THEN 'S:direction must be CREDIT or DEBIT' WHEN amount_text IN ('0.001', '-1') OR (amount_text <> 'abc' AND TRY_CAST(amount_text AS DOUBLE) < 0.01)
    THEN 'S:amount must be greater than zero' WHEN NOT regexp_full_match(currency, '[A-Za-z]{3}') THEN 'S:currency must be a 3-letter ISO-4217 code'
    WHEN NOT regexp_full_match(counterparty_country, '([A-Za-z]{2})?') THEN 'S:counterpartyCountry must be a 2-letter ISO code' ''', 'asked')}"""
ORACLE["val_json_requests"] = f"""WITH {_JSON} SELECT row_number, transaction_id AS record_key, {_TYPE} AS error_type, substr(problem, 3) AS error_message
  FROM checked WHERE problem IS NOT NULL"""
ORACLE["src_json_accepted"] = f"""WITH {_JSON} SELECT trim(transaction_id) AS transaction_id, account_id, upper(way) AS direction, {dbl('amount_base')} AS amount_base,
  'POSTED' AS status FROM checked WHERE problem IS NULL"""

ORACLE["src_ledger_window"] = f"""WITH {LEDGER} SELECT account_id, transaction_id, {ts('txn_timestamp')} AS txn_timestamp, {dbl('amount_base')} AS amount_base FROM ledger
  WHERE txn_timestamp BETWEEN '2024-01-10' AND '2024-01-20' AND account_id IN (SELECT account_id FROM ledger WHERE amount_base >= 40000)"""
ORACLE["src_accounts_of_customers"] = f"""WITH {LEDGER}, {ACCOUNTS} SELECT customer_id, account_id, account_type, {dbl('current_balance')} AS current_balance
  FROM accounts WHERE customer_id IN (SELECT customer_id FROM ledger WHERE currency = 'USD')"""
ORACLE["snk_current_ledger"] = f"""WITH {LEDGER} SELECT transaction_id, account_id,
  {dbl('amount_base + CASE WHEN e % 100 = 0 THEN 2 WHEN e % 10 = 0 THEN 1 ELSE 0 END')} AS amount_base,
  CASE WHEN e % 10 = 0 THEN 'REVISED' ELSE 'POSTED' END AS status FROM ledger"""

ORACLE["snk_moved_rows"] = f"""WITH {LEDGER}, now AS (SELECT transaction_id,
  CASE WHEN e % 50 = 0 THEN account_id || '-B' ELSE account_id END AS account_id,
  CASE WHEN e % 10 = 0 AND e % 50 <> 0 THEN txn_timestamp + INTERVAL 3 DAY ELSE txn_timestamp END AS txn_timestamp,
  CASE WHEN e % 50 = 0 THEN 'BACK' WHEN e % 10 = 0 THEN 'MOVED' ELSE 'POSTED' END AS status FROM ledger)
SELECT * FROM now WHERE CAST(txn_timestamp AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"""

# --- detection -------------------------------------------------------------


def cluster_ctes(name: str, source: str, hours: int, least: int) -> str:
    """Greedy clusters by walking from each opener to the next one past its window."""
    return f"""{name}_c AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY txn_timestamp, transaction_id) AS rn FROM ({source})),
{name}_o AS (SELECT a.account_id, a.rn, a.txn_timestamp AS t, max(b.rn) AS hi FROM {name}_c a JOIN {name}_c b ON a.account_id = b.account_id
    AND b.rn >= a.rn AND b.txn_timestamp <= a.txn_timestamp + INTERVAL {hours} HOUR GROUP BY ALL HAVING count(*) >= {least}),
{name}_n AS (SELECT a.account_id, a.rn, a.hi, min(b.rn) AS nxt FROM {name}_o a LEFT JOIN {name}_o b ON a.account_id = b.account_id AND b.rn > a.hi GROUP BY ALL),
{name}_w AS (SELECT account_id, rn, hi, nxt FROM {name}_n WHERE (account_id, rn) IN (SELECT account_id, min(rn) FROM {name}_o GROUP BY 1)
  UNION ALL SELECT n.account_id, n.rn, n.hi, n.nxt FROM {name}_w w JOIN {name}_n n ON n.account_id = w.account_id AND n.rn = w.nxt),
{name}_m AS (SELECT c.*, w.rn AS first_rn FROM {name}_w w JOIN {name}_c c ON c.account_id = w.account_id AND c.rn BETWEEN w.rn AND w.hi),
{name}_s AS (SELECT account_id, first_rn, count(*) AS size, sum(amount_base) AS total, min(txn_timestamp) AS cluster_ts, max(txn_timestamp) AS last_ts,
    arg_min(transaction_id, rn) AS cluster_txn_id, arg_min(customer_id, rn) AS cluster_customer_id FROM {name}_m GROUP BY ALL)"""


_CLUSTER_OUT = f"SELECT account_id, {ts('cluster_ts')} AS cluster_ts, cluster_txn_id, size, {dbl('total')} AS total, {ts('last_ts')} AS last_ts FROM c_s"
ORACLE["det_clusters"] = f"""WITH RECURSIVE {cluster_ctes('c', '''SELECT CAST(user_id AS VARCHAR) AS account_id, CAST(user_id AS VARCHAR) AS customer_id,
  lpad(CAST(event_id AS VARCHAR), 12, '0') AS transaction_id, ts AS txn_timestamp, CAST(value AS DECIMAL(18,2)) AS amount_base FROM events
  WHERE value BETWEEN 50 AND 150''', 24, 3)} {_CLUSTER_OUT}"""
ORACLE["det_clusters_with_ties"] = f"""WITH RECURSIVE {cluster_ctes('c', '''SELECT 'ACC_' || o_custkey AS account_id, 'CUST_' || o_custkey AS customer_id,
  'TXN_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS transaction_id, o_orderdate AS txn_timestamp, CAST(o_totalprice AS DECIMAL(18,2)) AS amount_base
  FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) >= 100000''', 720, 2)} {_CLUSTER_OUT}"""

_HIT = """rule_code, typology, customer_id, account_id, dedup_key, explanation, CAST(evidence_amount_base AS DOUBLE) AS evidence_amount_base, evidence_count,
  jurisdiction_uplift, CAST(magnitude_ratio AS DOUBLE) AS magnitude_ratio, """ + f"{ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts, anchor_txn_id"

CTR = f"""h_ctr AS (SELECT 'CTR_THRESHOLD' AS rule_code, 'THRESHOLD_BREACH' AS typology, customer_id, account_id, 'CTR_THRESHOLD|TXN|' || transaction_id AS dedup_key,
  'Transaction ' || transaction_id || ' (' || {money_text('amount_base')} || ', ' || {stamp_text('txn_timestamp')} || ') on account ' || account_id ||
  ' met or exceeded the INR 10,000.00 reporting threshold and is automatically flagged for review.' AS explanation,
  amount_base AS evidence_amount_base, 1 AS evidence_count, 0 AS jurisdiction_uplift, {div('amount_base', '10000', 4)} AS magnitude_ratio,
  txn_timestamp AS first_ts, txn_timestamp AS last_ts, transaction_id AS anchor_txn_id FROM ledger WHERE amount_base >= 10000)"""
LISTED = f"""{JUR}, {WATCH}, h_jur AS (SELECT 'HIGH_RISK_JURISDICTION' AS rule_code, 'JURISDICTION_RISK' AS typology, customer_id, account_id,
  'HIGH_RISK_JURISDICTION|TXN|' || transaction_id AS dedup_key,
  'Transaction ' || transaction_id || ' (' || {money_text('amount_base')} || ', ' || {stamp_text('txn_timestamp')} || ') on account ' || account_id || ' ' ||
  CASE WHEN code IS NULL THEN '' ELSE 'involves ' || place || ', listed as ' || category || ' (source: ' || source || '). ' END ||
  CASE WHEN name IS NULL THEN '' ELSE 'Counterparty ''' || name || ''' appears on the ' || kind || ' watchlist — ' || notes || '. ' END ||
  'Business rule 4 requires an alert regardless of transaction value.' AS explanation, amount_base AS evidence_amount_base, 1 AS evidence_count,
  greatest(coalesce(w, 0), CASE kind WHEN 'SANCTIONS' THEN 40 WHEN 'SHELL_COMPANY' THEN 30 WHEN 'ADVERSE_MEDIA' THEN 20 ELSE 0 END) AS jurisdiction_uplift,
  CAST(1 AS DECIMAL(18,4)) AS magnitude_ratio, txn_timestamp AS first_ts, txn_timestamp AS last_ts, transaction_id AS anchor_txn_id
  FROM ledger LEFT JOIN jur ON upper(trim(counterparty_country)) = code
  LEFT JOIN watch ON upper(regexp_replace(counterparty_name, '[^A-Za-z0-9]', '', 'g')) = upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'))
  WHERE code IS NOT NULL OR name IS NOT NULL)"""
STRUCT = f"""{cluster_ctes('st', 'SELECT * FROM ledger WHERE amount_base BETWEEN 5000 AND 9999.99', 24, 3)},
h_st AS (SELECT 'STRUCTURING' AS rule_code, 'STRUCTURING' AS typology, cluster_customer_id AS customer_id, account_id,
  'STRUCTURING|ACCT|' || account_id || '|' || CAST(CAST(cluster_ts AS DATE) AS VARCHAR) AS dedup_key,
  size || ' transactions totalling ' || {money_text('total')} || ' were made on account ' || account_id || ' within 24 hours (' || {stamp_text('cluster_ts')} ||
  ' to ' || {stamp_text('last_ts')} || '). Each fell between INR 5,000.00 and INR 9,999.99 — individually below the reporting threshold, ' ||
  'consistent with deliberate structuring to avoid it.' AS explanation, total AS evidence_amount_base, size AS evidence_count, 0 AS jurisdiction_uplift,
  {div('size', '3', 4)} AS magnitude_ratio, cluster_ts AS first_ts, last_ts, cluster_txn_id AS anchor_txn_id FROM st_s)"""
ROUND = f"""{cluster_ctes('ro', 'SELECT * FROM ledger WHERE amount_base >= 50000 AND amount_base % 10000 = 0', 240, 2)},
h_ro AS (SELECT 'ROUND_AMOUNT_PATTERN' AS rule_code, 'ROUND_AMOUNT' AS typology, cluster_customer_id AS customer_id, account_id,
  'ROUND_AMOUNT_PATTERN|ACCT|' || account_id || '|' || CAST(CAST(cluster_ts AS DATE) AS VARCHAR) AS dedup_key,
  size || ' transactions on account ' || account_id || ' within 240 hours were exact multiples of INR 10,000.00, totalling ' || {money_text('total')} ||
  '. Repeated round-number amounts suggest values chosen rather than arising from genuine commercial activity.' AS explanation,
  total AS evidence_amount_base, size AS evidence_count, 0 AS jurisdiction_uplift, {div('size', '2', 4)} AS magnitude_ratio, cluster_ts AS first_ts, last_ts,
  cluster_txn_id AS anchor_txn_id FROM ro_s)"""
RAPID = f"""ra_p AS (SELECT d.account_id, d.customer_id, d.transaction_id, d.txn_timestamp, d.amount_base, o.transaction_id AS out_id, o.txn_timestamp AS out_ts,
    o.amount_base AS out_amount FROM ledger d JOIN ledger o ON o.account_id = d.account_id AND o.direction = 'DEBIT'
    AND o.txn_timestamp BETWEEN d.txn_timestamp AND d.txn_timestamp + INTERVAL 48 HOUR WHERE d.direction = 'CREDIT' AND d.amount_base >= 10000),
ra_s AS (SELECT account_id, customer_id, transaction_id, txn_timestamp, amount_base, count(*) AS n, sum(out_amount) AS total FROM ra_p GROUP BY ALL),
ra_q AS (SELECT *, {div('total', 'amount_base', 6)} AS ratio FROM ra_s),
h_ra AS (SELECT 'RAPID_MOVEMENT' AS rule_code, 'LAYERING' AS typology, customer_id, account_id, 'RAPID_MOVEMENT|ANCH|' || account_id || '|' || transaction_id AS dedup_key,
  {one_place('ratio * 100')} || '% of a ' || {money_text('amount_base')} || ' deposit (transaction ' || transaction_id || ' received ' || {stamp_text('txn_timestamp')} ||
  ') left account ' || account_id || ' within 48 hours, across ' || n || ' outbound transaction(s) totalling ' || {money_text('total')} ||
  '. Funds passing straight through an account is consistent with layering.' AS explanation, total AS evidence_amount_base, n + 1 AS evidence_count,
  0 AS jurisdiction_uplift, {div('ratio', '0.8', 4, 6)} AS magnitude_ratio, txn_timestamp AS first_ts, txn_timestamp + INTERVAL 48 HOUR AS last_ts,
  transaction_id AS anchor_txn_id FROM ra_q WHERE ratio >= 0.8)"""
DAILY = "dv AS (SELECT customer_id, CAST(txn_timestamp AS DATE) AS d, sum(amount_base) AS total, count(*) AS n, min(txn_timestamp) AS t0, max(txn_timestamp) AS t1 FROM ledger GROUP BY ALL)"
BEHAVE = f"""{DAILY}, be_b AS (SELECT a.customer_id, a.d, a.total, a.n, a.t0, a.t1, sum(b.total) AS base_total, sum(b.n) AS base_n FROM dv a
    JOIN dv b ON a.customer_id = b.customer_id AND b.d < a.d AND b.d >= a.d - 20 WHERE a.total >= 25000 GROUP BY ALL HAVING sum(b.n) >= 5),
be_a AS (SELECT *, {div('base_total', '20', 2)} AS average FROM be_b), be_m AS (SELECT *, {div('total', 'average', 4)} AS multiple FROM be_a WHERE average <> 0),
h_be AS (SELECT 'BEHAVIORAL_DEVIATION' AS rule_code, 'BEHAVIOURAL_ANOMALY' AS typology, customer_id, 'ACC_' || substr(customer_id, 6) AS account_id,
  'BEHAVIORAL_DEVIATION|CUST|' || customer_id || '|' || CAST(d AS VARCHAR) AS dedup_key,
  'Customer ' || customer_id || ' transacted ' || {money_text('total')} || ' across ' || n || ' transaction(s) on ' || CAST(d AS VARCHAR) || ' — ' ||
  {one_place('multiple')} || 'x their 20-day rolling average of ' || {money_text('average')} ||
  ' per day. A sudden departure from an established pattern is a behavioural indicator of account misuse.' AS explanation, total AS evidence_amount_base,
  n AS evidence_count, 0 AS jurisdiction_uplift, {div('multiple', '3', 4, 4)} AS magnitude_ratio, t0 AS first_ts, t1 AS last_ts,
  (SELECT arg_min(l.transaction_id, l.txn_timestamp) FROM ledger l WHERE l.customer_id = be_m.customer_id AND l.txn_timestamp = t0) AS anchor_txn_id
  FROM be_m WHERE multiple > 3)"""

for _key, _cte, _table in [
        ("det_threshold", CTR, "h_ctr"), ("det_listed_party", LISTED, "h_jur"), ("det_structuring", STRUCT, "h_st"),
        ("det_round_amounts", ROUND, "h_ro"), ("det_rapid_movement", RAPID, "h_ra"), ("det_behaviour", BEHAVE, "h_be")]:
    ORACLE[_key] = f"WITH RECURSIVE {LEDGER}, {_cte} SELECT {_HIT} FROM {_table}"

HITS = f"""{LEDGER}, {CTR}, {LISTED}, {STRUCT}, {ROUND}, {RAPID}, {BEHAVE},
hits AS MATERIALIZED (SELECT * FROM h_ctr UNION ALL SELECT * FROM h_jur UNION ALL SELECT * FROM h_st UNION ALL SELECT * FROM h_ro
  UNION ALL SELECT * FROM h_ra UNION ALL SELECT * FROM h_be)"""
EVIDENCE = """evidence AS MATERIALIZED (
  SELECT rule_code, dedup_key, 0 AS position, first_ts AS txn_timestamp, anchor_txn_id AS transaction_id FROM hits
    WHERE rule_code IN ('CTR_THRESHOLD', 'HIGH_RISK_JURISDICTION', 'RAPID_MOVEMENT')
  UNION ALL SELECT 'STRUCTURING', 'STRUCTURING|ACCT|' || m.account_id || '|' || CAST(CAST(s.cluster_ts AS DATE) AS VARCHAR), 0, m.txn_timestamp, m.transaction_id
    FROM st_m m JOIN st_s s ON s.account_id = m.account_id AND s.first_rn = m.first_rn
  UNION ALL SELECT 'ROUND_AMOUNT_PATTERN', 'ROUND_AMOUNT_PATTERN|ACCT|' || m.account_id || '|' || CAST(CAST(s.cluster_ts AS DATE) AS VARCHAR), 0, m.txn_timestamp, m.transaction_id
    FROM ro_m m JOIN ro_s s ON s.account_id = m.account_id AND s.first_rn = m.first_rn
  UNION ALL SELECT 'RAPID_MOVEMENT', dedup_key, 1, p.out_ts, p.out_id FROM h_ra h JOIN ra_p p ON p.transaction_id = h.anchor_txn_id
  UNION ALL SELECT 'BEHAVIORAL_DEVIATION', dedup_key, 0, l.txn_timestamp, l.transaction_id FROM h_be h JOIN ledger l ON l.customer_id = h.customer_id
    AND CAST(l.txn_timestamp AS DATE) = CAST(h.first_ts AS DATE))"""

ORACLE["det_evidence"] = f"""WITH RECURSIVE {HITS}, {EVIDENCE} SELECT rule_code, dedup_key, position, {ts('txn_timestamp')} AS txn_timestamp, transaction_id FROM evidence"""
ORACLE["src_lookup_by_ids"] = f"""WITH RECURSIVE {HITS}, {EVIDENCE} SELECT transaction_id, customer_id, {dbl('amount_base')} AS amount_base FROM ledger
  WHERE transaction_id IN (SELECT transaction_id FROM evidence)"""
ORACLE["det_daily_volume"] = f"""WITH {LEDGER}, {DAILY} SELECT customer_id, CAST(d AS VARCHAR) AS day, {dbl('total')} AS total_base, n AS txn_count FROM dv"""
ORACLE["det_context"] = f"""WITH {LEDGER}, b AS (SELECT * FROM ledger WHERE currency = 'USD')
SELECT account_id, transaction_id, {ts('txn_timestamp')} AS txn_timestamp, {dbl('amount_base')} AS amount_base FROM ledger
WHERE account_id IN (SELECT account_id FROM b) AND txn_timestamp BETWEEN (SELECT min(txn_timestamp) FROM b) - INTERVAL 240 HOUR AND (SELECT max(txn_timestamp) FROM b) + INTERVAL 240 HOUR"""
ORACLE["det_all_rules"] = f"""WITH RECURSIVE {HITS} SELECT rule_code, typology, count(*) AS hits, CAST(sum(evidence_count) AS BIGINT) AS evidence,
  {dbl('sum(evidence_amount_base)')} AS amount, {dbl('sum(CAST(magnitude_ratio AS DECIMAL(28,4)))')} AS magnitude FROM hits GROUP BY ALL"""

# --- scores and alerts -----------------------------------------------------

_WEIGHT = "CASE rule_code " + " ".join(f"WHEN '{r[0]}' THEN {r[3]}" for r in sc.RULES) + " END"


def score_sql(source: str, prior: str = "0") -> str:
    """Score columns joined to `source` hits (dedup_key, customer_id, ...)."""
    return f"""SELECT *, least(100, greatest(0, "ruleWeight" + "jurisdictionUplift" + "customerRiskUplift" + "pepUplift" + "magnitudeUplift" + "recurrenceUplift")) AS total FROM (
  SELECT s.*, {_WEIGHT} AS "ruleWeight", jurisdiction_uplift AS "jurisdictionUplift",
    CASE c.risk_rating WHEN 'MEDIUM' THEN 7 WHEN 'HIGH' THEN 15 ELSE 0 END AS "customerRiskUplift", CASE WHEN c.is_politically_exposed THEN 10 ELSE 0 END AS "pepUplift",
    CASE WHEN magnitude_ratio > 1 THEN least(15, CAST(floor(5 * (ln(CAST(magnitude_ratio AS DOUBLE)) / ln(2)) + 0.5) AS INT)) ELSE 0 END AS "magnitudeUplift",
    least(12, 3 * ({prior})) AS "recurrenceUplift" FROM ({source}) s LEFT JOIN customers c USING (customer_id))"""


_PARTS = '"ruleWeight", "jurisdictionUplift", "customerRiskUplift", "pepUplift", "magnitudeUplift", "recurrenceUplift", total'
BAND = "CASE WHEN {0} >= 80 THEN 'CRITICAL' WHEN {0} >= 60 THEN 'HIGH' WHEN {0} >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


def merged_sql(source: str, order: str = "(first_ts, anchor_txn_id)", at: str = "last_ts") -> str:
    return f"""SELECT dedup_key, count(*) AS trigger_count, max(evidence_amount_base) AS evidence_amount_base, CAST(sum(evidence_count) AS BIGINT) AS evidence_count,
    arg_min(rule_code, {order}) AS rule_code, arg_min(typology, {order}) AS typology, arg_min(customer_id, {order}) AS customer_id,
    arg_min(account_id, {order}) AS account_id, arg_min(explanation, {order}) AS explanation, arg_max(jurisdiction_uplift, {order}) AS jurisdiction_uplift,
    arg_max(magnitude_ratio, {order}) AS magnitude_ratio, min({at}) AS first_detected_at, max({at}) AS last_detected_at FROM {source} GROUP BY dedup_key"""


ALERTS = f"""{HITS}, {CUSTOMERS}, alerts AS MATERIALIZED (SELECT *, total AS risk_score, {BAND.format('total')} AS severity,
  {ref('ALT', 'first_detected_at', 'dedup_key')} AS alert_ref FROM ({score_sql(merged_sql('hits'), 's.trigger_count - 1')}))"""
A = f"WITH RECURSIVE {ALERTS}"

ORACLE["sco_scored_hits"] = f"""WITH RECURSIVE {HITS}, {CUSTOMERS} SELECT dedup_key, {ts('first_ts')} AS first_ts, {_PARTS} FROM ({score_sql('SELECT * FROM hits')})"""
ORACLE["sco_breakdown_json"] = A + """ SELECT dedup_key, '{"ruleWeight":' || "ruleWeight" || ',"jurisdictionUplift":' || "jurisdictionUplift" || ',"customerRiskUplift":' ||
  "customerRiskUplift" || ',"pepUplift":' || "pepUplift" || ',"magnitudeUplift":' || "magnitudeUplift" || ',"recurrenceUplift":' || "recurrenceUplift" ||
  ',"total":' || total || '}' AS as_text, total FROM alerts"""
NOISY = "least(100, greatest(0, CAST(floor(100 * (1 - product(1 - risk_score / 100.0)) + 0.5) AS INT)))"
ORACLE["sco_noisy_or"] = A + f" SELECT customer_id, {NOISY} AS aggregate, count(*) AS aggregate_members FROM alerts GROUP BY customer_id"
ORACLE["alr_alerts"] = A + f""" SELECT alert_ref, dedup_key, customer_id, account_id, rule_code, typology, risk_score, severity, 'OPEN' AS status,
  {dbl('evidence_amount_base')} AS evidence_amount_base, evidence_count, trigger_count, {ts('first_detected_at')} AS first_detected_at, {ts('last_detected_at')} AS last_detected_at FROM alerts"""

_LOG = """numbered AS (SELECT *, CAST(regexp_extract(anchor_txn_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM hits),
log AS (SELECT * EXCLUDE n, 0 AS batch_id, TIMESTAMP '2024-02-01 00:00:00' AS detected_at FROM numbered
  UNION ALL SELECT * EXCLUDE n REPLACE (evidence_amount_base + n % 7 - 3 AS evidence_amount_base, magnitude_ratio * 2 AS magnitude_ratio), 1, TIMESTAMP '2024-02-02 00:00:00' FROM numbered WHERE n % 3 = 0
  UNION ALL SELECT * EXCLUDE n, 2, TIMESTAMP '2024-02-03 00:00:00' FROM numbered WHERE n % 9 = 0)"""
_LOG_ORDER = "(batch_id, first_ts, anchor_txn_id)"
ORACLE["alr_merge_repeats"] = f"""WITH RECURSIVE {HITS}, {EVIDENCE}, {CUSTOMERS}, {_LOG}, cited AS (SELECT dedup_key, count(DISTINCT transaction_id) AS n FROM evidence GROUP BY 1)
SELECT dedup_key, trigger_count, {dbl('evidence_amount_base')} AS evidence_amount_base, coalesce(n, 0) AS evidence_count, total AS risk_score, {BAND.format('total')} AS severity,
  {ts('first_detected_at')} AS first_detected_at, {ts('last_detected_at')} AS last_detected_at
FROM ({score_sql(merged_sql('log', _LOG_ORDER, 'detected_at'), 's.trigger_count - 1')}) LEFT JOIN cited USING (dedup_key)"""
ORACLE["alr_repeats_after_disposal"] = f"""WITH RECURSIVE {HITS}, {CUSTOMERS}, {_LOG}, kept AS (SELECT * FROM log
  WHERE detected_at <= '2024-02-01 12:00:00' OR dedup_key NOT IN (SELECT dedup_key FROM hits WHERE evidence_amount_base >= 30000))
SELECT dedup_key, trigger_count, total AS risk_score FROM ({score_sql(merged_sql('kept', _LOG_ORDER, 'detected_at'), 's.trigger_count - 1')})"""
ORACLE["alr_merged_evidence"] = f"WITH RECURSIVE {HITS}, {EVIDENCE} SELECT DISTINCT dedup_key, transaction_id, rule_code FROM evidence"

DISPOSED = """numbered AS (SELECT *, CAST(regexp_extract(dedup_key, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS n FROM alerts),
disposed AS (SELECT *, CASE WHEN n % 10 = 9 THEN NULL WHEN n % 10 < 6 THEN 'FALSE_POSITIVE' WHEN n % 10 = 6 THEN 'TRUE_POSITIVE'
    WHEN n % 10 = 7 THEN 'ESCALATED_TO_SAR' ELSE 'CLEARED_NO_ACTION' END AS disposition,
  CASE WHEN n % 10 <> 9 THEN 'CLOSED' WHEN n % 20 = 9 THEN 'IN_REVIEW' ELSE 'OPEN' END AS status, (n % 50 - 1) * 60 + n % 60 AS minutes FROM numbered)"""
ORACLE["alr_search"] = A + f""", {DISPOSED} SELECT alert_ref, customer_id, risk_score, disposition FROM disposed
  WHERE status = 'CLOSED' AND severity = 'MEDIUM' AND rule_code = 'RAPID_MOVEMENT' AND risk_score >= 45"""
ORACLE["alr_queue"] = A + f""", {DISPOSED} SELECT alert_ref, customer_id, CASE WHEN first_name IS NULL THEN 'U******' ELSE {mask_name("first_name || ' ' || last_name")} END AS customer_name_masked,
  {mask_id('account_id')} AS account_masked, rule_code, typology, risk_score, severity, status, {dbl('evidence_amount_base')} AS evidence_amount_base, evidence_count, trigger_count,
  disposition, {ts('first_detected_at')} AS first_detected_at, {ts('last_detected_at')} AS last_detected_at FROM disposed LEFT JOIN customers USING (customer_id)"""
ORACLE["lim_page"] = A + " SELECT alert_ref, risk_score, customer_id FROM alerts ORDER BY risk_score DESC, alert_ref LIMIT 25 OFFSET 50"
ORACLE["lim_page_totals"] = A + """ SELECT 2 AS page, 25 AS size, count(*) AS total_elements, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages, false AS first,
  3 >= ceil(count(*) / 25.0) AS last FROM alerts"""

REQUESTS = """base AS (SELECT 'CASE|' || customer_id AS case_key, customer_id, alert_ref, CAST(substr(customer_id, 6) AS BIGINT) AS n FROM alerts),
requests AS (SELECT * FROM base UNION ALL SELECT DISTINCT case_key, customer_id, 'ALT-UNKNOWN', n FROM base WHERE n % 10 = 7
  UNION ALL SELECT 'CASE|CUST_' || (n + 1), 'CUST_' || (n + 1), min(alert_ref), n + 1 FROM base WHERE (n + 1) % 10 = 5 GROUP BY n),
rq AS (SELECT r.case_key, r.customer_id, r.n, r.alert_ref, a.customer_id AS owner, a.risk_score FROM requests r LEFT JOIN alerts a ON a.alert_ref = r.alert_ref),
rc AS (SELECT case_key, any_value(customer_id) AS customer_id, any_value(n) AS n, count(*) AS alert_count, count(*) FILTER (owner IS NULL) AS unknown,
  count(*) FILTER (owner <> customer_id) AS alien, """ + NOISY.replace("risk_score", "coalesce(risk_score, 0)") + """ AS score FROM rq GROUP BY case_key)"""
CASES = f"""{REQUESTS}, cases AS MATERIALIZED (SELECT 'CASE-20240201-' || upper(left(sha256(case_key), 24)) AS case_ref, case_key, customer_id,
  CASE WHEN n % 2 = 0 THEN 'Investigation — ' || customer_id ELSE 'Review of ' || customer_id END AS title, 'NEW' AS status, score AS aggregate_risk_score,
  {BAND.format('score')} AS priority, 'analyst' || (n % 3) AS opened_by, 'analyst' || (n % 3) AS assigned_to, TIMESTAMP '2024-02-01 00:00:00' AS opened_at, alert_count
  FROM rc WHERE unknown = 0 AND alien = 0),
members AS MATERIALIZED (SELECT DISTINCT case_ref, alert_ref FROM requests JOIN cases USING (case_key))"""
C = f"{A}, {CASES}"
ORACLE["alr_detail"] = C + f""" SELECT alert_ref, coalesce(first_name || ' ' || last_name, 'Unknown') AS customer_name, account_id, explanation, {_PARTS}, case_ref
  FROM alerts LEFT JOIN customers USING (customer_id) LEFT JOIN members USING (alert_ref)"""
ORACLE["alr_detail_evidence"] = f"""{A}, {EVIDENCE} SELECT alert_ref, transaction_id, {ts('l.txn_timestamp')} AS txn_timestamp, direction, {dbl('amount')} AS amount, currency,
  {dbl('amount_base')} AS amount_base, channel, counterparty_name, counterparty_country
  FROM alerts JOIN (SELECT DISTINCT dedup_key, transaction_id FROM evidence) USING (dedup_key) JOIN ledger l USING (transaction_id)"""
ORACLE["alr_customer_alerts"] = A + " SELECT customer_id, alert_ref, dedup_key, risk_score FROM alerts JOIN customers USING (customer_id)"
ORACLE["alr_lookups"] = C + """ SELECT 'ref' AS kind, alert_ref, customer_id, risk_score FROM alerts WHERE severity = 'CRITICAL'
  UNION ALL SELECT 'key', alert_ref, customer_id, risk_score FROM alerts WHERE dedup_key IN (SELECT dedup_key FROM hits WHERE evidence_count = 1)
  UNION ALL SELECT 'case', alert_ref, customer_id, risk_score FROM alerts WHERE alert_ref IN (SELECT alert_ref FROM members JOIN cases USING (case_ref) WHERE opened_by = 'analyst2')"""
ORACLE["lim_timeline"] = f"""{A}, {EVIDENCE}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY txn_timestamp DESC, transaction_id) AS place FROM ledger) WHERE place <= 20),
cited AS (SELECT DISTINCT e.transaction_id, a.customer_id, a.alert_ref, a.risk_score FROM evidence e JOIN alerts a USING (dedup_key))
SELECT t.customer_id, place, t.transaction_id, {ts('txn_timestamp')} AS txn_timestamp, direction, {dbl('amount_base')} AS amount_base, alert_ref, risk_score
FROM top t LEFT JOIN cited c ON c.transaction_id = t.transaction_id AND c.customer_id = t.customer_id"""

# --- dashboard and productivity --------------------------------------------

ORACLE["agg_by_rule"] = A + " SELECT rule_code, count(*) AS n FROM alerts GROUP BY 1"
ORACLE["agg_totals"] = C + """ SELECT (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM cases) AS cases, (SELECT count(*) FROM ledger) AS transactions,
  (SELECT count(*) FROM customers) AS customers"""
ORACLE["agg_heatmap"] = A + " SELECT customer_id, typology, max(risk_score) AS peak_risk_score, count(*) AS alert_count FROM alerts GROUP BY ALL"
ORACLE["agg_heatmap_grid"] = A + " SELECT customer_id, " + ", ".join(
    f"max(risk_score) FILTER (typology = '{r[1]}') AS {r[1].lower()}" for r in sorted(sc.RULES, key=lambda r: r[1])) + """, max(risk_score) AS peak
  FROM alerts GROUP BY customer_id ORDER BY peak DESC, customer_id LIMIT 25"""
ORACLE["agg_productivity"] = A + f""", {DISPOSED}, h AS (SELECT minutes / 60.0 AS h FROM disposed WHERE disposition IS NOT NULL AND minutes >= 0)
SELECT count(*) AS total_alerts, count(disposition) AS disposed_alerts, count(*) FILTER (status = 'OPEN') AS open_alerts,
  floor(count(*) FILTER (disposition = 'FALSE_POSITIVE') * 10000.0 / count(disposition) + 0.5) / 100.0 AS false_positive_rate_pct,
  count(*) FILTER (disposition = 'ESCALATED_TO_SAR') AS sar_count, (SELECT floor(CAST(avg(h) AS DOUBLE) * 100 + 0.5) / 100 FROM h) AS mean_hours,
  (SELECT floor(CAST(median(h) AS DOUBLE) * 100 + 0.5) / 100 FROM h) AS median_hours FROM disposed"""
ORACLE["agg_rule_quality"] = A + f""", {DISPOSED} SELECT rule_code, count(*) AS disposed, count(*) FILTER (disposition = 'FALSE_POSITIVE') AS false_positives,
  CASE WHEN count(*) >= 20 THEN floor(count(*) FILTER (disposition = 'FALSE_POSITIVE') * 10000.0 / count(*) + 0.5) / 100.0 END AS false_positive_rate_pct,
  count(*) >= 20 AS sufficient_sample FROM disposed WHERE disposition IS NOT NULL GROUP BY 1"""
ORACLE["agg_daily_alerts"] = A + """ SELECT CAST(CAST(first_detected_at AS DATE) AS VARCHAR) AS day, count(*) AS alerts FROM alerts
  WHERE first_detected_at >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY GROUP BY 1"""
ORACLE["agg_days_touched"] = f"WITH {LEDGER} SELECT DISTINCT customer_id, CAST(CAST(txn_timestamp AS DATE) AS VARCHAR) AS day FROM ledger"

# --- lifecycle -------------------------------------------------------------


def replay_sql(name: str, source: str, initial: str, legal: str) -> str:
    """State after each event, one event at a time. `source` has entity, t, seq, target, disposition, reason, senior."""
    problem = ("CASE WHEN target <> 'CLOSED' THEN NULL WHEN disposition IS NULL THEN 'disposition required' WHEN reason IS NULL OR trim(reason) = '' THEN 'reason required' "
               "WHEN disposition = 'ESCALATED_TO_SAR' AND NOT senior THEN 'senior role required' END")

    def outcome(state: str) -> str:
        return (f"CASE WHEN {state} = e.target THEN 'SAME_STATE' WHEN ({state}, e.target) NOT IN ({legal}) THEN 'illegal move' "
                f"ELSE coalesce(e.problem, 'APPLIED') END")
    return f"""{name}_e AS MATERIALIZED (SELECT *, {problem} AS problem, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS rn FROM ({source})),
{name}_r AS (SELECT e.entity, e.rn, '{initial}' AS from_state, {outcome(f"'{initial}'")} AS outcome, CASE WHEN {outcome(f"'{initial}'")} = 'APPLIED' THEN e.target ELSE '{initial}' END AS to_state
    FROM {name}_e e WHERE rn = 1
  UNION ALL SELECT e.entity, e.rn, r.to_state, {outcome('r.to_state')}, CASE WHEN {outcome('r.to_state')} = 'APPLIED' THEN e.target ELSE r.to_state END
    FROM {name}_r r JOIN {name}_e e ON e.entity = r.entity AND e.rn = r.rn + 1),
{name} AS (SELECT e.*, r.from_state, r.outcome, r.to_state FROM {name}_e e JOIN {name}_r r ON r.entity = e.entity AND r.rn = e.rn),
{name}_s AS (SELECT entity, arg_max(to_state, rn) AS state, count(*) AS events, count(*) FILTER (outcome = 'APPLIED') AS applied,
    count(*) FILTER (outcome NOT IN ('APPLIED', 'SAME_STATE')) AS refused, max(disposition) FILTER (outcome = 'APPLIED' AND target = 'CLOSED') AS disposition,
    max(reason) FILTER (outcome = 'APPLIED' AND target = 'CLOSED') AS disposition_reason, max(actor) FILTER (outcome = 'APPLIED' AND target = 'CLOSED') AS disposed_by,
    max(t) FILTER (outcome = 'APPLIED' AND target = 'CLOSED') AS disposed_at FROM {name} GROUP BY entity)"""


_ALERT_LEGAL = ("('OPEN','IN_REVIEW'), ('OPEN','ESCALATED'), ('OPEN','CLOSED'), ('IN_REVIEW','ESCALATED'), ('IN_REVIEW','CLOSED'), ('IN_REVIEW','OPEN'), "
                "('ESCALATED','CLOSED'), ('ESCALATED','IN_REVIEW')")
_CASE_LEGAL = ("('NEW','INVESTIGATING'), ('NEW','CLOSED'), ('INVESTIGATING','PENDING_APPROVAL'), ('INVESTIGATING','CLOSED'), ('PENDING_APPROVAL','CLOSED'), "
               "('PENDING_APPROVAL','INVESTIGATING')")
_ALERT_EVENTS = """SELECT 'ALT_' || user_id AS entity, ts AS t, event_id AS seq, CASE event_type WHEN 'click' THEN 'IN_REVIEW' WHEN 'view' THEN 'OPEN' WHEN 'error' THEN 'ESCALATED' ELSE 'CLOSED' END AS target,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'ESCALATED_TO_SAR' ELSE 'FALSE_POSITIVE' END END AS disposition,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'reviewed' END END AS reason, 'analyst' || (event_id % 5) AS actor, event_id % 3 = 0 AS senior FROM events"""
_CASE_EVENTS = """SELECT case_ref AS entity, ts AS t, event_id AS seq, CASE WHEN event_type IN ('click', 'error') THEN 'INVESTIGATING' WHEN event_type = 'view' THEN 'PENDING_APPROVAL' ELSE 'CLOSED' END AS target,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'ESCALATED_TO_SAR' WHEN 1 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END END AS disposition,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'reviewed' END END AS reason, 'analyst' || (event_id % 5) AS actor, event_id % 3 = 0 AS senior
  FROM events JOIN cases ON customer_id = 'CUST_' || user_id"""
R = f"WITH RECURSIVE {replay_sql('al', _ALERT_EVENTS, 'OPEN', _ALERT_LEGAL)}"
CR = f"{C}, {replay_sql('ca', _CASE_EVENTS, 'NEW', _CASE_LEGAL)}"
_STATE = f"entity AS entity_id, state, events, applied, refused, disposition, disposition_reason, disposed_by, {ts('disposed_at')} AS disposed_at"
ORACLE["lif_alert_replay"] = R + " SELECT entity AS entity_id, seq AS event_seq, target, from_state, to_state, outcome FROM al"
ORACLE["lif_alert_states"] = R + f" SELECT {_STATE} FROM al_s"
ORACLE["lif_case_replay"] = CR + " SELECT entity AS entity_id, seq AS event_seq, from_state, to_state, outcome FROM ca"
CLOSED = """closings AS (SELECT * FROM ca WHERE outcome = 'APPLIED' AND target = 'CLOSED'),
closed_cases AS (SELECT c.* EXCLUDE status, coalesce(state, c.status) AS status, disposition, disposition_reason, disposed_at AS closed_at FROM cases c LEFT JOIN ca_s ON entity = case_ref)"""
CC = f"{CR}, {CLOSED}"
ORACLE["lif_cascade"] = CC + f""" SELECT alert_ref AS entity_id, CASE WHEN c.entity IS NULL THEN 'IN_REVIEW' ELSE 'CLOSED' END AS state,
  1 + (c.entity IS NOT NULL)::INT AS events, 1 + (c.entity IS NOT NULL)::INT AS applied, 0 AS refused, c.disposition,
  'Closed via case ' || case_ref || ': ' || c.reason AS disposition_reason, {ts('c.t')} AS disposed_at FROM members LEFT JOIN closings c ON c.entity = case_ref"""
ORACLE["lif_alerts_with_status"] = CC + f""" SELECT alert_ref, CASE WHEN c.entity IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status, c.disposition, {ts('c.t')} AS disposed_at
  FROM alerts LEFT JOIN members USING (alert_ref) LEFT JOIN closings c ON c.entity = case_ref"""
ORACLE["lif_open_cases"] = C + f" SELECT * REPLACE ({ts('opened_at')} AS opened_at) FROM cases"
ORACLE["lif_refused_cases"] = C + """ SELECT case_key, alert_count, CASE WHEN unknown > 0 THEN 'unknown alert reference'
  ELSE 'All alerts in a case must belong to customer ' || customer_id END AS problem FROM rc WHERE unknown > 0 OR alien > 0"""
ORACLE["lif_case_detail"] = CC + f""" SELECT case_ref, CASE WHEN first_name IS NULL THEN 'Unknown' ELSE {mask_name("first_name || ' ' || last_name")} END AS customer_name_masked, status, disposition,
  disposition_reason, {ts('closed_at')} AS closed_at FROM closed_cases LEFT JOIN customers USING (customer_id)"""
ORACLE["agg_by_status"] = CC + f""", {DISPOSED}, domain(kind, value) AS (VALUES {_values(
    [("alert_status", v) for v in ("OPEN", "IN_REVIEW", "ESCALATED", "CLOSED")] + [("severity", v) for v in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]
    + [("case_status", v) for v in ("NEW", "INVESTIGATING", "PENDING_APPROVAL", "CLOSED")]
    + [("disposition", v) for v in ("TRUE_POSITIVE", "FALSE_POSITIVE", "ESCALATED_TO_SAR", "CLEARED_NO_ACTION")])}),
seen AS (SELECT 'alert_status' AS kind, status AS value FROM disposed UNION ALL SELECT 'severity', severity FROM disposed UNION ALL SELECT 'case_status', status FROM closed_cases
  UNION ALL SELECT 'disposition', disposition FROM disposed)
SELECT d.kind, d.value, count(s.value) AS n FROM domain d LEFT JOIN seen s ON s.kind = d.kind AND s.value = d.value GROUP BY ALL"""
_ASSIGN = "a AS (SELECT case_ref, event_id AS seq, 'analyst' || (event_id % 6) AS assignee FROM events JOIN cases ON customer_id = 'CUST_' || user_id)"
ORACLE["lif_reassignments"] = f"""{C}, {_ASSIGN} SELECT case_ref, seq, coalesce(lag(assignee) OVER (PARTITION BY case_ref ORDER BY seq), opened_by) AS from_state, assignee AS to_state,
  'CASE_ASSIGNED' AS action, 'Reassigned' AS details FROM a JOIN cases USING (case_ref)"""
ORACLE["lif_case_queue"] = f"""{CC}, {_ASSIGN}, now AS (SELECT case_ref, arg_max(assignee, seq) AS who FROM a GROUP BY 1)
  SELECT case_ref, customer_id, title, status, priority, aggregate_risk_score, disposition, {ts('closed_at')} AS closed_at,
  (SELECT count(*) FROM members m WHERE m.case_ref = c.case_ref) AS member_count FROM closed_cases c LEFT JOIN now USING (case_ref)
  WHERE status = 'CLOSED' AND coalesce(who, opened_by) = 'analyst1' ORDER BY aggregate_risk_score DESC, case_ref LIMIT 200"""
ORACLE["lif_case_members"] = f"""{C} SELECT case_ref, alert_ref, {mask_id('account_id')} AS account_masked, rule_code, risk_score, severity, evidence_count
  FROM members JOIN alerts USING (alert_ref)"""
ORACLE["lif_case_trail"] = f"""{CR}, rows AS (SELECT entity AS entity_id, 'CASE_STATUS_CHANGED' AS action, actor, from_state, to_state, t AS occurred_at, seq AS event_seq
    FROM ca WHERE outcome = 'APPLIED' UNION ALL SELECT case_ref, 'CASE_OPENED', opened_by, NULL, 'NEW', opened_at, 0 FROM cases),
  placed AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY occurred_at DESC, event_seq DESC, action, to_state) AS place FROM rows)
  SELECT entity_id, place, action, actor, from_state, to_state, {ts('occurred_at')} AS occurred_at, event_seq FROM placed WHERE place <= 100"""
ORACLE["lif_last_assignee"] = f"{C}, {_ASSIGN} SELECT case_ref, arg_max(assignee, seq) AS assigned_to, count(*) AS assignments FROM a GROUP BY 1"
ORACLE["lif_list_changes"] = """SELECT 'K' || (event_id % 200) AS country_code, arg_max(event_id % 41, event_id) AS risk_weight, arg_max(event_type <> 'error', event_id) AS active,
  count(*) AS changes FROM events GROUP BY 1"""
_MOVED = """SELECT 'ALERT' AS entity_type, entity AS entity_id, 'ALERT_STATUS_CHANGED' AS action, actor, CASE WHEN senior THEN 'SENIOR_ANALYST' ELSE 'ANALYST' END AS actor_roles,
  from_state, to_state, CASE WHEN disposition IS NOT NULL THEN 'Disposition: ' || disposition || ' — ' || coalesce(reason, 'null') END AS details, t AS occurred_at, seq AS event_seq
  FROM al WHERE outcome = 'APPLIED'"""
ORACLE["lim_audit_trail"] = R + f""", moved AS ({_MOVED}) SELECT entity_id, event_seq, action, from_state, to_state, {ts('occurred_at')} AS occurred_at FROM moved
  ORDER BY occurred_at DESC, event_seq DESC, entity_id LIMIT 300"""
ORACLE["snk_audit_rows"] = f"""{C}, {replay_sql('al', _ALERT_EVENTS, 'OPEN', _ALERT_LEGAL)}, rows AS ({_MOVED}
  UNION ALL SELECT 'CASE', case_ref, 'CASE_OPENED', opened_by, NULL, NULL, 'NEW', 'Opened over ' || alert_count || ' alert(s), aggregate score ' || aggregate_risk_score, opened_at, 0 FROM cases
  UNION ALL SELECT 'ALERT', alert_ref, 'ALERT_CREATED', 'system', NULL, NULL, 'OPEN', 'Rule ' || rule_code || ' fired with score ' || risk_score, first_detected_at, 0 FROM alerts
  UNION ALL SELECT 'ALERT', alert_ref, 'ALERT_MERGED', 'system', NULL, NULL, NULL, 'Repeat detection folded in; trigger count now ' || trigger_count || ', score ' || risk_score, last_detected_at, 0
    FROM alerts WHERE trigger_count > 1)
SELECT * REPLACE ({ts('occurred_at')} AS occurred_at) FROM rows"""

# --- customer and case reports ---------------------------------------------

ORACLE["rep_masked_customers"] = f"""WITH {CUSTOMERS} SELECT customer_id, {mask_name("first_name || ' ' || last_name")} AS name_masked, {mask_id('national_id')} AS national_id_masked,
  {_EMAIL} AS email_masked, {_PHONE} AS phone_masked, city, country, customer_segment, kyc_status, risk_rating, is_politically_exposed AS politically_exposed FROM customers"""
ORACLE["rep_full_customers"] = f"""WITH {CUSTOMERS} SELECT customer_id, first_name, last_name, first_name || ' ' || last_name AS full_name, national_id, email, phone_number,
  CAST(date_of_birth AS VARCHAR) AS date_of_birth, gender, city, state, country, postal_code, occupation, {dbl('annual_income')} AS annual_income, employment_status,
  CAST(customer_since AS VARCHAR) AS customer_since, customer_segment, kyc_status, risk_rating, is_politically_exposed AS politically_exposed, num_complaints_last_year FROM customers"""
ORACLE["lim_customers_by_rating"] = f"""WITH {CUSTOMERS} SELECT customer_id, risk_rating, {dbl('annual_income')} AS annual_income FROM customers WHERE risk_rating IN ('MEDIUM', 'HIGH')
  ORDER BY customers.annual_income DESC, customer_id LIMIT 50 OFFSET 50"""

RECOMMEND = """CASE coalesce(disposition, 'none') WHEN 'none' THEN 'Case is not yet disposed. Complete the investigation and record a disposition before filing; this draft is provisional.'
  WHEN 'ESCALATED_TO_SAR' THEN 'File this report with the Financial Intelligence Unit within the statutory deadline. Apply enhanced monitoring to the subject''s remaining accounts and refer for a relationship review.'
  WHEN 'TRUE_POSITIVE' THEN 'Suspicion confirmed by the analyst but not yet escalated for filing. Refer to a senior analyst for a filing decision.'
  WHEN 'FALSE_POSITIVE' THEN 'The analyst assessed this activity as a false positive. This draft should NOT be filed; it is retained for audit purposes only.'
  ELSE 'The analyst cleared this activity with no action. This draft should NOT be filed; it is retained for audit purposes only.' END"""
SAR = f"""{CC}, {EVIDENCE}, {ACCOUNTS}, cite AS MATERIALIZED (SELECT DISTINCT case_ref, alert_ref, transaction_id FROM members JOIN alerts USING (alert_ref) JOIN evidence USING (dedup_key)),
sched AS MATERIALIZED (SELECT c.case_ref, l.* FROM (SELECT DISTINCT case_ref, transaction_id FROM cite) c JOIN ledger l USING (transaction_id)),
moved AS (SELECT case_ref, min(txn_timestamp) AS period_start, max(txn_timestamp) AS period_end, count(*) AS transaction_count, sum(amount_base) AS total_value_base FROM sched GROUP BY 1),
found AS (SELECT case_ref, a.* FROM members JOIN alerts a USING (alert_ref)),
kinds AS (SELECT case_ref, typology, min((-risk_score, alert_ref)) AS place FROM found GROUP BY ALL),
raised AS (SELECT case_ref, count(*) AS alert_count, max(risk_score) AS highest_risk_score FROM found GROUP BY 1),
listed AS (SELECT case_ref, string_agg(typology, ',' ORDER BY typology) AS typologies, string_agg(typology, ',' ORDER BY place) AS typologies_by_score, count(*) AS kind_count FROM kinds GROUP BY 1),
header AS MATERIALIZED (SELECT c.case_ref, c.customer_id, c.disposition AS case_disposition, r.alert_count, highest_risk_score, typologies, typologies_by_score, kind_count, period_start, period_end,
  transaction_count, total_value_base, first_name || ' ' || last_name AS full_name, national_id, date_of_birth, city || ', ' || state || ', ' || country || ', ' || postal_code AS address,
  occupation, customer_segment, kyc_status, risk_rating, is_politically_exposed AS politically_exposed, customer_since,
  'SAR-DRAFT-20240201-' || upper(left(sha256(c.case_ref), 24)) AS draft_ref, '{sc.INSTITUTION}' AS institution, 'analyst1' AS prepared_by, TIMESTAMP '2024-02-01' AS prepared_at,
  'INR' AS base_currency, {RECOMMEND.replace('disposition', 'c.disposition', 1)} AS recommended_action
  FROM closed_cases c JOIN raised r USING (case_ref) JOIN listed USING (case_ref) JOIN moved USING (case_ref) JOIN customers USING (customer_id)),
held AS (SELECT DISTINCT h.case_ref, a.account_id, a.account_type, a.currency, a.open_date, a.branch_code || coalesce(' / ' || a.branch_city, '') AS branch
  FROM header h JOIN accounts a USING (customer_id) JOIN sched s ON s.case_ref = h.case_ref AND s.account_id = a.account_id)"""
ORACLE["rep_sar_header"] = SAR + f""" SELECT * EXCLUDE kind_count REPLACE ({ts('period_start')} AS period_start, {ts('period_end')} AS period_end, {dbl('total_value_base')} AS total_value_base,
  CAST(date_of_birth AS VARCHAR) AS date_of_birth, CAST(customer_since AS VARCHAR) AS customer_since, {ts('prepared_at')} AS prepared_at) FROM header"""
ORACLE["rep_sar_accounts"] = SAR + " SELECT case_ref, account_id, account_type, currency, CAST(open_date AS VARCHAR) AS open_date, branch FROM held"
ORACLE["rep_sar_findings"] = SAR + " SELECT case_ref, alert_ref, typology, risk_score, severity, evidence_count FROM found"
ORACLE["rep_sar_schedule"] = SAR + f""" SELECT case_ref, transaction_id, {ts('txn_timestamp')} AS txn_timestamp, account_id, direction, {dbl('amount_base')} AS amount_base, {dbl('amount')} AS amount,
  currency, channel, counterparty_name, counterparty_country FROM sched"""
ORACLE["rep_sar_citations"] = SAR + " SELECT case_ref, alert_ref, transaction_id FROM cite"
ORACLE["rep_sar_audit"] = SAR + f""" SELECT case_ref AS entity_id, 'SAR_DRAFT_GENERATED' AS action, prepared_by AS actor,
  'SAR draft ' || draft_ref || ' generated over ' || alert_count || ' alert(s) and ' || transaction_count || ' transaction(s)' AS details, {ts('prepared_at')} AS occurred_at FROM header"""

_PERIOD = """CASE WHEN strftime(period_start, '%d %b %Y') = strftime(period_end, '%d %b %Y') THEN 'on ' || strftime(period_start, '%d %b %Y')
  ELSE 'between ' || strftime(period_start, '%d %b %Y') || ' and ' || strftime(period_end, '%d %b %Y') END"""
FRAGMENTS = f"""prose AS (
SELECT case_ref, 0 AS paragraph, 0 AS place, '' AS part, institution || ' is reporting suspicious activity identified on ' AS fragment FROM header
UNION ALL SELECT case_ref, 0, 1, account_id, CASE WHEN row_number() OVER (PARTITION BY case_ref ORDER BY account_id) > 1 THEN ', ' ELSE '' END || account_id FROM held
UNION ALL SELECT case_ref, 0, 2, '', ' held by ' || full_name || ' (customer reference ' || customer_id ||
  '). The activity was detected by the bank''s automated transaction monitoring system ' || {_PERIOD} || ' and comprises ' || transaction_count ||
  ' transaction(s) with an aggregate value of ' || {money_text('total_value_base')} || '.' FROM header
UNION ALL SELECT case_ref, 1, 0, '', chr(10) || chr(10) || 'SUBJECT: ' || full_name || ', national identifier ' || national_id || ', date of birth ' || CAST(date_of_birth AS VARCHAR) ||
  ', resident at ' || address || coalesce('. Stated occupation: ' || occupation, '') || '. The customer has been with the institution since ' ||
  coalesce(CAST(customer_since AS VARCHAR), 'an unrecorded date') || ' and is classified ' || lower(risk_rating) || ' risk with KYC status ' || kyc_status || '.' ||
  CASE WHEN politically_exposed THEN ' The subject is a POLITICALLY EXPOSED PERSON, which requires enhanced scrutiny of the activity described below.' ELSE '' END FROM header
UNION ALL SELECT case_ref, 2, 0, '', chr(10) || chr(10) || 'SUSPICIOUS ACTIVITY: the monitoring system raised ' || alert_count || ' alert(s) against this customer, the highest scoring ' ||
  highest_risk_score || ' out of 100. The activity is consistent with the following typolog' || CASE WHEN kind_count = 1 THEN 'y' ELSE 'ies' END || ': ' ||
  replace(replace(lower(typologies_by_score), '_', ' '), ',', ', ') || '. Each finding is set out below, with the supporting transactions listed in the accompanying schedule.' FROM header
UNION ALL SELECT case_ref, 3, -risk_score, alert_ref, chr(10) || chr(10) || 'FINDING ' || alert_ref || ' (' || replace(rule_code, '_', ' ') || ', risk score ' || risk_score || ', severity ' ||
  severity || '): ' || explanation FROM found WHERE case_ref IN (SELECT case_ref FROM header)
UNION ALL SELECT case_ref, 4, 0, '', chr(10) || chr(10) || 'CONCLUSION: on the basis of ' || CASE WHEN alert_count = 1 THEN 'the finding set out above'
  ELSE 'the ' || alert_count || ' findings set out above, taken together' END || ', the activity has no apparent lawful purpose or economic rationale consistent with the customer''s known profile, '
  || 'and the bank is unable to satisfy itself as to the legitimate origin or destination of the funds. This report is submitted for the attention of the Financial Intelligence Unit. '
  || 'No account has been closed and no funds have been frozen at the time of filing; the bank awaits guidance. All supporting records are retained and available on request.' FROM header)"""
ORACLE["rep_sar_narrative"] = f"{SAR}, {FRAGMENTS} SELECT * FROM prose"

_DOUBLE, _SINGLE = f"repeat('=', 78) || chr(10)", f"repeat('-', 78) || chr(10)"
_LINE = """rpad(transaction_id, 22, ' ') || ' ' || rpad(strftime(txn_timestamp, '%d %b %Y %H:%M'), 17, ' ') || ' ' || rpad(direction, 7, ' ') || ' ' || lpad(CAST(amount_base AS VARCHAR), 16, ' ') || '  ' ||
  counterparty_name || CASE WHEN counterparty_country IS NULL THEN '' ELSE ' (' || counterparty_country || ')' END || chr(10)"""
ORACLE["rep_sar_text"] = f"""{SAR}, {FRAGMENTS}, story AS (SELECT case_ref, string_agg(fragment, '' ORDER BY paragraph, place, part) AS body FROM prose GROUP BY 1),
lines AS (SELECT case_ref, string_agg({_LINE}, '' ORDER BY strftime(txn_timestamp, '%Y-%m-%d %H:%M:%S.%f') || ' ' || transaction_id) AS body FROM sched GROUP BY 1),
sources AS (SELECT case_ref, string_agg(alert_ref, ', ' ORDER BY alert_ref) AS body FROM found GROUP BY 1)
SELECT case_ref, 0 AS volume, 'SUSPICIOUS ACTIVITY REPORT — DRAFT' || chr(10) || {_DOUBLE} || 'Draft reference : ' || draft_ref || chr(10) || 'Case reference  : ' || case_ref || chr(10) ||
  'Institution     : ' || institution || chr(10) || 'Prepared by     : ' || prepared_by || chr(10) || 'Prepared at     : 2024-02-01T00:00:00Z' || chr(10) ||
  'Typologies      : ' || replace(typologies, ',', ', ') || chr(10) || {_DOUBLE} || chr(10) || 'NARRATIVE' || chr(10) || {_SINGLE} || story.body || chr(10) || chr(10) ||
  'TRANSACTION SCHEDULE (' || transaction_count || ' line(s))' || chr(10) || {_SINGLE} ||
  rpad('TRANSACTION', 22, ' ') || ' ' || rpad('DATE/TIME', 17, ' ') || ' ' || rpad('DR/CR', 7, ' ') || ' ' || lpad('AMOUNT (INR)', 16, ' ') || '  COUNTERPARTY' || chr(10) || lines.body ||
  chr(10) || 'RECOMMENDED ACTION' || chr(10) || {_SINGLE} || recommended_action || chr(10) || chr(10) || 'Source alerts: ' || sources.body || chr(10) AS text
FROM header JOIN story USING (case_ref) JOIN lines USING (case_ref) JOIN sources USING (case_ref)"""

# --- streaming and flagship ------------------------------------------------

ORACLE["str_stateless_rules"] = f"""WITH {LEDGER}, {CTR}, {LISTED} SELECT rule_code, dedup_key, {dbl('evidence_amount_base')} AS evidence_amount_base, jurisdiction_uplift
  FROM (SELECT * FROM h_ctr UNION ALL SELECT * FROM h_jur)"""


def _stream_ctes(whole_window: bool = False) -> tuple[list[str], list[str], list[str]]:
    """(each micro-batch's account patterns over the rows in its reach, their hits, their members)."""
    parts, log, cited = [], [], []
    for k, (start, end) in enumerate(zip(sc.STREAM_CUTS, sc.STREAM_CUTS[1:])):
        batch = f"b{k} AS (SELECT * FROM ledger WHERE txn_timestamp >= '{start}' AND txn_timestamp < '{end}')"
        if whole_window:
            parts.append(f"""{batch},
led{k} AS MATERIALIZED (SELECT * FROM ledger WHERE txn_timestamp < '{end}' AND account_id IN (SELECT account_id FROM b{k}) AND txn_timestamp BETWEEN
  (SELECT min(txn_timestamp) FROM b{k}) - INTERVAL 240 HOUR AND (SELECT max(txn_timestamp) FROM b{k}) + INTERVAL 240 HOUR)""")
        else:
            parts.append(f"""{batch},
led{k} AS MATERIALIZED (SELECT * FROM ledger l WHERE txn_timestamp < '{end}' AND EXISTS (SELECT 1 FROM b{k} b WHERE b.account_id = l.account_id
  AND l.txn_timestamp BETWEEN b.txn_timestamp - INTERVAL 240 HOUR AND b.txn_timestamp + INTERVAL 240 HOUR))""")
        for cte, short in ((STRUCT, "st"), (ROUND, "ro"), (RAPID, "ra")):
            own = re.sub(r"\b(FROM|JOIN) ledger\b", rf"\1 led{k}", cte)
            parts.append(re.sub(rf"\b{short}_", f"{short}{k}_", re.sub(rf"\bh_{short}\b", f"h_{short}{k}", own)))
            log.append(f"SELECT *, {k} AS batch_id FROM h_{short}{k}")
        for code, short in (("STRUCTURING", "st"), ("ROUND_AMOUNT_PATTERN", "ro")):
            cited.append(f"SELECT '{code}|ACCT|' || m.account_id || '|' || CAST(CAST(s.cluster_ts AS DATE) AS VARCHAR) AS dedup_key, m.transaction_id, {k} AS batch_id "
                         f"FROM {short}{k}_m m JOIN {short}{k}_s s ON s.account_id = m.account_id AND s.first_rn = m.first_rn")
    return parts, log, cited


def _stream_sql() -> str:
    """Alerts of the job's whole log; rules that read no history are found once."""
    parts, log, cited = _stream_ctes(whole_window=True)
    once = "SELECT *, 0 AS batch_id FROM {0}"
    return f"""WITH RECURSIVE {LEDGER}, {CTR}, {LISTED}, {BEHAVE}, {CUSTOMERS}, {', '.join(parts)},
log AS MATERIALIZED ({' UNION ALL '.join(log + [once.format(t) for t in ('h_ctr', 'h_jur', 'h_be')])}),
cited AS (SELECT dedup_key, count(DISTINCT transaction_id) AS n FROM ({' UNION ALL '.join(cited)}) GROUP BY 1),
widest AS (SELECT dedup_key, max(evidence_count) AS w FROM log GROUP BY 1)
SELECT rule_code, dedup_key, trigger_count, total AS risk_score, coalesce(n, w) AS evidence_count
FROM ({score_sql(merged_sql('log', '(batch_id, first_ts, anchor_txn_id)', 'last_ts'), 's.trigger_count - 1')}) LEFT JOIN cited USING (dedup_key) JOIN widest USING (dedup_key)"""


def _batch_of(at: str) -> str:
    cases = " ".join(f"WHEN {at} < '{end}' THEN {k}" for k, end in enumerate(sc.STREAM_CUTS[1:]))
    return f"CASE {cases} END"


def _answers_sql() -> str:
    """Findings of an event's own batch that cite it, and those whose key no earlier batch had."""
    parts, log, cited = _stream_ctes()
    log += [f"SELECT *, {_batch_of('first_ts')} AS batch_id FROM {t}" for t in ("h_ctr", "h_jur", "h_be")]
    cited += [f"SELECT dedup_key, anchor_txn_id, batch_id FROM log WHERE rule_code IN ('CTR_THRESHOLD', 'HIGH_RISK_JURISDICTION', 'RAPID_MOVEMENT')",
              f"SELECT dedup_key, l.transaction_id, {_batch_of('l.txn_timestamp')} FROM h_be h JOIN ledger l ON l.customer_id = h.customer_id AND CAST(l.txn_timestamp AS DATE) = CAST(h.first_ts AS DATE)"]
    return f"""WITH RECURSIVE {LEDGER}, {CTR}, {LISTED}, {BEHAVE}, {', '.join(parts)}, log AS MATERIALIZED ({' UNION ALL '.join(log)}),
opened AS (SELECT dedup_key, min(batch_id) AS first_batch FROM log GROUP BY 1),
events AS (SELECT *, {_batch_of('txn_timestamp')} AS batch_id FROM ledger),
cited AS (SELECT DISTINCT transaction_id, dedup_key, batch_id FROM ({' UNION ALL '.join(cited)})),
one AS (SELECT e.transaction_id, first_batch = e.batch_id AS is_new FROM events e JOIN cited c ON c.transaction_id = e.transaction_id AND c.batch_id = e.batch_id JOIN opened USING (dedup_key)
  UNION ALL SELECT e.transaction_id, first_batch = e.batch_id FROM events e JOIN log h ON h.rule_code = 'RAPID_MOVEMENT' AND e.direction = 'DEBIT' AND h.account_id = e.account_id
    AND h.batch_id = e.batch_id AND e.txn_timestamp BETWEEN h.first_ts AND h.last_ts JOIN opened USING (dedup_key)),
n AS (SELECT transaction_id, count(*) AS k, count(*) FILTER (WHERE is_new) AS fresh FROM one GROUP BY 1)
SELECT transaction_id, true AS accepted, coalesce(k, 0) AS rules_triggered, coalesce(fresh, 0) AS alerts_created FROM events LEFT JOIN n USING (transaction_id)"""


ORACLE["str_event_answers"] = _answers_sql()
ORACLE["det_rule_recovery"] = f"""WITH {LEDGER}, {CTR}, {LISTED} SELECT rule_code, dedup_key, 1::BIGINT AS batch_id FROM h_ctr
  UNION ALL SELECT rule_code, dedup_key, (first_ts >= '2024-01-18')::BIGINT FROM h_jur"""


def _repeats_sql() -> str:
    """Slice by slice: rows behind the watermark go, then those whose id is kept and not yet forgotten."""
    kept = []
    out = f"""WITH {LEDGER}, f AS (SELECT transaction_id, txn_timestamp AS seen_at, CAST(substr(transaction_id, 5) AS BIGINT) AS n,
  CASE WHEN txn_timestamp < '2024-01-12' THEN 0 WHEN txn_timestamp < '2024-01-24' THEN 1 ELSE 2 END AS slice FROM ledger),
r AS (SELECT transaction_id, seen_at, slice FROM f UNION ALL SELECT transaction_id, seen_at, slice + 1 FROM f WHERE n % 11 = 0
  UNION ALL SELECT transaction_id, seen_at + INTERVAL 6 DAY, slice + 1 FROM f WHERE n % 13 = 0 AND n % 11 <> 0)"""
    for k in range(3):
        mark = f"coalesce((SELECT date_trunc('millisecond', max(seen_at)) - INTERVAL 1 DAY FROM r WHERE slice < {k}), TIMESTAMP '1970-01-01')"
        before = " AND ".join(f"NOT EXISTS (SELECT 1 FROM k{j} k WHERE k.transaction_id = r.transaction_id AND k.seen_at + INTERVAL 1 DAY > {mark})" for j in kept) or "true"
        out += f", k{k} AS MATERIALIZED (SELECT transaction_id, seen_at FROM r WHERE slice = {k} AND seen_at > {mark} AND {before})"
        kept.append(k)
    return out + f" SELECT transaction_id, {ts('seen_at')} AS seen_at FROM (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in kept) + ")"


ORACLE["str_watermarked_repeats"] = _repeats_sql()
ORACLE["str_continuous_job"] = _stream_sql()
# Windows that the watermark, a day behind the last row, has passed.
ORACLE["str_stateful_windows"] = f"""WITH RECURSIVE {LEDGER}, {STRUCT}, {ROUND}, {RAPID}, w AS (SELECT date_trunc('millisecond', max(txn_timestamp)) - INTERVAL 1 DAY AS passed FROM ledger)
  SELECT {_HIT} FROM (SELECT *, first_ts + INTERVAL 24 HOUR AS ended FROM h_st UNION ALL SELECT *, first_ts + INTERVAL 240 HOUR FROM h_ro
  UNION ALL SELECT *, first_ts + INTERVAL 48 HOUR FROM h_ra), w WHERE ended <= passed"""
ORACLE["flagship_alert_queue"] = A + f""" SELECT alert_ref, customer_id, CASE WHEN first_name IS NULL THEN 'U******' ELSE {mask_name("first_name || ' ' || last_name")} END AS customer_name_masked,
  {mask_id('account_id')} AS account_masked, rule_code, typology, risk_score, severity, 'OPEN' AS status, {dbl('evidence_amount_base')} AS evidence_amount_base, evidence_count, trigger_count,
  CAST(NULL AS VARCHAR) AS disposition, {ts('first_detected_at')} AS first_detected_at, {ts('last_detected_at')} AS last_detected_at
  FROM alerts LEFT JOIN customers USING (customer_id) ORDER BY risk_score DESC, alert_ref LIMIT 200"""

# --- changes of settings, and what users add -------------------------------

_CHANGES = """ev AS (SELECT event_id AS e, 'admin' || (event_id % 5) AS actor, event_type <> 'error' AS fine, ts,
  CASE event_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM events),
given AS (SELECT *, 'RULE_' || (e % 50) AS rule_code, e % 104 - 2 AS weight, '{"minCount":' || (e % 7) || '}' AS params,
  CASE WHEN e % 10 = 7 THEN 'Rule not found: RULE_' || (e % 50) WHEN e % 104 - 2 < 0 OR e % 104 - 2 > 100 THEN 'weight must be between 0 and 100'
    WHEN e % 7 < 1 THEN 'minCount must be at least 1' END AS problem FROM ev),
states AS (SELECT rule_code, fine AS enabled, weight, severity, params, e AS seq, actor, ts FROM given WHERE problem IS NULL
  UNION ALL SELECT DISTINCT rule_code, true, 20, 'MEDIUM', '{}', -1, 'system', NULL::TIMESTAMP FROM given WHERE e % 10 <> 7)"""
ORACLE["snk_settings_audit"] = f"""WITH {_CHANGES}, said AS (SELECT *, 'enabled=' || enabled || ',weight=' || weight || ',severity=' || severity || ',params=' || params AS now FROM states),
steps AS (SELECT *, lag(now) OVER (PARTITION BY rule_code ORDER BY seq) AS before FROM said)
SELECT 'RULE' AS entity_type, rule_code AS entity_id, 'RULE_UPDATED' AS action, actor, 'Changed by ' || actor || ' | before: ' || before || ' | after: ' || now AS details,
  {ts('ts')} AS occurred_at FROM steps WHERE seq >= 0
UNION ALL SELECT 'REFERENCE', 'K' || (e % 200), 'REFERENCE_DATA_UPDATED', actor,
  CASE WHEN fine THEN 'Jurisdiction K' || (e % 200) || ' set to ' || severity || ' (weight ' || (e % 41) || ')' ELSE 'Jurisdiction deactivated' END, {ts('ts')} FROM ev
UNION ALL SELECT 'REFERENCE', 'Party ' || (e % 90), 'REFERENCE_DATA_UPDATED', actor,
  CASE WHEN e % 13 <> 0 THEN 'Watchlist entry added: ' || severity ELSE 'Watchlist entry deactivated' END, {ts('ts')} FROM ev
UNION ALL SELECT 'REFERENCE', 'C' || (e % 30), 'REFERENCE_DATA_UPDATED', actor, 'FX rate set to ' || CAST(e % 7 AS DECIMAL(18,8)) || ' per base unit', {ts('ts')} FROM ev WHERE e % 7 > 0"""
ORACLE["snk_refused_changes"] = f"""WITH {_CHANGES} SELECT 'rules' AS kind, rule_code AS key, e AS seq, actor, problem FROM given WHERE problem IS NOT NULL
  UNION ALL SELECT 'fx', 'C' || (e % 30), e, actor, 'rate must be greater than zero' FROM ev WHERE e % 7 = 0"""
ORACLE["snk_current_rules"] = f"""WITH {_CHANGES} SELECT rule_code, enabled, weight, severity, params, seq FROM states
  QUALIFY row_number() OVER (PARTITION BY rule_code ORDER BY seq DESC) = 1"""
ORACLE["snk_link_audit"] = C + f""" SELECT 'ALERT' AS entity_type, alert_ref AS entity_id, 'ALERT_LINKED_TO_CASE' AS action, opened_by AS actor, 'Linked to case ' || case_ref AS details,
  {ts('opened_at')} AS occurred_at FROM members JOIN cases USING (case_ref)"""
ORACLE["ext_custom_rule"] = f"""WITH {LEDGER}, found AS (SELECT 'LARGE_CREDIT' AS rule_code, * FROM ledger WHERE direction = 'CREDIT' AND amount_base >= 8000
  UNION ALL SELECT 'CTR_THRESHOLD', * FROM ledger WHERE amount_base >= 10000)
SELECT rule_code, rule_code || '|TXN|' || transaction_id AS dedup_key, customer_id, {dbl('amount_base')} AS evidence_amount_base, transaction_id AS anchor_txn_id FROM found"""
ORACLE["ext_custom_check"] = f"""WITH {_VAL} SELECT row_number, transaction_id AS record_key, 'BUSINESS_RULE' AS error_type, 'length of ' || trim(transaction_id) AS error_message
  FROM checked WHERE length(trim(transaction_id)) % 3 = 0"""
ORACLE["lim_detection_order"] = f"WITH {LEDGER} SELECT transaction_id, true AS in_order FROM ledger"
