"""Text and parsing expressions. Every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank space and control characters stripped from both ends of a value.
_EDGE = "".join(chr(i) for i in range(1, 33))

# Accepted spellings.
TRUE_WORDS = ["Y", "YES", "TRUE", "1"]
CREDIT_WORDS = ["CREDIT", "CR", "C", "DEPOSIT", "IN"]
DEBIT_WORDS = ["DEBIT", "DR", "D", "WITHDRAWAL", "OUT"]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGE))


def text_or(c: Column, fallback: str | None = None) -> Column:
    """The stripped value; blank becomes null, then `fallback` if one is given."""
    value = F.nullif(strip(c), F.lit(""))
    return value if fallback is None else F.coalesce(value, F.lit(fallback))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def parse_flag(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(TRUE_WORDS), F.lit(False))


def parse_int(c: Column) -> Column:
    """Number text truncated toward zero and clamped to the int range; unreadable is null."""
    number = strip(c).try_cast("double")
    return (
        F.when(F.isnan(number), F.lit(0))
        .when(number >= 2147483647, F.lit(2147483647))
        .when(number <= -2147483648, F.lit(-2147483648))
        .otherwise(number.try_cast("int"))
    )


def parse_decimal(c: Column, kind: str = "decimal(18,2)") -> Column:
    return strip(c).try_cast(kind)


# --- dates -----------------------------------------------------------------
_D, _M, _Y = r"(0[1-9]|[12]\d|3[01])", r"(0[1-9]|1[0-2])", r"(\d{4})"
_HM = r"(?:[01]\d|2[0-3]):[0-5]\d"
_HMS = _HM + r":[0-5]\d"


def iso_text(c: Column) -> Column:
    """Date-time text in one of the known layouts, rewritten to ISO order; else null.

    The first layout that fits wins: ISO date-time, `yyyy-MM-dd HH:mm[:ss]`, day-first
    with slashes, day-first with dashes, month-first with slashes, then ISO and
    day-first dates. A `T` or `Z` in a value that is not ISO date-time is ignored.
    """
    raw = strip(c)
    return iso_text_of(raw, without_marks(raw))


def without_marks(raw: Column) -> Column:
    """`T` to a space, `Z` dropped."""
    return F.translate(raw, "TZ", " ")


def iso_text_of(raw: Column, plain: Column) -> Column:
    """`iso_text` from the stripped value and the same value `without_marks`."""
    layouts = [
        (plain, rf"^{_Y}-{_M}-{_D} ({_HMS}|{_HM})$", None),
        (raw, rf"^{_Y}-{_M}-{_D}T{_HMS}\.\d{{1,9}}$", None),
        (plain, rf"^{_D}/{_M}/{_Y} ({_HMS})$", "$3-$2-$1 $4"),
        (plain, rf"^{_D}-{_M}-{_Y} ({_HMS})$", "$3-$2-$1 $4"),
        (plain, rf"^{_M}/{_D}/{_Y} ({_HMS})$", "$3-$1-$2 $4"),
        (raw, rf"^{_Y}-{_M}-{_D}$", None),
        (raw, rf"^{_D}/{_M}/{_Y}$", "$3-$2-$1 00:00:00"),
        (raw, rf"^{_D}-{_M}-{_Y}$", "$3-$2-$1 00:00:00"),
    ]
    out = None
    for value, pattern, rewrite in layouts:
        found = value if rewrite is None else F.regexp_replace(value, pattern, rewrite)
        out = F.when(value.rlike(pattern), found) if out is None else out.when(value.rlike(pattern), found)
    return out


def iso_timestamp(iso: Column) -> Column:
    """Timestamp of an `iso_text` value. A day past the end of its month is pulled back
    to the last day (31/02 -> 28/02 or 29/02), except in plain ISO dates and in
    ISO date-times with a fraction, which are refused."""
    month_end = F.last_day(F.concat(F.left(iso, F.lit(7)), F.lit("-01")).try_cast("date"))
    pulled = F.concat(month_end.cast("string"), F.substring(iso, 11, 30)).try_cast("timestamp_ntz")
    return F.coalesce(iso.try_cast("timestamp_ntz"), F.when(F.length(iso).between(16, 19), pulled))


def parse_timestamp(c: Column) -> Column:
    return iso_timestamp(iso_text(c))


def parse_date(c: Column) -> Column:
    return parse_timestamp(c).cast("date")


def parse_direction(c: Column) -> Column:
    word = F.upper(strip(c))
    return F.when(word.isin(CREDIT_WORDS), "CREDIT").when(word.isin(DEBIT_WORDS), "DEBIT")


def parse_rating(c: Column) -> Column:
    word = F.upper(strip(c))
    return F.when(word.isin("MEDIUM", "HIGH"), word).otherwise("LOW")


def normalise_party(c: Column) -> Column:
    """Letters and digits only, upper case; null becomes the empty string."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


# --- display ---------------------------------------------------------------

def money_text(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("INR "), F.format_number(c, 2)), F.lit("INR 0.00"))


def percent_text(ratio: Column) -> Column:
    return F.coalesce(F.concat(F.round(ratio * 100, 1).cast("decimal(30,1)").cast("string"), F.lit("%")), F.lit("0%"))


def multiplier_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.round(value, 1).cast("decimal(30,1)").cast("string"), F.lit("x")), F.lit("0x"))


def timestamp_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMM yyyy HH:mm"), F.lit("unknown"))


def date_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMM yyyy"), F.lit("unknown"))


# --- masking ---------------------------------------------------------------

def _mask_word(word: Column) -> Column:
    return F.concat(F.substring(word, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(word) - 1, F.lit(0))))


def _mask_tail(value: Column) -> Column:
    """Stars for all but the last four characters; four or fewer are all masked."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.repeat(F.lit("*"), F.greatest(n - 4, F.lit(0))), F.right(value, F.lit(4))))


def mask_name(c: Column) -> Column:
    words = F.split(strip(c), r"\s+")
    return F.when(is_blank(c), c).otherwise(F.array_join(F.transform(words, _mask_word), " "))


def mask_identifier(c: Column) -> Column:
    return F.when(is_blank(c), c).otherwise(_mask_tail(strip(c)))


mask_account = mask_identifier


def mask_email(c: Column) -> Column:
    local = F.substring_index(c, "@", 1)
    domain = F.regexp_extract(c, r"(?s)^[^@]*@(.*)$", 1)
    host = F.regexp_extract(domain, r"(?s)^(.+)(\.[^.]*)$", 1)
    tail = F.regexp_extract(domain, r"(?s)^(.+)(\.[^.]*)$", 2)
    masked = F.concat(_mask_word(local), F.lit("@"), _mask_word(F.when(host == "", domain).otherwise(host)), tail)
    return F.when(is_blank(c) | ~F.contains(c, F.lit("@")), mask_identifier(c)).otherwise(masked)


def mask_phone(c: Column) -> Column:
    value = strip(c)
    dash = F.instr(value, "-")
    prefix = F.when(dash > 1, F.left(value, dash)).otherwise("")
    rest = F.when(dash > 1, F.substr(value, dash + 1)).otherwise(value)
    return (
        F.when(is_blank(c), c)
        .when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value)))
        .otherwise(F.concat(prefix, _mask_tail(rest)))
    )


def clip(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def join_non_blank(separator: str, *parts: Column) -> Column:
    kept = [F.when(~is_blank(p), p) for p in parts]
    return F.nullif(F.concat_ws(separator, *kept), F.lit(""))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


# --- keys ------------------------------------------------------------------

def transaction_key(rule: str, txn: Column) -> Column:
    return F.concat_ws("|", F.lit(rule), F.lit("TXN"), txn)


def account_day_key(rule: str, account: Column, ts: Column) -> Column:
    return F.concat_ws("|", F.lit(rule), F.lit("ACCT"), account, ts.cast("date").cast("string"))


def customer_day_key(rule: str, customer: Column, day: Column) -> Column:
    return F.concat_ws("|", F.lit(rule), F.lit("CUST"), customer, day.cast("string"))


def anchor_key(rule: str, account: Column, txn: Column) -> Column:
    return F.concat_ws("|", F.lit(rule), F.lit("ANCH"), account, txn)


def readable_ref(prefix: str, at: Column, key: Column) -> Column:
    """`PREFIX-yyyyMMdd-<24 hex>`: a pure function of the key. 96 bits of hash keep
    the label unique over billions of rows."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(at, "yyyyMMdd"),
                       F.upper(F.left(F.sha2(key, 256), F.lit(24))))


def stand_in_national_id(customer_id: Column) -> Column:
    """`IDN` and eight digits of a hash of the id. The value carries no meaning."""
    number = F.conv(F.left(F.sha2(customer_id, 256), F.lit(12)), 16, 10).cast("long")
    return F.concat(F.lit("IDN"), F.lpad((number % 100_000_000).cast("string"), 8, "0"))


# --- lists and JSON --------------------------------------------------------

def join_ids(ids: Column) -> Column:
    return F.array_join(ids, ",")


def split_ids(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    return F.filter(parts, lambda p: p != "")
