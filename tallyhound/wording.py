"""The wording of findings and report drafts, and the filling-in of its blanks.

Readers and downstream systems compare these texts, so they are values, not style. Blanks are
written as {name}.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **blanks: Column | str | int) -> Column:
    """The template with its blanks filled in by columns or plain values; null if a column is."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = blanks[name]
            parts.append(value if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


# --- fixed values: explanations of findings --------------------------------

THRESHOLD = (
    "Transaction {txn} ({amount}, {time}) on account {account} met or exceeded the {limit} reporting threshold and is "
    "automatically flagged for review.")
LISTED = (
    "Transaction {txn} ({amount}, {time}) on account {account} {place}{party}"
    "Business rule 4 requires an alert regardless of transaction value.")
LISTED_PLACE = "involves {country}, listed as {category} (source: {source}). "
LISTED_PLACE_SOURCE = "internal list"
LISTED_PARTY = "Counterparty '{name}' appears on the {kind} watchlist{note}. "
LISTED_NOTE = " — {note}"
STRUCTURING = (
    "{count} transactions totalling {total} were made on account {account} within {hours} hours ({start} to {end}). Each fell "
    "between {low} and {high} — individually below the reporting threshold, consistent with deliberate structuring to avoid it.")
ROUND_AMOUNTS = (
    "{count} transactions on account {account} within {hours} hours were exact multiples of {unit}, totalling {total}. Repeated "
    "round-number amounts suggest values chosen rather than arising from genuine commercial activity.")
RAPID_MOVEMENT = (
    "{share} of a {amount} deposit (transaction {txn} received {time}) left account {account} within {hours} hours, across {count} "
    "outbound transaction(s) totalling {total}. Funds passing straight through an account is consistent with layering.")
DEVIATION = (
    "Customer {customer} transacted {total} across {count} transaction(s) on {day} — {multiple} their {days}-day rolling average of "
    "{average} per day. A sudden departure from an established pattern is a behavioural indicator of account misuse.")

# --- fixed values: report drafts -------------------------------------------

NOT_FILED = "This draft should NOT be filed; it is retained for audit purposes only."
RECOMMENDATIONS = {
    None: "Case is not yet disposed. Complete the investigation and record a disposition before filing; this draft is provisional.",
    "ESCALATED_TO_SAR": (
        "File this report with the Financial Intelligence Unit within the statutory deadline. Apply enhanced monitoring to the "
        "subject's remaining accounts and refer for a relationship review."),
    "TRUE_POSITIVE": "Suspicion confirmed by the analyst but not yet escalated for filing. Refer to a senior analyst for a filing decision.",
    "FALSE_POSITIVE": "The analyst assessed this activity as a false positive. " + NOT_FILED,
    "CLEARED_NO_ACTION": "The analyst cleared this activity with no action. " + NOT_FILED,
}
RECOMMENDATION_OTHERWISE = "Review the case disposition before deciding whether to file."

ON_DAY = "on {day}"
BETWEEN_DAYS = "between {first} and {last}"
OPENING = "{institution} is reporting suspicious activity identified on "
OPENED = (
    " held by {name} (customer reference {customer}). The activity was detected by the bank's automated transaction monitoring "
    "system {period} and comprises {count} transaction(s) with an aggregate value of {total}.")
NO_ACCOUNT = "accounts held at this institution"
SUBJECT = (
    "\n\nSUBJECT: {name}, national identifier {identifier}{born}{address}{occupation}. The customer has been with the institution "
    "since {since} and is classified {rating} risk with KYC status {kyc}.{exposed}")
NO_IDENTIFIER, NO_DATE = "not recorded", "an unrecorded date"
BORN, RESIDENT, OCCUPATION = ", date of birth {value}", ", resident at {value}", ". Stated occupation: {value}"
EXPOSED = " The subject is a POLITICALLY EXPOSED PERSON, which requires enhanced scrutiny of the activity described below."
ACTIVITY = (
    "\n\nSUSPICIOUS ACTIVITY: the monitoring system raised {count} alert(s) against this customer, the highest scoring {score} out of "
    "100. The activity is consistent with the following typolog{ending}: {kinds}. Each finding is set out below, with the supporting "
    "transactions listed in the accompanying schedule.")
FINDING = "\n\nFINDING {ref} ({rule}, risk score {score}, severity {severity}): {explanation}"
ONE_BASIS, BASES = "the finding set out above", "the {count} findings set out above, taken together"
CONCLUSION = (
    "\n\nCONCLUSION: on the basis of {basis}, the activity has no apparent lawful purpose or economic rationale consistent with the "
    "customer's known profile, and the bank is unable to satisfy itself as to the legitimate origin or destination of the funds. This "
    "report is submitted for the attention of the Financial Intelligence Unit. No account has been closed and no funds have been "
    "frozen at the time of filing; the bank awaits guidance. All supporting records are retained and available on request.")
DRAFT_AUDIT = "SAR draft {draft} generated over {alerts} alert(s) and {transactions} transaction(s)"
