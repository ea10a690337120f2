"""Host-level quality rules.

Every document is measured, rule failures are summed per host, each host's failure rates are
shrunk towards a beta prior fitted to all hosts, and hosts whose shrunk rate is surely above a
limit are rejected; the verdict is joined back to the host's documents. DataFrame expressions only.

Defined cases: a null or empty text has no words and fails the base rules; a null host is one
host of its own; repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import BLANKS, stored

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
# A document fails these when ...
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# A host goes when the lower end of its shrunk rate (this many deviations down) is above the limit.
RATE_LIMIT = 0.5
DEVIATIONS = 1.645
# Weight of the prior, in documents: where hosts do not differ at all, and at least.
FLAT_PRIOR = 100.0
LEAST_PRIOR = 2.0


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """`doc_id`, `host` and the measures of every row.

    `n_repeat_words` counts the words inside 3-word windows that occur at least twice in
    the text: equal windows meet by sorting (fingerprint, position), then the positions
    are merged into covered words. Texts without a repeated window skip that.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.array_remove(F.split(text, BLANKS), "").alias("w"), F.split(text, "\n").alias("ls"),
        F.length(F.translate(text, BLANK_CHARS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"))
    d = d.select(
        "doc_id", "host", F.size("w").alias("n_words"), "word_chars", "n_symbols",
        F.filter("ls", lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("ls"),
        F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("w") - 3),
                        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("t"))
    d = d.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        F.size("ls").alias("n_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("t")) < F.size("t"),
               F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    twin = (F.transform("s", lambda x, k: F.when(
        ((k > 0) & (F.get("s", F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
        | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)), x["i"])))
    covered = F.aggregate(
        F.array_sort(F.array_compact(twin)),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]
    longs = {"n_repeat_words": F.coalesce(covered, F.lit(0))}
    return d.withColumns(longs).select(
        "doc_id", "host", *[F.col(m).cast("long") for m in [*MEASURES, "n_lines"]])


def host_rates(m: DataFrame) -> DataFrame:
    """One row per host and rule: documents, failures, shrunk rate, verdict."""
    failures = m.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(c).cast("long")).alias(r) for r, c in RULES.items()])
    rates = failures.select("host", "n", F.explode(F.create_map(
        *[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "failed"))
    share = F.col("failed") / F.col("n")
    prior = rates.groupBy("rule").agg(F.avg(share).alias("mean"), F.coalesce(F.var_samp(share), F.lit(0.0)).alias("var"))
    spread = F.col("mean") * (1 - F.col("mean"))
    weight = F.when((F.col("var") <= 0) | (spread <= 0), F.lit(FLAT_PRIOR)).otherwise(
        F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(FLAT_PRIOR), spread / F.col("var") - 1)))
    prior = prior.select(F.col("rule").alias("r"), "mean", weight.alias("weight"))
    a = F.col("failed") + F.col("mean") * F.col("weight")
    n = F.col("n") + F.col("weight")
    shrunk = rates.join(prior, F.col("rule") == F.col("r")).select("host", "rule", "n", "failed", (a / n).alias("rate"), n.alias("w"))
    low = F.col("rate") - DEVIATIONS * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("w") + 1))
    return shrunk.select("host", "rule", "n", "failed", "rate", (low > RATE_LIMIT).alias("rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every row's measures, `base_failed`, `host_rejected` and `kept`."""
    m = stored(measured(docs, id_col, text_col, host_col), "host-rules")
    # Written first: adaptive execution splits a hot host only between two plain shuffles.
    hosts = stored(host_rates(m).groupBy(F.col("host").alias("h")).agg(F.bool_or("rejected").alias("host_rejected")), "host-verdicts")
    base = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    return m.join(hosts, m["host"].eqNullSafe(hosts["h"]), "left").select(
        "doc_id", *MEASURES, base.alias("base_failed"), "host_rejected",
        (~base & ~F.coalesce(F.col("host_rejected"), F.lit(False))).alias("kept"))
