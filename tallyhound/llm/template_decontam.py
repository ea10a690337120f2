"""Benchmark decontamination by template windows. DataFrame expressions only.

Texts become templates: numbers, names (capitals within a sentence) and units are replaced by typed
placeholders. Windows of eight template words of the benchmark are hash-joined with every window of the
documents, so any shared run of eight words meets, if half of them or more are literal. For each meeting the whole item is laid
over the document at that place: `coverage` is the share of its template words that agree, and the slots
must be consistent, that is, every value in the item's slots stands for one value in the document's. Each place
is read by itself, and for items split by an insertion several together; one reading that passes is enough. All of
that is also done on the case-folded texts, with names as literal words there, so an item in capitals or title case is
found; a name of the item may stand for another word between two words that agree, and must do so consistently. So
a question with other numbers and names is found as well as a verbatim one.

Windows with fewer than half literal words are not used. Items that have no other window, and items shorter than a window but
with SHORTEST words or more, are looked for by their words themselves, case-folded: verbatim copies are always found.

Defined cases: null and empty texts match nothing, on either side; items with fewer than SHORTEST words
are common phrases and match nothing; rows that repeat count once per (id, text), items that repeat an id count each text of
it; null ids take part; empty tables give an empty result. Full texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import stored, whole
from tallyhound.operators.skew import checked_side

WINDOW = 8
STRIDE = 1
# Words an item must have to be evidence.
SHORTEST = 4
# Share of an item's words that must agree in their place.
COVERAGE = 0.6
# Benchmark windows, or documents that meet one, that may be sent to every executor; more are joined by shuffle.
BROADCAST_WINDOWS = 200_000
# Unit words, in lower case.
UNITS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons tonnes "
    "ml cl l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees watt watts kw volt volts joule joules mph kph km2 m2 m3").split()
# Placeholders are digits: after the first step no digit is left in a template but these.
NUMBER, NAME, UNIT = "0", "1", "2"
CUT = r"[^\p{L}0-9]+"


def words(text: Column) -> Column:
    """Raw words: runs of letters and digits. A separator inside a number does not cut it."""
    return F.array_remove(F.split(_joined(text), CUT), "")


def _joined(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "")


def folded(text: Column) -> Column:
    """The text without case; by way of capitals, which some small letters share (ß and ss)."""
    # The optimizer would make lower(upper(x)) a mere lower(x).
    return F.lower(F.concat(F.upper(text), F.lit("")))


def template(text: Column, names: bool = True) -> Column:
    """The words in template form, place by place with `words`; names are literal words unless `names`."""
    t = F.regexp_replace(_joined(text), "[0-9]+", NUMBER)
    if names:
        t = F.regexp_replace(t, r"(?<=[\p{L}0-9,;] )\p{Lu}\p{L}*", NAME)
    cut = F.array_remove(F.split(F.lower(t), CUT), "")
    return F.transform(cut, lambda w: F.when(w.isin(UNITS), UNIT).otherwise(w))


def is_slot(word: Column) -> Column:
    return word.rlike("^[012]+$")


def forms(text: Column, t: str, raw: str, one: str, two: str) -> list[Column]:
    """Template and raw words of a text as it stands, and of the folded text."""
    return [template(text).alias(t), words(text).alias(raw), template(folded(text), names=False).alias(one), words(folded(text)).alias(two)]


def windows(d: DataFrame, stride: int, window: int, *keys: str) -> DataFrame:
    """`keys`, `pos`, `w`: fingerprints of the windows that start at multiples of `stride`.

    A fingerprint of n words is made of two of its halves, so a word is hashed once and a window takes
    log2(n) steps. Each step goes through a generator, so that none is computed again inside the next.
    """
    def once(df: DataFrame, h: Column) -> DataFrame:
        return df.select(*keys, F.explode(F.array(h)).alias("h"))

    def joined(ahead: int) -> Column:
        return F.transform("h", lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + ahead)))

    hashed, width = once(d.where(F.size("t") >= window), F.transform("t", lambda w: F.xxhash64(w))), 1
    while width * 2 <= window:
        hashed, width = once(hashed, joined(width)), width * 2
    if width < window:
        hashed = once(hashed, joined(window - width))
    whole_ones = F.slice("h", F.lit(1), F.size("h") - (window - 1))
    return hashed.select(*keys, F.posexplode(whole_ones).alias("i", "w")).where(F.col("i") % stride == 0).select(*keys, F.col("i").cast("long").alias("pos"), "w")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, stride: int = STRIDE, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated (document, item): `doc_id`, `d` (fingerprint of id and text), `item_id`,
    `coverage`, `slots` (item slots laid over the document), `changed` (of those, with another value)."""
    items = whole(benchmark, item_col, item_text_col).distinct().select(
        F.col("_id").alias("item_id"), F.xxhash64("_id", "_text").alias("h"), *forms(F.col("_text"), "t", "raw", "ft", "fraw"))
    # `slot`: the item's slots; `name`: those of the folded template's literal words that are names.
    slot = F.transform("t", is_slot)
    items = items.select("item_id", F.explode(F.array(*(
        F.struct("h", F.xxhash64("h", F.lit(int(fold))).alias("q"), F.lit(fold).alias("fold"), F.col(t).alias("t"), F.col(raw).alias("raw"), slot.alias("slot"))
        for fold, t, raw in ((False, "t", "raw"), (True, "ft", "fraw"))))).alias("x")).select("item_id", "x.*")
    items = items.withColumn("name", F.transform("t", lambda x, i: F.col("fold") & ~is_slot(x) & F.coalesce(F.get("slot", i), F.lit(False))))
    items = items.withColumn("slot", F.transform("t", lambda x, i: is_slot(x) | F.get("name", i)))
    items = stored(items.where(F.size("t") >= min(window, SHORTEST)), "templates")
    literal = F.size(F.filter(F.slice(F.col("t"), F.col("pos") + 1, window), lambda x: ~is_slot(x))) * 2 >= window
    asked = windows(items, 1, window, "q").join(items.select("h", F.col("q").alias("iq"), "fold", "t"), F.col("q") == F.col("iq")).where(literal)
    asked = stored(asked.select("h", "q", "fold", F.size("t").alias("n"), F.col("pos").alias("at"), F.col("w").alias("aw")), "template-windows")
    few = asked.count() <= BROADCAST_WINDOWS

    d = whole(docs, id_col, text_col).select("_id", F.xxhash64("_id", "_text").alias("d"), "_text")
    both = F.explode(F.array(template(F.col("_text")), template(folded(F.col("_text")), names=False))).alias("t")
    held = windows(d.select("d", both), stride, window, "d")
    met = held.join(F.broadcast(asked) if few else asked, F.col("w") == F.col("aw"))
    # `shift`: where the item's first word falls in the document.
    met = met.select("d", "q", "fold", "n", (F.col("pos") - F.col("at")).alias("shift"))
    # Items without a window of that kind, by their folded words; at most `window` sizes of runs.
    plain = items.where("fold").join(asked.select("h"), "h", "left_anti").withColumns({"n": F.size("t"), "size": F.least(F.size("t"), F.lit(window)), "t": F.col("raw")})
    for (size,) in sorted(plain.select("size").distinct().collect()):
        runs = windows(plain.where(F.col("size") == size), 1, size, "q", "n").select("q", "n", F.col("pos").alias("at"), F.col("w").alias("aw"))
        there = windows(d.select("d", words(folded(F.col("_text"))).alias("t")), 1, size, "d")
        met = met.unionByName(there.join(checked_side(runs, BROADCAST_WINDOWS), F.col("w") == F.col("aw")).select(
            "d", "q", F.lit(True).alias("fold"), "n", (F.col("pos") - F.col("at")).alias("shift")))
    laid = stored(met.distinct(), "meetings")

    # Counted, and broadcast only while few documents meet an item; else joined by shuffle.
    asks = checked_side(laid.groupBy(F.col("d").alias("ad")).agg(F.collect_list(F.struct("q", "fold", "n", "shift")).alias("asks")), BROADCAST_WINDOWS)
    text = d.join(asks, F.col("d") == F.col("ad")).groupBy("_id", "d").agg(F.first("_text").alias("_text"), F.first("asks").alias("asks"))
    split = text.select("_id", "d", "asks", *forms(F.col("_text"), "dt", "dw", "fdt", "fdw"))
    # The few documents that meet an item are split once; each meeting keeps only the words under its item.
    def under(words_, folded_, a):
        return F.slice(F.when(a["fold"], F.col(folded_)).otherwise(F.col(words_)), (F.greatest(a["shift"], F.lit(0)) + 1).cast("int"), a["n"])
    over = split.select("_id", "d", F.explode(F.transform("asks", lambda a: F.struct(
        a["q"].alias("q"), a["shift"].alias("shift"), under("dt", "fdt", a).alias("dt"), under("dw", "fdw", a).alias("dw")))).alias("a")).select("_id", "d", "a.*")
    over = over.join(items.select("item_id", F.col("q").alias("iq"), "fold", "t", "raw", "slot", "name"), F.col("q") == F.col("iq"))
    # Places of the item whose template word agrees with the document's, or that are names between such places.
    over = over.withColumn("eq", F.expr("transform(t, (x, i) -> coalesce(get(dt, cast(i + least(shift, 0) as int)) = x, false))"))
    same = F.expr("""
        filter(transform(t, (x, i) -> named_struct('i', i, 'j', cast(i + least(shift, 0) as int))),
               p -> get(eq, p.i) OR (get(name, p.i) AND NOT coalesce(get(dt, p.j) rlike '^[012]+$', true)
                    AND coalesce(get(eq, p.i - 1), true) AND coalesce(get(eq, p.i + 1), true)))""")
    same = F.transform(same, lambda p: F.struct(
        p["i"].alias("i"), F.get("raw", p["i"]).alias("a"), F.get("dw", p["j"]).alias("b"), F.get("slot", p["i"]).alias("slot")))
    # Each place laid by itself, at one shift; items split by an insertion are read over several: those within half
    # an item of each other share one of two ranges of its length, farther ones only the whole document.
    single = over.select("_id", "d", "item_id", "q", "fold", "shift", F.size("t").alias("n"), same.alias("p"))
    key = ["_id", "d", "item_id", "q", "fold", "n"]
    slots = F.filter("p", lambda p: p["slot"])
    one = single.select(
        *key, F.size("p").alias("k"), F.size(slots).alias("slots"),
        F.size(F.array_distinct(F.transform(slots, lambda p: p["a"]))).alias("values"),
        F.size(F.array_distinct(F.transform(slots, lambda p: F.struct(p["a"], p["b"])))).alias("mapped"),
        F.size(F.filter(slots, lambda p: p["a"] != p["b"])).alias("changed"))
    spread = F.array(
        F.struct(F.lit(0).alias("part"), F.floor(F.col("shift") / F.col("n")).alias("range")),
        F.struct(F.lit(1), F.floor(F.col("shift") / F.col("n") + 0.5)), F.struct(F.lit(2), F.lit(0).cast("long")))
    agreed = single.select(*key, F.explode("p").alias("p"), spread.alias("g")).select(*key, "p", F.explode("g").alias("g"))
    # One place may agree at several shifts; the first reading in order of value counts.
    place_ = agreed.groupBy(*key, "g", "p.i").agg(F.min(F.struct("p.a", "p.b", "p.slot")).alias("p"))
    value = F.when(F.col("p.slot"), F.col("p.a"))
    merged = place_.groupBy(*key, "g").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("p.slot").cast("int")).alias("slots"), F.count_distinct(value).alias("values"),
        F.count_distinct(F.when(F.col("p.slot"), F.struct("p.a", "p.b"))).alias("mapped"),
        F.sum((F.col("p.slot") & (F.col("p.a") != F.col("p.b"))).cast("int")).alias("changed")).drop("g")
    out = one.unionByName(merged).where((F.col("k") >= coverage * F.col("n")) & (F.col("mapped") == F.col("values")))
    # The reading as it stands goes first, then the folded one.
    best = out.groupBy("_id", "d", "item_id", "fold").agg(
        F.max(F.col("k") / F.col("n")).alias("coverage"), F.max("slots").cast("long").alias("slots"), F.min("changed").cast("long").alias("changed"))
    return best.groupBy(F.col("_id").alias("doc_id"), "d", "item_id").agg(F.min(F.struct("fold", "coverage", "slots", "changed")).alias("b")).select(
        "doc_id", "d", "item_id", "b.coverage", "b.slots", "b.changed")
