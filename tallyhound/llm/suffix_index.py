"""Removal of repeated byte strings with a logarithmic family of sampled suffix arrays.

Documents come in batches. Each batch gets an array of its sampled suffixes in key order (see
`suffixes`); it is merge-scanned against the levels that exist, which yields the suffixes that occur
again, and levels of equal size merge, so a suffix is rewritten a logarithmic number of times.

What the scans find is then decided exactly. An anchor whose whole context occurs elsewhere has all of
its 200-byte strings repeated. Where contexts differ, at the ends of repeats, the contexts of a suffix
are brought together and their strings compared one by one; a suffix with very many different
contexts shuffles its strings by their own fingerprints instead, so no group grows without bound. A
string is equal to another where 128 bits of fingerprint and the suffix key are.

Defined cases: a null text is empty; texts under 200 bytes keep everything; every row is a document of its
own, whatever its id, so rows that repeat id and text lose their text whole, as copies do (the index holds
it once, for the others to meet); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm import suffixes, words
from tallyhound.llm.common import reach_workers, stored, whole
from tallyhound.llm.suffixes import KEY, MATCH

# Batches a table is fed to the index in.
BATCHES = 4
# Contexts compared in one task, about; suffixes with more shuffle their strings.
CONTEXTS = 20_000


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`d` (fingerprint of id and text), `_id`, `_text`."""
    d = whole(docs, id_col, text_col)
    return d.select(F.xxhash64("_id", "_text").alias("d"), "_id", "_text")


def sampled(docs: DataFrame, match: int, width: int) -> DataFrame:
    """One row per anchor: `d`, `pos` (place and reach, packed), `key`, `ctx`."""
    d = docs.select("d", "_text")
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in words.chunks(b.column(1)):
                a = suffixes.anchors(part, match, width)
                pos = (a["at"] << 20) | ((a["at"] - a["lo"]) << 10) | (a["at"] - a["hi"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)).take(pa.array(a["text"])), pa.array(pos), words.signed(a["key"]), words.signed(a["ctx"])],
                    ["d", "pos", "key", "ctx"])
                at += len(part)

    return d.mapInArrow(run, "d long, pos long, key long, ctx long")


AT, LO, HI = "shiftright(pos, 20)", "shiftright(pos, 20) - (shiftright(pos, 10) & 1023)", "shiftright(pos, 20) - (pos & 1023)"


class SuffixFamily:
    """Levels of suffix arrays, each a stored table (key, n) in key order."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Take a batch of anchors in: build its array, scan it against the levels, merge equal ones.

        The scan against a level that is merged falls out of the merge."""
        size, parts = 1, [batch.select("key", F.lit(1).cast("long").alias("n"))]
        while self.levels and self.levels[-1][0] == size:
            parts.append(self.levels.pop()[1])
            size *= 2
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        level = stored(rows.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), f"suffix-level-{size}")
        self.found.append(level.where("n > 1").select("key"))
        self.found += [other.select("key").join(level.select("key"), "key", "left_semi") for _, other in self.levels]
        self.levels.append((size, level))

    def repeated(self) -> DataFrame:
        """Keys of the suffixes that occur more than once in the family."""
        out = self.found[0]
        for f in self.found[1:]:
            out = out.unionByName(f)
        return out.distinct() if len(self.found) > 1 else out


def strings(contexts: list[bytes], count: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, two fingerprints) of every string of these contexts."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    first = np.cumsum([0, *map(len, contexts)])[:-1]
    row = np.repeat(np.arange(len(contexts)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = first[row] + place
    return row, place, *(suffixes.Fingerprints(data, w).of(at, at + match) for w in (0, 1))


def compare(pdf: pd.DataFrame, match: int) -> pd.DataFrame:
    """Spans of the contexts' strings that occur in another context of the task's rows.

    Equal strings have equal keys, so both are here."""
    lo, hi = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
    row, place, a, b = strings(pdf["bytes"].tolist(), hi - lo + 1, match)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    hit = np.zeros(len(row), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hit &= pdf["loose"].to_numpy()[row]
    row, place = row[hit], place[hit]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(row)) - 1
    if not len(row):
        closes = opens
    return pd.DataFrame({"d": pdf["d"].to_numpy()[row[opens]], "start": lo[row[opens]] + place[opens], "stop": lo[row[opens]] + place[closes] + match})


def repeats(docs: DataFrame, batches: int = BATCHES, match: int = MATCH, width: int = KEY, contexts: int = CONTEXTS) -> DataFrame:
    """`d`, `start`, `stop`: stretches made of strings of `match` bytes that also start elsewhere.
    `docs` has d, _id and _text, one row per document."""
    anchors = stored(sampled(docs, match, width).withColumn("batch", F.pmod("d", F.lit(batches)).cast("int")), "anchors")
    family = SuffixFamily()
    for b in range(batches):
        family.add(anchors.where(F.col("batch") == b))
    # Join sides that are aggregates are written first: adaptive execution splits a hot key only
    # between two plain shuffles.
    again = stored(family.repeated().select(F.col("key").alias("k")), "repeated-keys")
    matched = stored(anchors.drop("batch").join(again, F.col("key") == F.col("k"), "left_semi"), "matched")

    # Contexts that occur more than once settle all their anchors.
    states = stored(matched.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "pos")).alias("rep")), "contexts")
    settled = states.where("n > 1").select(F.col("key").alias("k"), F.col("ctx").alias("c"))
    solid = matched.join(settled, (F.col("key") == F.col("k")) & (F.col("ctx") == F.col("c"))).select(
        "d", F.expr(LO).alias("start"), (F.expr(HI) + match).alias("stop"))

    # Suffixes with several contexts, one of them single, need their strings compared.
    open_keys = stored(states.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where(
        "m > 1 AND least = 1").select(F.col("key").alias("k"), "m"), "open-keys")
    probe = stored(states.join(open_keys, F.col("key") == F.col("k")).select(
        "key", "m", (F.col("n") == 1).alias("loose"), F.col("rep.d").alias("pd"), F.col("rep.pos").alias("pos")), "probes")
    asked = probe.groupBy("pd").agg(F.collect_list(F.struct(
        "key", "m", "loose", F.expr(LO).alias("lo"), F.expr(HI).alias("hi"))).alias("asks"))
    texts = docs.select("d", "_text").join(asked, F.col("d") == F.col("pd")).drop("pd")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in range(b.num_rows):
                raw = b.column(1)[r].as_py().encode()
                asks = b.column(2)[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[r].as_py()] * len(asks), pa.int64()), *[pa.array([x[k] for x in asks], t) for k, t in (
                        ("key", pa.int64()), ("m", pa.int64()), ("loose", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64()))],
                     pa.array([raw[x["lo"]:x["hi"] + match] for x in asks], pa.binary())],
                    ["d", "key", "m", "loose", "lo", "hi", "bytes"])

    held = stored(texts.mapInArrow(cut, "d long, key long, m long, loose boolean, lo long, hi long, bytes binary"), "strings")
    deals = max(1, probe.count() // max(1, contexts // 2))
    spans = "d long, start long, stop long"
    few = held.where(F.col("m") <= contexts).withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(deals)))
    compared = few.groupBy("deal").applyInPandas(lambda pdf: compare(pdf, match), spans)

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            lo, hi = (np.asarray(b.column(c)) for c in ("lo", "hi"))
            if b.num_rows:
                row, place, x, y = strings(b.column("bytes").to_pylist(), hi - lo + 1, match)
                yield pa.RecordBatch.from_arrays(
                    [b.column("d").take(pa.array(row)), pa.array(lo[row] + place), b.column("loose").take(pa.array(row)), words.signed(x), words.signed(y)],
                    ["d", "start", "loose", "x", "y"])

    many = held.where(F.col("m") > contexts).mapInArrow(spread, "d long, start long, loose boolean, x long, y long")
    twice = many.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("x").alias("tx"), F.col("y").alias("ty"))
    shuffled = many.where("loose").join(twice, (F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty"))).select(
        "d", "start", (F.col("start") + match).alias("stop"))
    return solid.unionByName(compared).unionByName(shuffled)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, match: int = MATCH,
           width: int = KEY, contexts: int = CONTEXTS) -> DataFrame:
    """One row per input row: `doc_id`, `n_bytes`, `spans` (removed stretches, byte offsets) and
    `kept` (the bytes that remain)."""
    rows = documents(docs, id_col, text_col)
    again = stored(repeated_rows(rows, match), "repeated-rows")
    once = rows if again.isEmpty() else rows.dropDuplicates(["d"])
    found = stored(repeats(once, batches, match, width, contexts).unionByName(again), "repeats")
    spans = found.groupBy("d").agg(F.collect_list(F.struct("start", "stop")).alias("s")).select(F.col("d").alias("sd"), "s")
    joined = rows.join(spans, F.col("d") == F.col("sd"), "left").select("_id", "_text", "s")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            size, cuts, kept = [], [], []
            for text, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                runs: list[list[int]] = []
                for a, z in sorted((x["start"], x["stop"]) for x in s or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([a, z])
                ends = [0, *[x for r in runs for x in r], len(raw)]
                size.append(len(raw))
                cuts.append([{"start": a, "stop": z} for a, z in runs])
                kept.append(b"".join(raw[a:z] for a, z in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(cuts, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def repeated_rows(rows: DataFrame, match: int) -> DataFrame:
    """`d`, `start`, `stop`: the whole of each document whose row is there more than once. All its strings
    start in the other row too."""
    counted = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("_text")).cast("long").alias("stop"))
    return counted.where((F.col("n") > 1) & (F.col("stop") >= match)).select("d", F.lit(0).cast("long").alias("start"), "stop")
