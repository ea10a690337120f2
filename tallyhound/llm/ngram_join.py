"""Jaccard self-join on word n-grams by MinHash banding.

Every text gets a MinHash signature of its 5-word shingles, cut into bands whose number and length are
chosen for a recall at the threshold. Texts shuffle on band hashes; a bucket links each of its texts to its
least one, never all pairs. Connected texts form a candidate group, and every pair inside a group is
verified on the full shingle sets: a small group in one task, a large one as pairs of blocks of
bounded size. Only counts and one edge per text leave a task, so no pair table exists.

Copies (equal word sequences) are one class from the start and are counted, not paired.

Defined cases: texts without words (null included) are copies of one another and have no other link;
texts of fewer than five words have their whole word sequence as only shingle; rows that repeat count as
copies; null ids take part, and a class id is the least id that is not null; an empty table gives
an empty result. Full texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm import words
from tallyhound.llm.common import reach_workers, stored, whole
from tallyhound.llm.graph import components

THRESHOLD = 0.8
RECALL = 0.9995
# Hashes of a signature, at most.
HASHES = 128
# Texts and words of a verification block, about.
BLOCK_TEXTS = 700
BLOCK_WORDS = 1_000_000
U32 = np.uint32


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows of a band): the longest bands that reach the recall for a pair right at the
    threshold with at most `most` hashes. An error where none does."""
    best = None
    for rows in range(1, most + 1):
        bands = np.ceil(np.log(1 - recall) / np.log1p(-threshold ** rows))
        if bands * rows > most:
            break
        best = (int(bands), rows)
    if best is None:
        raise ValueError(f"no bands of at most {most} hashes find pairs at {threshold} with a recall of {recall}")
    return best


def band_hashes(sh: np.ndarray, made: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes; texts without shingles get zeros."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**32, bands * rows, U32) | U32(1)
    b = rng.integers(0, 2**32, bands * rows, U32)
    full = np.flatnonzero(made)
    out = np.zeros((len(made), bands), np.uint64)
    if len(full):
        starts = (np.cumsum(made) - made)[full]
        low = (sh >> np.uint64(32)).astype(U32)
        for i in range(bands):
            key = np.full(len(full), i + 1, np.uint64)
            for j in range(i * rows, (i + 1) * rows):
                key = words.mix(key * words.BASE + np.minimum.reduceat(low * a[j] + b[j], starts))
            out[full, i] = key
    return out


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: `_id`, `h` (fingerprint of the text), `c` (key of the word sequence), `n` words, `bands`."""
    d = whole(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("h"), "_text")
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in words.chunks(b.column(2)):
                hashes, counts = words.word_hashes(part)
                c1, c2 = words.sequence_keys(hashes, counts)
                keys = band_hashes(*words.shingles(hashes, counts), bands, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)), words.signed(keys[counts > 0].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), b.column(1).slice(at, len(part)), words.signed(c1), words.signed(c2), pa.array(counts.astype(np.int64)), lists],
                    ["_id", "h", "c1", "c2", "n", "bands"])
                at += len(part)

    kind = d.schema["_id"].dataType.simpleString()
    out = d.mapInArrow(run, f"_id {kind}, h long, c1 long, c2 long, n long, bands array<long>")
    return out.select("_id", "h", F.struct("c1", "c2").alias("c"), "n", "bands")


def verified(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links among the texts of each group (column `root`) in one task's rows.

    For a pair of blocks (x < y) only pairs across count. Per text: links, links weighted by
    copies, and the least text its verified links lead to within the task.
    """
    pdf = pdf.drop_duplicates(["c1", "c2", "r1", "r2"]).sort_values(["r1", "r2", "c1", "c2"], kind="stable").reset_index(drop=True)
    hashes, counts, made = [], [], []
    for part in words.chunks(pa.array(pdf["_text"], pa.large_string())):
        h, c = words.word_hashes(part)
        s, m = words.shingles(h, c)
        hashes.append(s)
        made.append(m)
    made = np.concatenate(made)
    sh = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(pdf)), made)
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    sh, owner = sh[new], owner[new]
    size = np.bincount(owner, minlength=len(pdf)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    r1, r2 = pdf["r1"].to_numpy(), pdf["r2"].to_numpy()
    cuts = np.flatnonzero((np.diff(r1) != 0) | (np.diff(r2) != 0)) + 1
    copies, block = pdf["copies"].to_numpy(float), pdf["block"].to_numpy()
    across = (pdf["x"] != pdf["y"]).to_numpy()
    links, weighted, label = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
        m = hi - lo
        if m < 2:
            continue
        own, doc = sh[first[lo]:first[hi]], owner[first[lo]:first[hi]] - lo
        _, ids, n = np.unique(own, return_inverse=True, return_counts=True)
        shared = n > 1
        col = (np.cumsum(shared) - 1)[ids]
        keep = shared[ids]
        doc, col = doc[keep], col[keep]
        order = np.argsort(col, kind="stable")
        doc, col = doc[order], col[order]
        both = np.zeros((m, m), np.float32)
        total, step = int(shared.sum()), 2048
        for at in range(0, total, step):
            a, b = np.searchsorted(col, (at, at + step))
            x = np.zeros((m, min(step, total - at)), np.float32)
            x[doc[a:b], col[a:b] - at] = 1
            both += x @ x.T
        s = size[lo:hi].astype(np.float64)
        near = both * (1 + threshold) >= threshold * (s[:, None] + s[None, :]) - 1e-6
        np.fill_diagonal(near, False)
        if across[lo]:
            near &= block[lo:hi][:, None] != block[lo:hi][None, :]
        links[lo:hi] = near.sum(1)
        weighted[lo:hi] = near @ copies[lo:hi]
        lab = np.arange(m, dtype=np.int32)
        while True:
            nxt = np.minimum(lab, np.where(near, lab[None, :], np.int32(m)).min(1))
            if (nxt == lab).all():
                break
            lab = nxt
        label[lo:hi] = lab + lo
    c1, c2 = pdf["c1"].to_numpy(), pdf["c2"].to_numpy()
    return pd.DataFrame({"c1": c1, "c2": c2, "links": links, "weighted": weighted, "l1": c1[label], "l2": c2[label], "final": ~across & (pdf["blocks"] == 1).to_numpy()})


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id`, `h`, `class_id` (least id of the documents it is linked with,
    directly or through others), `n_copies` (rows of its own word sequence), `n_text_links` (different
    texts at or above the threshold) and `n_links` (other rows at or above it, copies included)."""
    bands, rows = choose_bands(threshold, recall)
    sig = stored(signatures(docs, bands, rows, id_col, text_col), "signatures")
    texts = stored(sig.groupBy("c").agg(
        F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("h"))).alias("rep"),
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    held = texts.select("c", F.explode("bands").alias("b"))
    # Aggregates are written before they are joined: adaptive execution splits a hot key only between
    # two plain shuffles.
    heads = stored(held.groupBy("b").agg(F.min("c").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("b").alias("hb"), "head"), "band-heads")
    edges = held.join(heads, F.col("b") == F.col("hb")).where("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b"))
    group = components(edges)

    # Verification blocks.
    member = stored(group.join(texts.drop("bands"), F.col("node") == F.col("c")).select("c", "root", "rep", "copies", "n"), "members")
    size = stored(member.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks")).select(F.col("root").alias("r"), "blocks"), "group-sizes")
    total = member.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    deals = max(1, int(total // (BLOCK_WORDS // 4)))
    x = F.expr("transform(sequence(0, blocks - 1), i -> struct(least(i, block) AS x, greatest(i, block) AS y))")
    placed = (
        member.join(size, F.col("root") == F.col("r"))
        .withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("xy", F.explode(x))
        .withColumn("deal", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(deals))).otherwise(F.xxhash64("root", "xy")))
        .select("deal", F.col("rep._id").alias("rid"), F.col("rep.h").alias("rh"), F.col("c.c1"), F.col("c.c2"), F.col("root.c1").alias("r1"),
                F.col("root.c2").alias("r2"), "copies", "block", "blocks", F.col("xy.x"), F.col("xy.y")))
    d = whole(docs, id_col, text_col).withColumn("h", F.xxhash64("_text"))
    with_text = d.join(placed, d["_id"].eqNullSafe(placed["rid"]) & (d["h"] == placed["rh"])).drop("_id", "h", "rid", "rh")
    checked = stored(
        with_text.groupBy("deal", "x", "y").applyInPandas(
            lambda pdf: verified(pdf, threshold), "c1 long, c2 long, links long, weighted long, l1 long, l2 long, final boolean"), "verified")
    checked = checked.select(F.struct("c1", "c2").alias("c"), F.struct(F.col("l1").alias("c1"), F.col("l2").alias("c2")).alias("l"), "links", "weighted", "final")
    linked = checked.groupBy(F.col("c").alias("lc")).agg(F.sum("links").alias("links"), F.sum("weighted").alias("weighted"))
    # Groups of one block have their classes already; those of several are connected by their edges.
    spread = components(checked.where("NOT final").select(F.col("c").alias("a"), F.col("l").alias("b")))
    classes = checked.where("final").select(F.col("c").alias("node"), F.col("l").alias("root")).unionByName(spread)
    named = stored(texts.select("c", "rep", "copies").join(classes, F.col("c") == F.col("node"), "left").join(linked, F.col("c") == F.col("lc"), "left").select(
        "c", "rep", "copies", F.coalesce("root", "c").alias("root"), F.coalesce("links", F.lit(0)).alias("n_text_links"),
        (F.coalesce("weighted", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named-texts")
    least = stored(named.groupBy("root").agg(F.min("rep").alias("first")).select(F.col("root").alias("r"), "first"), "class-heads")
    named = stored(named.join(least, F.col("root") == F.col("r")).select(F.col("c").alias("tc"), "first", "copies", "n_text_links", "n_links"), "classes")
    return sig.select("_id", "h", "c").join(named, F.col("c") == F.col("tc")).select(
        F.col("_id").alias("doc_id"), "h", F.col("first._id").alias("class_id"), F.col("first.h").alias("class_h"),
        F.col("copies").alias("n_copies"), "n_text_links", "n_links")
