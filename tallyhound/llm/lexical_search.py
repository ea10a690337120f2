"""Ranked lexical search over norm buckets.

Terms are runs of letters, digits and characters beyond ASCII, ASCII letters in lower case. A query's
vector counts its terms; a document's impact vector holds, for every term that some query asks, weight
times saturated frequency. The score is their product, in 64-bit integers:

    w(t) = floor(1000 ln((2 N + 2) / (2 df + 1))),  impact = w * ((10^9 tf) div (1000 tf + 12 m)),
    m = 100 - 25 + (25 n N) div L

with N documents that have a term, L their terms, n those of one document.

Documents are taken in buckets by falling length (Euclidean norm) of their impact vectors. The longest
ones are scored first; the k-th best score among them is the threshold of a query everywhere. By
Cauchy-Schwarz, a bucket whose longest vector times the query's length stays below the threshold is
skipped with all that follow; a bucket is skipped as well if the product of the query with the bucket's
largest coordinates stays below. Inside a bucket the query's heaviest coordinates are read exactly and the
rest is bounded by the lengths of what remains; documents that may still reach the threshold are scored
exactly, in integers. Bounds are widened by more than their rounding errors, and a document is dropped only
strictly below the threshold, so the result is exact.

Queries are taken in blocks of at most BLOCK_ITEMS items and BLOCK_TERMS terms (one item may have more),
each of which is sent to every executor and reads the documents once. Documents that share no term with
a block keep only their length; a task keeps k documents per query.

Defined cases: a null or empty text has no terms; such documents count nowhere and such items have no
answer; each row is a document of its own, also one that repeats another; items that repeat id and text
count once, items that share an id but not the text are ranked each; equal scores go by ascending
document id, null ids last; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import reach_workers, stored, whole
from tallyhound.llm.spans import TERM_BYTES, sorted_lookup, tokens
from tallyhound.llm.words import chunks

TOP = 20
BLOCK_ITEMS = 2_000
BLOCK_TERMS = 200_000
# Documents scored first, for the thresholds; those of the same length step come with them.
SEEDS = 4_096
# Documents of one bucket, and the query coordinates read exactly before the others are bounded.
BUCKET = 512
FOCUS = 6
# Groups in which the tasks' best documents of a query are merged before the last step.
MERGE = 32


@dataclass(frozen=True)
class Block:
    """Queries in compressed rows: query i has terms `term[cut[i]:cut[i + 1]]`, `times` each."""
    hashes: np.ndarray   # of the terms, rising
    cut: np.ndarray
    term: np.ndarray
    times: np.ndarray


@dataclass(frozen=True)
class Corpus:
    """What the scores of a block need of all documents."""
    weight: np.ndarray   # of each of the block's terms
    n_docs: int
    n_terms: int


def item_blocks(items: list[Row] | Iterator[Row]) -> Iterator[tuple[Block, list]]:
    """(queries, their item ids) in blocks of bounded size."""
    ids, bags, size = [], [], 0
    for r in items:
        t = tokens(pa.array([r["_text"]], pa.string()), TERM_BYTES)
        if not len(t.hashes):
            continue
        found, times = np.unique(t.hashes, return_counts=True)
        if ids and (len(ids) == BLOCK_ITEMS or size + len(found) > BLOCK_TERMS):
            yield _block(bags), ids
            ids, bags, size = [], [], 0
        ids.append(r["_id"])
        bags.append((found, times))
        size += len(found)
    if ids:
        yield _block(bags), ids


def _block(bags: list[tuple[np.ndarray, np.ndarray]]) -> Block:
    hashes = np.unique(np.concatenate([h for h, _ in bags]))
    cut = np.concatenate([[0], np.cumsum([len(h) for h, _ in bags])])
    return Block(hashes, cut, np.searchsorted(hashes, np.concatenate([h for h, _ in bags])), np.concatenate([n for _, n in bags]))


def term_counts(docs: DataFrame, block: Block) -> DataFrame:
    """`_id`, `n` (all terms of a document), `terms` and `tf` (those the block asks) of every
    document that has a term."""
    reach_workers(docs.sparkSession)
    hashes = docs.sparkSession.sparkContext.broadcast(block.hashes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for part in chunks(b.column(1)):
                t = tokens(part, TERM_BYTES)
                at = sorted_lookup(hashes.value, t.hashes)
                hit = at >= 0
                pair, tf = np.unique(t.owner[hit] * len(hashes.value) + at[hit], return_counts=True)
                doc, term = np.divmod(pair, max(len(hashes.value), 1))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(part)))]), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(part)), pa.array(t.counts, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))],
                    ["_id", "n", "terms", "tf"])
                done += len(part)
                yield out.filter(pa.array(t.counts > 0))

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").mapInArrow(read, f"_id {kind}, n long, terms array<int>, tf array<int>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def corpus_of(counted: DataFrame, block: Block) -> Corpus:
    """Document counts; at most as many rows as the block has terms come back."""
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(len(block.hashes), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return Corpus(np.array([term_weight(total["n"], int(x)) for x in df], np.int64), total["n"], int(total["l"]))


def impacts(n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, c: Corpus) -> np.ndarray:
    """Impact of every (document, term); `size` is the number of terms of each document."""
    m = 100 - 25 + (25 * n * c.n_docs) // c.n_terms
    return c.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, size)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of them in each row) of a list column."""
    return np.asarray(column.flatten()).astype(np.int64), np.diff(np.asarray(column.offsets))


def lengths(block: Block) -> np.ndarray:
    """Euclidean length of every query."""
    return np.sqrt(np.add.reduceat(block.times.astype(float) ** 2, block.cut[:-1]))


class Searcher:
    """Keeps the best `top` documents of every query while buckets of documents go by."""

    def __init__(self, block: Block, top: int, least: np.ndarray | None = None):
        self.block, self.top = block, top
        n = len(block.cut) - 1
        self.best: list[list[tuple]] = [[] for _ in range(n)]
        # A document counts only with a score of at least this.
        self.least = np.ones(n, np.int64) if least is None else least.copy()
        self.length = lengths(block)
        self.scored = 0

    def add(self, ids: list, norm: np.ndarray, size: np.ndarray, term: np.ndarray, x: np.ndarray) -> None:
        """Some documents, in any order: length, and impacts by term, of each."""
        start = np.concatenate([[0], np.cumsum(size)])
        by_length = np.argsort(-norm, kind="stable")
        for at in range(0, len(norm), BUCKET):
            rows = by_length[at:at + BUCKET]
            reach = self.length * norm[rows[0]] * (1 + 1e-9) + 1
            asked = np.flatnonzero(reach >= self.least)
            if not len(asked):
                return
            where = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
            self._bucket(asked, [ids[r] for r in rows], norm[rows], np.repeat(np.arange(len(rows)), size[rows]), term[where], x[where])

    def _bucket(self, asked, ids, norm, doc, term, x) -> None:
        order = np.argsort(term, kind="stable")
        doc, term, x = doc[order], term[order], x[order]
        terms, first = np.unique(term, return_index=True)
        if not len(terms):
            return
        ends = np.append(first[1:], len(term))
        largest = np.maximum.reduceat(x, first)
        b = self.block
        place = sorted_lookup(terms, b.term)
        # The product with the bucket's largest coordinates bounds every score in it.
        most = np.add.reduceat(np.where(place >= 0, b.times * largest[place], 0), b.cut[:-1])
        for q in asked[most[asked] >= self.least[asked]]:
            mine = slice(b.cut[q], b.cut[q + 1])
            at, times = place[mine], b.times[mine]
            at, times = at[at >= 0], times[at >= 0]
            heavy = np.argsort(-(times * largest[at]), kind="stable")
            near, rest = heavy[:FOCUS], heavy[FOCUS:]
            exact = np.zeros(len(ids), np.int64)
            seen = np.zeros(len(ids))
            for k in near:
                s = slice(first[at[k]], ends[at[k]])
                exact[doc[s]] += times[k] * x[s]
                seen[doc[s]] += x[s].astype(float) ** 2
            left = np.sqrt((times[rest].astype(float) ** 2).sum()) * np.sqrt(np.maximum(norm ** 2 * (1 + 1e-9) - seen, 0))
            may = exact + left * (1 + 1e-9) + 1 >= self.least[q]
            for k in rest:
                s = slice(first[at[k]], ends[at[k]])
                on = may[doc[s]]
                exact[doc[s][on]] += times[k] * x[s][on]
            self.scored += int(may.sum())
            good = np.flatnonzero(may & (exact >= self.least[q]))
            if len(good):
                self._take(int(q), [(int(exact[g]), ids[g]) for g in good])

    def _take(self, q: int, found: list[tuple]) -> None:
        kept = sorted(self.best[q] + found, key=lambda r: (-r[0], r[1] is None, r[1]))[:self.top]
        self.best[q] = kept
        if len(kept) == self.top:
            self.least[q] = max(self.least[q], kept[-1][0])


def vectors(counted: DataFrame, corpus: Corpus) -> DataFrame:
    """`_id`, `length`, `terms`, `x` (impact of each term), stored by falling length."""
    shared = counted.sparkSession.sparkContext.broadcast(corpus)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (term, size), (tf, _) = flat(b.column(2)), flat(b.column(3))
            x = impacts(np.asarray(b.column(1)), size, term, tf, shared.value)
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), weights=x.astype(float) ** 2, minlength=len(size)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                                              pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64()))], ["_id", "length", "terms", "x"])

    kind = counted.schema["_id"].dataType.simpleString()
    made = counted.where(F.size("terms") > 0).mapInArrow(weigh, f"_id {kind}, length double, terms array<int>, x array<long>")
    # Equal lengths, as of copies, are dealt over several tasks.
    key = [F.desc("length"), F.xxhash64("_id", F.monotonically_increasing_id())]
    return stored(made.repartitionByRange(*key).sortWithinPartitions(F.desc("length")), "impact-vectors")


def best_of_tasks(rows: DataFrame, block: Block, top: int, least: np.ndarray | None = None) -> DataFrame:
    """`q`, `doc_id`, `score`: at most `top` documents per query and task."""
    shared = rows.sparkSession.sparkContext.broadcast((block, least))
    kind = rows.schema["_id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, id_type = Searcher(shared.value[0], top, shared.value[1]), None
        for b in batches:
            id_type = b.column(0).type
            (term, size), (x, _) = flat(b.column(2)), flat(b.column(3))
            s.add(b.column(0).to_pylist(), np.asarray(b.column(1)), size, term, x)
        found = [(q, i, v) for q, best in enumerate(s.best) for v, i in best]
        if found:
            q, i, v = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, id_type), pa.array(v, pa.int64())], ["q", "doc_id", "score"])

    return rows.mapInArrow(search, f"q int, doc_id {kind.simpleString()}, score long")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """The `top` documents of every item with a score above zero: `item_id`, `rank`, `doc_id`, `score`."""
    spark = docs.sparkSession
    d = whole(docs, id_col, text_col)
    asked = whole(items, item_col, item_text_col).distinct().orderBy("_id", "_text")
    id_type, item_type = (x.schema["_id"].dataType.simpleString() for x in (d, asked))
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for block, ids in item_blocks(asked.toLocalIterator()):
        counted = stored(term_counts(d, block), "term-counts")
        corpus = corpus_of(counted, block)
        if not corpus.n_docs:
            break
        names = spark.createDataFrame(list(enumerate(ids)), f"nq int, item_id {item_type}")
        found = _search(vectors(counted, corpus), block, top)
        out = out.unionByName(found.join(F.broadcast(names), F.col("q") == F.col("nq")).select("item_id", "rank", "doc_id", "score"))
    return out


def seed_length(rows: DataFrame) -> float:
    """A length that SEEDS vectors reach, a few more at most if their lengths differ."""
    left, steps = SEEDS, F.floor(F.log2(F.greatest("length", F.lit(1e-9))) * 64).cast("int")
    for r in rows.groupBy(steps.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("length")).orderBy(F.desc("s")).collect():
        left -= r["n"]
        if left <= 0:
            return r["length"]
    return 0.0


def _search(rows: DataFrame, block: Block, top: int) -> DataFrame:
    least = np.ones(len(block.cut) - 1, np.int64)
    by_query: dict[int, list[int]] = {}
    for r in best_of_tasks(rows.where(F.col("length") >= seed_length(rows)), block, top).collect():
        by_query.setdefault(r["q"], []).append(r["score"])
    for q, scores in by_query.items():
        if len(scores) >= top:
            least[q] = max(1, sorted(scores, reverse=True)[top - 1])
    # No query asks shorter vectors than this; the stored order lets the scan pass over them.
    shortest = float(((least - 1) / lengths(block)).min()) * (1 - 1e-9)
    found = best_of_tasks(rows.where(F.col("length") >= shortest), block, top, least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))
    some = found.withColumn("r", F.row_number().over(Window.partitionBy("q", group).orderBy(*order))).where(F.col("r") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)
