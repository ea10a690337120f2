"""Language-model scores, hard negatives and ranked search against plain Python."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import plain
import pytest
from pyspark.sql import functions as F

from tallyhound.llm import hard_negatives, lattice_lm, lexical_search, queries, spans
from tallyhound.llm.common import table
from tallyhound.llm.packing import BYTE_LETTERS


def rows(df):
    return [r.asDict() for r in df.collect()]


# Tokens.

@pytest.mark.parametrize("pattern, kept", [(r"[^\x20\x09-\x0D]+", spans.WORD_BYTES), (r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", spans.TERM_BYTES)])
def test_tokens_match_the_patterns(docs, odd, pattern, kept):
    texts = [r["text"] or "" for r in rows(docs.select("text").union(odd.select("text")))] + ["", "A", " a ", "é_É", "\x00", "a\x85b c"]
    t = spans.tokens(pa.array(texts, pa.string()), kept)
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    want = [re.findall(pattern, x.translate(fold)) for x in texts]
    assert t.counts.tolist() == [len(w) for w in want]
    flat = [w.encode() for ws in want for w in ws]
    assert t.spelled(np.arange(len(flat))).to_pylist() == flat
    assert len(set(zip(t.hashes.tolist(), flat))) == len(set(flat)) == len(set(t.hashes.tolist()))


# Subword lattices.

EXTRA = [(b"th", False), (b"he", False), (b"the", True), (b"the", False), (b"he", True), (b"ab", False), (b"ba", True), (b"aba", False), ("é".encode(), True)]


def small_pieces():
    return [(bytes([b]), last) for last in (False, True) for b in range(256)] + EXTRA


def weights(v, pieces):
    return {p: math.exp(v.log_p[i]) for i, p in enumerate(pieces)}


def segmentations(word, have):
    if (word, True) in have:
        yield [(word, True)]
    for k in range(1, len(word)):
        if (word[:k], False) in have:
            for rest in segmentations(word[k:], have):
                yield [(word[:k], False), *rest]


def plain_spell(word, p):
    """Forward sums over prefixes, one word at a time."""
    alpha = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        alpha[j] = sum(alpha[i] * p.get((word[i:j], j == len(word)), 0.0) for i in range(j))
    return alpha[-1]


@pytest.mark.parametrize("word", [b"t", b"the", b"thethe", b"abababa", "caféé".encode(), bytes(range(120, 130)), b"hehehehehehe"])
def test_recursion_sums_all_segmentations(word):
    pieces = small_pieces()
    v = lattice_lm.vocabulary(pieces)
    p = weights(v, pieces)
    all_ways = list(segmentations(word, p))
    probability = [math.prod(p[x] for x in s) for s in all_ways]
    s = lattice_lm.Speller(v)
    batch = np.array([list(word), list(word)], np.uint8)
    want = math.log(math.fsum(probability))
    assert s.log_spell(batch) == pytest.approx([want, want]) and s.long_word(word) == pytest.approx(want)
    used = Counter()
    for way, q in zip(all_ways, probability):
        for x in way:
            used[x] += q / math.fsum(probability)
    one, two = np.zeros(len(pieces)), np.zeros(len(pieces))
    s.long_word(word, one)
    s.add_expected(batch, two)
    expected = np.array([used[x] for x in pieces])
    assert one == pytest.approx(expected) and two == pytest.approx(2 * expected)


def test_spelling_is_a_distribution_over_words():
    pieces = small_pieces()
    alphabet = {(x, last) for x in (b"a", b"b", b"ab", b"aba", b"ba") for last in (False, True)}
    v = lattice_lm.vocabulary(pieces)
    v = v.with_counts(np.array([1e6 * (2 if last else 1) if (x, last) in alphabet else 0.0 for x, last in pieces]))
    s = lattice_lm.Speller(v)
    total = sum(np.exp(s.log_spell(np.array([[97 + (n >> i & 1) for i in range(size)] for n in range(1 << size)], np.uint8))).sum() for size in range(1, 17))
    assert 0.97 < total <= 1 + 1e-9


def test_long_and_short_words_agree_and_long_ones_end(monkeypatch):
    v = lattice_lm.vocabulary(small_pieces())
    s = lattice_lm.Speller(v)
    words = pa.array([b"the" * 30, b"x", "é".encode() * 40, b"aba" * 20, b"q" * 200_000], pa.binary())
    groups = dict()
    for at, part in lattice_lm.by_length(words):
        for a, w in zip(at, [part] if isinstance(part, bytes) else part):
            groups[int(a)] = w
    assert sorted(groups) == list(range(5)) and isinstance(groups[0], bytes) and groups[4] == b"q" * 200_000
    assert s.long_word(groups[3].tobytes()) == pytest.approx(s.log_spell(groups[3][None, :])[0])
    assert math.isfinite(s.long_word(groups[4]))


@pytest.fixture(scope="module")
def vocabulary_file(tmp_path_factory):
    """A byte-level vocabulary file of the small pieces."""
    path = tmp_path_factory.mktemp("vocabulary") / "pieces.json"
    letters = {b: chr(BYTE_LETTERS.get(b, b)) for b in range(256)}
    names = ["".join(letters[b] for b in p) + ("</w>" if last else "") for p, last in small_pieces()] + ["<|end|>"]
    path.write_text(json.dumps({"added_tokens": [{"content": "<|end|>"}], "model": {"vocab": {n: i for i, n in enumerate(names)}}}))
    assert lattice_lm.read_pieces(str(path)) == small_pieces()
    return str(path)


def plain_scores(texts, ids, pieces, rounds):
    """(n_tokens, n_known, train_tokens, base, score) of each text."""
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    bags = [[w.encode() for w in plain.words((t or "").translate(fold))] + [None] for t in texts]
    train = [b for b, i in zip(bags, ids) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for b in train for w in b)
    n, types = sum(count.values()), len(count)
    p = weights(lattice_lm.vocabulary(pieces), pieces)
    for _ in range(rounds if count else 0):
        used = Counter()
        for w in count:
            if w is not None:
                used.update(plain_expected(w, p))
        total = sum(used.values()) + lattice_lm.PRIOR * len(pieces)
        p = {x: (used[x] + lattice_lm.PRIOR) / total for x in pieces}
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0))

    def log_p(w):
        if w is None:
            return math.log10((count[w] - d) / n) if n else math.log10(0.5)
        if not n:
            return math.log10(plain_spell(w, p) / 2)
        return math.log10(max(count[w] - d, 0) / n + d * types / n * plain_spell(w, p))
    return [(len(b), sum(count[w] > 0 for w in b), n, sum(math.log10((count[w] + 1) / (n + types + 1)) for w in b), sum(map(log_p, b))) for b in bags]


def plain_expected(w, p):
    alpha = [1.0] + [0.0] * len(w)
    beta = [0.0] * len(w) + [1.0]
    for j in range(1, len(w)):
        alpha[j] = sum(alpha[i] * p.get((w[i:j], False), 0.0) for i in range(j))
    for i in range(len(w) - 1, -1, -1):
        beta[i] = sum(beta[j] * p.get((w[i:j], j == len(w)), 0.0) for j in range(i + 1, len(w) + 1))
    out = Counter()
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            x = (w[i:j], j == len(w))
            if x in p:
                out[x] += alpha[i] * p[x] * beta[j] / beta[0]
    return out


@pytest.mark.parametrize("most", [lattice_lm.FREQUENT, 3, 0])
def test_scores_match_plain_python(spark, vocabulary_file, most):
    texts = ["The the THE aba\tabab", "the thé  ba x", None, "", "abab abab he\n" * 5, "zq the", "zq", "a b a b ab ba", "the the THE", "unseen" + "é" * 30]
    ids = [0, 1, 2, 3, 4, 6, 12, 13, None, 5]
    d = spark.createDataFrame([*zip(ids, texts), (4, texts[4]), (4, "another text")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    ids, texts = [*ids, 4, 4], [*texts, texts[4], "another text"]
    out = F.crc32(F.col("_id").cast("string").cast("binary")) % 7 == 2
    got = lattice_lm.score(d, vocabulary_file, out, most=most)
    want = plain_scores(texts, ids, small_pieces(), lattice_lm.ROUNDS)
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["score"]), r) for r in rows(got) if r["doc_id"] is not None)
    expected = sorted((i, w[0], w[4], *w) for i, w in zip(ids, want) if i is not None)
    assert got.count() == len(ids) and len(found) == len(expected)
    for (_, r), (i, _, _, n, known, total, base, score) in zip(found, expected):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (i, n, known, total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    lone = rows(got.where("doc_id is null"))[0]
    assert not lone["held_out"] and lone["score"] == pytest.approx(want[8][4])


def test_rounds_raise_the_likelihood(spark, docs):
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).limit(40)
    pieces = lattice_lm.read_pieces(queries.vocabulary("word_bpe_49k.json"))
    counted = lattice_lm.word_counts(d, F.lit(True)).cache()
    words = [r["w"] for r in rows(counted)]
    totals = []
    for n in range(3):
        s = lattice_lm.Speller(lattice_lm.train(counted, 40, pieces, n).pieces)
        totals.append(sum(s.long_word(w) for w in words))
    assert totals[0] < totals[1] < totals[2]


def test_scores_of_awkward_rows(spark, odd, nothing):
    path = queries.vocabulary("word_bpe_49k.json")
    got = rows(lattice_lm.score(odd, path))
    assert len(got) == odd.count() and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in got)
    assert lattice_lm.score(nothing, path).count() == 0
    alone = rows(lattice_lm.score(odd.where("doc_id = 5"), path, F.lit(True)))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < -1 for r in alone)


def test_registered_scores(spark, sf):
    got = queries.op11_subword_lattice(spark, sf)
    d = rows(table(spark, sf, "documents"))
    assert got.count() == len(d)
    by_id = {r["doc_id"]: r for r in rows(got)}
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    bags = {r["doc_id"]: [*plain.words((r["text"] or "").translate(fold)), None] for r in d}
    count = Counter(w for i, b in bags.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in b)
    n, v = sum(count.values()), len(count)
    for i, b in bags.items():
        r = by_id[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(b), sum(count[w] > 0 for w in b), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in b))
        # A word in its only training place has at least its own arc.
        assert math.isfinite(r["score"]) and r["score"] < 0


# Hard negatives.

def plain_negatives(data):
    seen, taken = set(), []
    for i, label, v in data:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            taken.append((i, label, q))
    out = Counter()
    for a in taken:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0] is None, b[0], b[1]) for b in taken if b is not a and len(b[2]) == len(a[2])),
                        key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
        for s, _, p, _ in [x for x in scored if x[3] == a[1]][:5]:
            far = [x for x in scored if x[3] != a[1] and 30 * -s <= -100 * x[0] <= 90 * -s]
            for k, x in enumerate(far[:10]):
                out[a[0], p, k + 1, x[2], -s, -x[0]] += 1
    return out


def vectors(n, dim=6, seed=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(5, dim))
    v = middle[r.integers(0, 5, n)] + 0.3 * r.normal(size=(n, dim))
    return [(int(i * 10), int(r.integers(0, 4)), [float(np.float32(x)) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("run, block, together", [(64, 2048, 4096), (4, 3, 32)])
def test_negatives_match_plain_python(spark, monkeypatch, run, block, together):
    monkeypatch.setattr(hard_negatives, "RUN", run)
    monkeypatch.setattr(hard_negatives, "TOGETHER", together)
    data = vectors(400)
    data += [(5000 + k, k % 3, data[7][2]) for k in range(60)]
    data += [(100, 1, [1.0] * 6), (100, 1, [1.0] * 6), (100, 2, [1.0] * 6), (None, 1, data[7][2]), (8000, None, [1.0] * 6), (8100, 1, None), (8200, 1, [1.0, None] + [0.0] * 4),
             (8300, 1, [float("nan")] * 6), (8400, 1, [float("inf")] + [0.0] * 5), (8500, 1, [0.0] * 6), (8600, 2, [1.0, 2.0]), (8603, 2, [2.0, 1.0]), (8604, 3, [1.0, 1.0]), (8700, 1, [])]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").withColumns({"id": F.lit("clash"), "norm": F.lit(1)})
    got = hard_negatives.mine(df, F.col("id") % 100 == 0, block=block)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r[n] for n in names) for r in rows(got)) == plain_negatives(data)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_intervals_hold_and_skip(monkeypatch):
    r = np.random.default_rng(1)
    q = np.floor(256 * (np.repeat(r.normal(size=(40, 8)), 50, axis=0) + 0.02 * r.normal(size=(2000, 8)))).astype(np.int64)
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    refs = hard_negatives.choose_references(q[::25].astype(float), 16)
    seen = hard_negatives.angles(q.astype(float), norm, refs).astype(np.float32).astype(float)
    a = hard_negatives.Anchors(list(range(0, 2000, 50)), np.zeros(40, int), np.arange(0, 2000, 50), q[::50], norm[::50], seen[::50])
    first = np.arange(0, 2000, 50)
    least, most = hard_negatives.intervals(a, np.minimum.reduceat(seen, first), np.maximum.reduceat(seen, first),
                                           np.minimum.reduceat(norm, first), np.maximum.reduceat(norm, first))
    score = (a.q @ q.T).reshape(40, 40, 50)
    assert (score >= least[:, :, None]).all() and (score <= most[:, :, None]).all()
    monkeypatch.setattr(hard_negatives, "RUN", 50)
    m = hard_negatives.Miner(a, hard_negatives.Asked(np.arange(40), np.full(40, -10 ** 15), np.full(40, 10 ** 15), True, 5))
    for _ in range(2):
        m.best = [[] for _ in m.best]
        before = m.scored
        m.add(list(range(2000)), np.zeros(2000, int), np.arange(2000), q, np.ones(2000, bool), norm, seen)
    assert m.scored - before < 40 * 2000 / 2, "runs outside the windows are not scored"


# Ranked search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        asked = Counter(terms(text))
        found = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in asked.items() if t in b)
            if s > 0:
                found.append((-s, i is None, i, s))
        for k, (_, _, i, s) in enumerate(sorted(found, key=lambda x: x[:3])[:top]):
            out[item, k + 1, i, s] += 1
    return out


@pytest.mark.parametrize("seeds, items, terms_, bucket, focus", [(4096, 2000, 200_000, 512, 6), (10, 3, 40, 8, 1)])
def test_ranks_match_plain_python(spark, docs, odd, sf, monkeypatch, seeds, items, terms_, bucket, focus):
    for name, value in (("SEEDS", seeds), ("BLOCK_ITEMS", items), ("BLOCK_TERMS", terms_), ("BUCKET", bucket), ("FOCUS", focus)):
        monkeypatch.setattr(lexical_search, name, value)
    queries_ = table(spark, sf, "benchmark").limit(9).unionByName(spark.createDataFrame(
        [(900, "one two three one"), (901, None), (902, " "), (900, "another"), (900, "another"), (None, "words WORDS id"), (903, "nothingsuch")], "item_id long, text string"))
    for d in (docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), odd.withColumn("n", F.lit(1))):
        got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(lexical_search.rank(d, queries_)))
        assert got == plain_ranks([(r["doc_id"], r["text"]) for r in rows(d)], [(r["item_id"], r["text"]) for r in rows(queries_)])


def test_search_of_empty_tables(spark, odd, nothing, sf):
    items = table(spark, sf, "benchmark")
    assert lexical_search.rank(nothing, items).count() == 0 and lexical_search.rank(odd, items.limit(0)).count() == 0


def test_ties_go_by_id_and_short_vectors_are_skipped(spark):
    d = spark.createDataFrame([(i, "common " * 40 + "rare") for i in range(300)] + [(1000 + i, "common filler words here") for i in range(3000)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "rare")], "item_id long, text string")
    assert [r["doc_id"] for r in rows(lexical_search.rank(d, q).orderBy("rank"))] == list(range(20))
    block, _ = next(lexical_search.item_blocks([{"_id": 1, "_text": "rare common"}]))
    s = lexical_search.Searcher(block, 1)
    rare = int(np.flatnonzero(block.hashes == spans.tokens(pa.array(["rare"]), spans.TERM_BYTES).hashes[0])[0])
    s.add([0], np.array([100.0]), np.array([1]), np.array([rare]), np.array([100]))
    seen = s.scored
    s.add(list(range(1, 600)), np.full(599, 10.0), np.ones(599, int), np.full(599, rare), np.full(599, 10))
    assert s.scored == seen and s.best[0] == [(100, 0)]
