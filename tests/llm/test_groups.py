"""Operators that compare documents: repeats, lines, near duplicates, benchmark items, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhound.llm import graph, line_align, ngram_join, suffix_index, template_decontam
from tallyhound.llm.common import stored, table


def rows(df):
    return [r.asDict() for r in df.collect()]


def digest(df, **how):
    return Counter(
        (r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in rows(suffix_index.remove(df, **how)))


def brute(df):
    """Every row is a document."""
    every = [(r["doc_id"], r["text"] or "") for r in rows(df.select("doc_id", "text"))]
    return Counter((d, *w) for (d, _), w in zip(every, plain.repeats([t for _, t in every])))


@pytest.mark.parametrize("how", [{}, {"contexts": 1}, {"batches": 7}])
def test_repeats_match_plain_python(docs, how):
    assert digest(docs, **how) == brute(docs)


def test_repeats_in_awkward_rows(spark, nothing):
    awkward = plain.awkward
    odd = awkward(spark, [(20, "a" * 500), (21, "ab" * 300 + "x"), (22, "Z" * 199 + "q"), (23, "a" * 201), (24, "xyz" * 67)]).where("doc_id is null or doc_id <> 4")
    odd = odd.withColumn("text", F.substring("text", 1, 3000))
    assert digest(odd) == brute(odd)
    assert suffix_index.remove(nothing).count() == 0


def test_rows_that_repeat_others_lose_their_text(spark):
    own = " ".join(f"w{i}" for i in range(90))
    other = "start " + own[:250] + " end " + " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(1, own), (1, own), (2, other), (None, "n" * 199 + "m"), (None, "n" * 199 + "m"), (3, "short"), (3, "short"), (4, None)],
                               "doc_id long, text string")
    assert digest(df) == brute(df)
    kept = sorted((r["doc_id"] or 0, len(r["kept"])) for r in rows(suffix_index.remove(df)))
    assert kept == [(0, 0), (0, 0), (1, 0), (1, 0), (2, len(other) - 250), (3, 5), (3, 5), (4, 0)]


def test_levels_merge_geometrically(spark, docs):
    d = suffix_index.documents(docs, "doc_id", "text")
    a = suffix_index.sampled(d, 200, 32)
    family = suffix_index.SuffixFamily()
    sizes = []
    for b in range(5):
        family.add(a.where(F.pmod("d", F.lit(5)) == b))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    want = {r["key"] for r in rows(a.groupBy("key").count().where("count > 1"))}
    assert {r["key"] for r in rows(family.repeated())} == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (100, 51), (7, 7), (60, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(graph.components(e))}
    assert got == {**{i: 0 for i in range(31)}, **{i: 50 for i in (50, 51, 60, 100)}}
    assert graph.components(e.limit(0)).count() == 0


# Near duplicates.

def check_near(df, **how):
    got = rows(ngram_join.join(df, **how))
    every = sorted(((r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))), key=lambda x: (x[0] is None, x[0] or 0))
    want = plain.near([t for _, t in every])
    assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == Counter((i, n, every[k][0]) for (i, _), (n, k) in zip(every, want))


def test_links_match_all_pairs(docs, odd, nothing):
    check_near(docs)
    check_near(odd)
    assert ngram_join.join(nothing).count() == 0


def test_large_groups_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 7)
    base = [f"word{k}" for k in range(120)]
    texts = [(i, " ".join(base[:i % 100] + [f"edit{i}"] + base[i % 100 + 1:])) for i in range(60)] + [(100, " ".join(base)), (101, " ".join(base)), (102, "other text")]
    check_near(spark.createDataFrame(texts, "doc_id long, text string"))


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9995), (0.5, 0.99), (0.9, 0.999)):
        b, r = ngram_join.choose_bands(t, recall)
        assert b * r <= ngram_join.HASHES and 1 - (1 - t ** r) ** b >= recall


# Lines.

def test_patience():
    assert line_align.patience("abcde", "xabyde") == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert line_align.patience("aab", "ab") == [(0, 0), (2, 1)]
    assert line_align.patience("", "a") == [] == line_align.patience("ab", "cd")
    crossed = line_align.patience([1, 2, 3, 4, 9, 5], [4, 5, 1, 2, 3])
    assert crossed == [(0, 2), (1, 3), (2, 4)]


def check_lines(df):
    got = {r["doc_id"]: r for r in rows(line_align.remove(df).select("row.doc_id", "gone", "kept"))}
    lines, pairs = plain.line_pairs({r["doc_id"]: r["text"] for r in rows(df.select("doc_id", "text"))})
    gone = defaultdict(set)
    for i, f in pairs:
        a = line_align.patience(lines[i], lines[f])
        assert all(lines[i][x] == lines[f][y] for x, y in a) and all(p < q and p[1] < q[1] for p, q in zip(a, a[1:]))
        gone[i] |= set(line_align.blocks(a, [len(s) for s in lines[i]]))
    for i, ls in lines.items():
        assert set(got[i]["gone"] or []) == gone[i]
        assert got[i]["kept"] == "\n".join(s for k, s in enumerate(ls) if k not in gone[i])
    return gone


def test_lines_match_plain_python(docs):
    assert any(check_lines(docs).values())


def test_later_document_loses_the_block(spark):
    shared = "\n".join(f"shared line number {k} of the block" for k in range(4))
    d = spark.createDataFrame([(3, f"only here in three\n{shared}\nend of three"), (1, f"start of one\n{shared}"), (2, shared), (4, "alone")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in rows(line_align.remove(d).select("row.doc_id", "kept"))}
    assert got == {1: f"start of one\n{shared}", 2: "", 3: "only here in three\nend of three", 4: "alone"}


def test_common_lines_go_however_many_hold_them(spark):
    line = "a line of more than fifty characters that a great many documents hold"
    head = "a short head"
    d = spark.createDataFrame([(k, f"start of {k}\n{line}\nend of {k}") for k in range(130)]
                              + [(k, f"{k} starts\n{head}\na heading that pairs documents\njust a dozen\n{k} ends") for k in range(130, 260)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in rows(line_align.remove(d).select("row.doc_id", "kept"))}
    assert line in got[0] and head in got[130]
    assert all(got[k] == f"start of {k}\nend of {k}" for k in range(1, 130))
    assert all(got[k] == f"{k} starts\n{k} ends" for k in range(131, 260)), "one line that pairs, the rest of the block shorter"


def test_block_of_lines_with_other_first_holders(spark):
    one, two = "first line of a common block", "second line of a common block"
    short = "\n".join(f"item {k} of them" for k in range(5))
    d = spark.createDataFrame([
        (1, f"unrelated\n{one}\nmore"), (2, f"other\n{two}\nless"), (3, f"three\n{one}\n{two}\nthree ends"), (4, f"four\n{one}\n{two}\nfour ends"),
        (5, f"five\n{short}\n\nfive ends"), (6, f"six\n\n{short}\nsix ends"), (7, "\n" * 90 + " " * 90 + "\n"), (8, "8\n" + " " * 90 + "\n" * 90)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in rows(line_align.remove(d).select("row.doc_id", "kept"))}
    want = {r["doc_id"]: r["text"] for r in rows(d)} | {4: "four\nfour ends", 6: "six\n\nsix ends"}
    assert got == want


def test_stretch_without_unique_lines_is_aligned(spark):
    assert line_align.patience("upqv", "pqxpq") == [(1, 0), (2, 1)]
    assert line_align.patience("uLpppv", "pppLLpp", [1, 60, 0, 0, 0, 1]) == [(1, 4), (2, 5), (3, 6)]
    block = "one line of the block held twice\nanother line of the block held twice"
    d = spark.createDataFrame([(1, f"{block}\nbetween them\n{block}"), (2, f"start of two\n{block}\nend of two")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in rows(line_align.remove(d).select("row.doc_id", "kept"))}[2] == "start of two\nend of two"


@pytest.mark.parametrize("seed", range(20))
def test_runs_match_plain_python(seed):
    r = random.Random(seed)
    texts = [[r.choice(["", " ", " " * 30, "}", "ab" * 9, "cd" * 30]) for _ in range(r.randrange(1, 30))] for _ in range(20)]
    number = {s: r.getrandbits(63) for t in texts for s in t}
    row, key = line_align.runs(*(pa.array([[f(s) for s in t] for t in texts]) for f in (number.get, len, lambda s: bool(s.strip()))), 16, 50)
    want = []
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for e in range(i + 1, len(t) + 1):
                if sum(map(len, t[i:e])) >= 50 and any(s.strip() for s in t[i:e]):
                    want += [(k, tuple(t[i:e]))] if e > i + 1 else []
                    break
    assert row.tolist() == [k for k, _ in want]
    assert len(set(key.tolist())) == len({w for _, w in want}) == len(set(zip(key.tolist(), [w for _, w in want])))


def test_lines_in_awkward_rows(odd, nothing):
    r = rows(line_align.remove(odd).select("row.doc_id", "row.text", "kept"))
    assert len(r) == odd.count() and all(x["kept"] == (x["text"] or "") for x in r if x["doc_id"] != 6)
    assert [x["kept"] for x in r if x["doc_id"] == 6] == [""], "a copy of a long text loses all of it"
    assert line_align.remove(nothing).count() == 0


# Benchmark.

QUESTION = "If Alice has 12 apples and gives Bob 5 apples after walking 3 km to the market in Paris, how many apples does Alice have left?"


def test_templates_catch_other_values(spark):
    def ask(a, b, c, n, m, k, unit, city):
        return f"If {a} has {n} apples and gives {b} {m} apples after walking {k} {unit} to the market in {city}, how many apples does {c} have left?"
    d = spark.createDataFrame([
        (1, "Intro here. " + QUESTION + " Bye."), (2, ask("Carol", "Dave", "Carol", 40, 7, 9, "miles", "Rome")),
        (3, ask("Carol", "Dave", "Peter", 40, 7, 9, "miles", "Rome")), (4, "short"), (5, None), (6, ""), (None, QUESTION), (1, "Intro here. " + QUESTION + " Bye.")],
        "doc_id long, text string").withColumns({c: F.lit(1) for c in ("d", "t", "q", "n")})
    q = spark.createDataFrame([(1, QUESTION), (2, None), (3, "too short")], "item_id long, text string").withColumn("raw", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): (r["slots"], r["changed"]) for r in rows(template_decontam.find(d, q))}
    assert got == {(1, 1): (8, 0), (2, 1): (8, 8), (None, 1): (8, 0)}, "document 3 has one name for two"
    assert template_decontam.find(d.limit(0), q).count() == 0 and template_decontam.find(d, q.limit(0)).count() == 0


def test_other_question_of_the_template_does_not_clear_a_document(spark):
    def ask(x, y):
        return f"a farmer sells {x} eggs on monday morning and later buys back {y} eggs from the old shop near the river"
    d = spark.createDataFrame([(1, ask(80, 80) + ". " + ask(12, 95)), (2, ask(12, 95) + ". and now. " + ask(80, 80)), (3, ask(12, 95))], "doc_id long, text string")
    q = spark.createDataFrame([(1, ask(80, 80))], "item_id long, text string")
    got = {(r["doc_id"], r["coverage"], r["slots"], r["changed"]) for r in rows(template_decontam.find(d, q))}
    assert got == {(1, 1.0, 2, 0), (2, 1.0, 2, 0)}


def test_items_are_found_at_every_offset(spark):
    item = "the quick brown fox jumps over a lazy dog while seven small birds sing near some river".split()
    d, want = [], set()
    for off in range(4):
        for n, t in [(8, item[:8]), (9, item[:9]), (10, item[:10]), (17, [*item[:8], "other", *item[9:]]), (18, [*item[:9], "inserted", *item[9:]])]:
            d.append((100 * n + off, " ".join(["before"] * off + t)))
            want.add((100 * n + off, min(n, 17)))
    q = spark.createDataFrame([(n, " ".join(item[:n])) for n in (8, 9, 10, 17)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(template_decontam.find(spark.createDataFrame(d, "doc_id long, text string"), q))}
    assert want <= got


def test_split_item_beside_another_question(spark):
    def ask(x, y, mid="and"):
        return f"a farmer sells {x} eggs on monday morning {mid} later buys back {y} eggs from the old shop near the river"
    d = spark.createDataFrame([(1, ask(12, 95) + ". " + ask(80, 80, "and then much"))], "doc_id long, text string")
    q = spark.createDataFrame([(1, ask(80, 80))], "item_id long, text string")
    assert [(r["coverage"], r["slots"], r["changed"]) for r in rows(template_decontam.find(d, q))] == [(1.0, 2, 0)]


def test_items_in_capitals_are_found(spark):
    german = "Wenn die Straße im Mai 12 km weiß bleibt, wie viele Füße braucht Hans auf dem Weg nach Bonn?"
    other = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "40")
    d = spark.createDataFrame([(1, "Before. " + QUESTION.upper()), (2, QUESTION.title() + " After."), (3, german.upper()), (4, other.upper()),
                               (5, other.replace("does Carol", "does Peter").upper()), (6, QUESTION.upper().replace("WALKING", "WALKING ABOUT"))], "doc_id long, text string")
    q = spark.createDataFrame([(1, QUESTION), (2, german)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["changed"]) for r in rows(template_decontam.find(d, q))}
    assert got == {(1, 1): (1.0, 0), (2, 1): (1.0, 0), (3, 2): (1.0, 0), (4, 1): (1.0, 4), (6, 1): (1.0, 0)}


def plain_template(text, names=True):
    """The template from its definition, word by word."""
    import regex
    text = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text)
    text = regex.sub("[0-9]+", "0", text)
    if names:
        text = regex.sub(r"(?<=[\p{L}0-9,;] )\p{Lu}\p{L}*", "1", text)
    return ["2" if w in template_decontam.UNITS else w for w in regex.split(r"[^\p{L}0-9]+", text.lower()) if w]


def test_templates_match_plain_python(spark):
    r = random.Random(3)
    parts = ["a", "Km", "km", "KM", "5", "3.5", "1,000", "m2", "Ann", "ann's", "é", "Ö", "days,", "day;", "x.y", "-", "kg3", "\n", "ß"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(template_decontam.template(F.col("t")).alias("a"), template_decontam.template(F.col("t"), names=False).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(plain_template(t), plain_template(t, False)) for t in texts]


def test_short_and_number_heavy_items(spark):
    items = ["What is the capital of France?", "Compute 3 + 4 + 5 + 6 + 7 + 8 + 9 now please", "Anna met Berta, Carl, Dora, Emil, Fritz, Gustav, Heinz, Ida", "Yes it is", QUESTION]
    q = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame([(i, f"Some words before it. {t} And some more words after it.") for i, t in enumerate(items)]
                              + [(10 + i, f"before {t.upper()} after") for i, t in enumerate(items)]
                              + [(20, "What is the capital of Spain? It is not the capital of France"), (21, "Compute 3 + 4 + 5 + 6 + 7 + 8 + 10 now please"), (22, "3 4 5 6 7 and 8 9")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(template_decontam.find(d, q))}
    assert got == {(i, i) for i in (0, 1, 2, 4)} | {(10 + i, i) for i in (0, 1, 2, 4)}


@pytest.mark.parametrize("few", [200_000, 0])
def test_every_planted_item_is_found(spark, docs, sf, monkeypatch, few):
    monkeypatch.setattr(template_decontam, "BROADCAST_WINDOWS", few)
    items = table(spark, sf, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in rows(template_decontam.find(docs, items))}
    want = {(r["doc_id"], q["item_id"]) for r in rows(docs) for q in rows(items) if q["text"] in r["text"]}
    assert want and got == want


# Pipeline.

def test_stages_take_effect(spark, sf):
    d = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        d = stored(stage(spark, d, sf), "stage")
        kept[name] = d
    original = table(spark, sf, "documents")
    assert all(kept[n].columns == original.columns for n in list(kept)[:-1])
    clean = {r["doc_id"]: r["text"] for r in rows(kept["toxicity"])}
    _, pairs = plain.line_pairs(clean)
    assert pairs and kept["line dedup"].count() < len(clean)
    lined = sorted((r["doc_id"], r["text"]) for r in rows(kept["line dedup"]))
    first = {lined[k][0] for _, k in plain.near([t for _, t in lined])}
    assert {r["doc_id"] for r in rows(kept["near duplicates"])} == first
    items = rows(table(spark, sf, "benchmark"))
    held = {r["doc_id"] for r in rows(kept["near duplicates"]) if any(q["text"] in r["text"] for q in items)}
    assert {r["doc_id"] for r in rows(kept["benchmark decontamination"])} == first - held
    assert {r["doc_id"] for r in rows(kept["best-fit packing"])} == first - held


def test_stages_take_awkward_rows(spark, odd, nothing, sf):
    for start in (odd, nothing):
        d = start
        for _, stage in corpus_pipeline.STAGES:
            d = stored(stage(spark, d, sf), "stage")
        assert d.count() > 0 or start is nothing


def test_run_returns_the_packing(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("texts", [[], [""], ["short"] * 100, ["x" * 150, "y" * 150], ["z" * 200], ["é" * 100, "a"]])
def test_anchors_of_any_batch(texts):
    import pyarrow as pa

    from tallyhound.llm import suffixes
    a = suffixes.anchors(pa.array(texts, pa.string()))
    starts = {(t, s) for t, lo, hi in zip(a["text"], a["lo"], a["hi"]) for s in range(lo, hi + 1)}
    assert starts == {(i, s) for i, t in enumerate(texts) for s in range(len(t.encode()) - 199)}
    assert ((a["lo"] <= a["at"]) & (a["at"] + suffixes.KEY <= a["lo"] + suffixes.MATCH)).all() and (a["hi"] <= a["at"]).all()


def test_bands_out_of_reach_are_an_error():
    with pytest.raises(ValueError, match="no bands"):
        ngram_join.choose_bands(0.01, 0.9999)


@pytest.mark.parametrize("seed", range(5))
def test_long_stretches_are_cut_like_short_ones(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    for _ in range(100):
        n, m, kinds = rng.integers(1, 40), rng.integers(1, 40), rng.integers(1, 5)
        a, b = rng.integers(0, kinds, n).tolist(), rng.integers(0, kinds, m).tolist()
        sizes = rng.choice([0, 0, 1, 3, 9], n).tolist()
        forms = []
        for small in (0, 10**9):
            monkeypatch.setattr(line_align, "SMALL", small)
            forms.append([line_align.largest(a, 0, n, b, 0, m, s) for s in (None, sizes)])
            forms[-1] += [line_align.blocks(line_align.patience(a, b, sizes, least), sizes, 8) for least in (0, 8)]
        assert forms[0] == forms[1] and forms[0][2] == forms[0][3]


def test_very_long_repetitive_texts_are_aligned():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, (2, 100_000)).tolist()
    aligned = line_align.patience(a, b, [20] * len(a), 50)
    assert aligned and all(a[x] == b[y] for x, y in aligned)
