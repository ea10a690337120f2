"""Operators that judge row by row: rules, quality, toxicity, identifiers, packing, licences."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhound.llm import license_scan, packing, pii, quality_model, quality_rules, suffixes, toxicity, words
from tallyhound.llm.common import held_out, table
from tallyhound.llm.queries import vocabulary


def rows(df):
    return [r.asDict() for r in df.collect()]


# Host rules.

def test_measures_match_plain_python(docs, odd):
    for d in (docs, odd):
        want = Counter((r["doc_id"], *plain.measures(r["text"])) for r in rows(d.select("doc_id", "text")))
        assert Counter(tuple(r) for r in quality_rules.judge(d).select("doc_id", *quality_rules.MEASURES).collect()) == want


def test_bad_host_loses_its_documents(spark):
    good = [(i, f"{i} " + " ".join(f"w{i}x{k}" for k in range(80)), "good") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{i}x{k}" for k in range(60)) + " $" * 40, "bad") for i in range(60)]
    lone = [(900, " ".join(f"z{k}" for k in range(60)) + " $" * 40, "lone")]
    got = {r["doc_id"]: r for r in rows(quality_rules.judge(spark.createDataFrame(good + bad + lone, "doc_id long, text string, source string")))}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] or got[100 + i]["base_failed"] for i in range(60))
    assert got[900]["kept"], "one failure shrinks towards the other hosts"


def test_rules_on_no_rows(nothing):
    assert quality_rules.judge(nothing).count() == 0


# Quality and toxicity.

def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, count, y = rng.normal(size=(7, len(quality_model.FEATURES))), np.array([2, 1, 4]), np.array([1.0, 0, 1])
    q = {k: np.array(v, float) for k, v in quality_model.fit(x, count, y, rounds=3).params.items()}

    def loss(p):
        s = quality_model.forward(p, x, count)["p"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()
    for k, g in quality_model.gradients(q, x, count, y).items():
        at = (0,) * q[k].ndim
        up, down = ({a: b.copy() for a, b in q.items()} for _ in range(2))
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - np.asarray(g)[at]) < 1e-6


def test_every_text_has_passages():
    x, count = quality_model.passages(pa.array(["", "a", " ".join(["w"] * 129), "\n"]))
    assert count.tolist() == [1, 1, 3, 1] and x.shape == (6, len(quality_model.FEATURES)) and not x[0].any()


@pytest.mark.parametrize("train, score, label, cut, least", [
    (quality_model.train, quality_model.score, "quality", 0.3, 0.97), (toxicity.train, toxicity.score, "toxic", 0.5, 0.96)])
def test_held_out_accuracy(spark, train, score, label, cut, least):
    sf = "/root/testdata/sf0.1"
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = score(d, train(d, y)).where(held_out()).join(y, "doc_id").select(((F.col("score") >= cut).cast("int") == F.col(label)).cast("int").alias("ok"))
    n, ok = got.agg(F.count("ok"), F.sum("ok")).first()
    assert n > 500 and ok / n > least


@pytest.mark.parametrize("train, score", [(quality_model.train, quality_model.score), (toxicity.train, toxicity.score)])
def test_models_take_awkward_rows(odd, nothing, labels, spark, train, score):
    marks = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for y in (marks, marks.limit(0)):
        got = score(odd, train(odd, y)).select("doc_id", "score").collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score(nothing, train(nothing, marks)).count() == 0


def test_toxic_sentence_is_located(docs, labels, spark):
    sf = "/root/testdata/sf0.1"
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    text = "A calm line here. You stupid worthless idiot, moron and scum! Another calm line."
    r = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r["score"] > 0.5 and [text[s["start"]:s["end"]] for s in r["offending"]] == [" You stupid worthless idiot, moron and scum"]


# Identifiers.

def test_base_spans_match_the_patterns(docs):
    for r in docs.select("text").collect():
        assert pii.detect(r["text"]) == plain.identifiers(r["text"])


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="a.@-1 2+3(4\n", max_size=40))
def test_base_spans_on_noise(text):
    assert pii.detect(text) == plain.identifiers(text)
    base, every = pii.find(text)
    assert base == pii.detect(text) and all(set(base[k]) <= set(every[k]) for k in pii.KINDS)


@pytest.mark.parametrize("text, kind, found", [
    ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
    ("john at example dot com", "email", "john at example dot com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("x jane​@example.com y", "email", "jane​@example.com"),
    ("user [at] mail [dot] example [dot] org", "email", "user [at] mail [dot] example [dot] org"),
    ("jane.doe at example.com", "email", "jane.doe at example.com"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("+1 (five five five) 123 4567", "phone", "+1 (five five five) 123 4567"),
    ("ip 192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"),
    ("ip １９２．１６８．１．１!", "ip", "１９２．１６８．１．１"),
    ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises_map_back(text, kind, found):
    base, every = pii.find(text)
    assert [text[a:b] for a, b in every[kind]] == [found] and found not in [text[a:b] for a, b in base[kind]]


@pytest.mark.parametrize("text", ["arrive at noon. Dot by dot, one two three.", "look at example.com", "un un un deux", "", "see (at) home", "Москва и Петербург"])
def test_clean_text_has_none(text):
    assert not any(pii.find(text)[1].values())


def test_scan_keeps_every_row(odd, nothing):
    got = rows(pii.scan(odd))
    assert len(got) == odd.count()
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got if not r["spans"])
    assert pii.scan(nothing).count() == 0


# Packing.

def check_packing(df, packed, limit):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in rows(df.select("doc_id", "text")):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), limit)):
            body = np.array(ids[s:s + limit], "<u4").tobytes()
            want[r["doc_id"], k, s, len(body) // 4, zlib.crc32(body)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    at = defaultdict(list)
    for r in packed:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in at.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= limit
    return len(at), -(-sum(r["length"] for r in packed) // limit)


@pytest.mark.parametrize("limit", [2048, 64])
def test_packing_is_whole_and_tight(docs, odd, limit):
    for d in (docs, odd):
        used, bound = check_packing(d, rows(packing.pack(d, vocabulary("word_bpe_49k.json"), limit)), limit)
        assert used <= 1.05 * bound + 2


def test_packing_numbers_across_groups(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    check_packing(docs, rows(packing.pack(docs, vocabulary("word_bpe_49k.json"))), 2048)


def test_packing_no_rows(nothing):
    assert packing.pack(nothing, vocabulary("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plans_use_up_the_histogram(hist):
    used = Counter()
    for pat, n in packing.plan(hist, 64):
        assert n > 0 and sum(pat) <= 64
        for x in pat:
            used[x] += n
    assert used == Counter(hist)


def test_remembered_words_equal_the_tokenizer():
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["Don't I'LL stop's", "ΣΑΣ İx ²½Ⅷ 12a", "<|endoftext|>x a<|startoftext|>", "éÉ café naïve!!", "\x1ca\x1db", "", "ß|| $$$ a.b.c. x'", "ＡＢ ﬁ  z"]
    for _ in range(2):
        assert own(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# Licences.

def test_licences_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = spark.createDataFrame([
        (1, "a/LICENSE", gpl), (2, "a/b/x.py", "def f(): pass"), (3, "a/b/c/LICENSE.txt", mit), (4, "a/b/c/d/y.py", "z = 1"),
        (5, "q/z.py", "nothing"), (6, "a/b/w.py", "# x\n# " + "words around " * 5 + "\n" + mit), (7, None, mit), (8, "a/n.txt", None), (9, "top.txt", "plain")],
        "doc_id long, path string, text string").withColumn("licence", F.lit("clash"))
    got = {r["doc_id"]: (r["licence"], r["inherited_from"]) for r in rows(license_scan.scan(files))}
    assert got == {1: ("GPL-3.0", None), 2: ("GPL-3.0", "a"), 3: ("MIT", None), 4: ("MIT", "a/b/c"), 5: (None, None), 6: ("MIT", None), 7: ("MIT", None), 8: ("GPL-3.0", "a"), 9: (None, None)}


def test_licences_take_awkward_rows(odd, nothing):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    assert license_scan.scan(odd.withColumn("path", path)).count() == odd.count()
    assert license_scan.scan(nothing.withColumn("path", path)).count() == 0


def test_every_planted_notice_is_found(docs):
    d = docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    got = {r["doc_id"]: r["own"] for r in rows(license_scan.scan(d))}
    marks = {"Apache License, Version 2.0.": "Apache-2.0", "under the MIT License.": "MIT", "General Public License, version 3.": "GPL-3.0", "CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for r in rows(docs.select("doc_id", "text")):
        want = [v for k, v in marks.items() if k in r["text"]]
        assert got[r["doc_id"]] in want if want else got[r["doc_id"]] is None


# Arrow helpers.

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n\té", max_size=60), max_size=6))
def test_word_hashes_tell_words_apart(texts):
    hashes, counts = words.word_hashes(pa.array(texts, pa.string()))
    flat = [[w.translate({i: i + 32 for i in range(65, 91)}) for w in plain.words(t)] for t in texts]
    assert counts.tolist() == [len(w) for w in flat]
    by = {}
    for w, h in zip((w for ws in flat for w in ws), hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    sh, made = words.shingles(hashes, counts)
    at = 0
    for t, m in zip(texts, made):
        assert len(set(sh[at:at + m].tolist())) == len(plain.shingles(t))
        at += m


def test_windows_of_least_values():
    v = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    for width in (1, 3, 7, 100):
        assert suffixes.least_ahead(v, width).tolist() == [v[i:i + width].min() for i in range(101 - width)]


# Registered queries.

def test_queries_and_sql(spark, sf, monkeypatch):
    import __spark_entry__ as entry
    from checks import compare
    from tallyhound.llm import queries, sql
    assert set(queries.REGISTRY) | {"pipeline"} <= set(entry.queries()) and set(sql.ORACLE) <= set(queries.REGISTRY)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY) == list(range(1, 11))
    for name, text in sql.ORACLE.items():
        monkeypatch.setitem(compare.REGISTRY, name, queries.REGISTRY[name])
        monkeypatch.setitem(compare.ORACLE, name, text)
        assert compare.differences(spark, sf, name) is None


def test_the_learning_sample_is_bounded_by_rows(spark):
    """One id in a third of all rows, as copies and with other texts, is one row of the sample."""
    from tallyhound.llm.common import held_out, learning_sample
    ids = [r["i"] for r in spark.range(40).select(F.col("id").alias("i")).where(~held_out("i")).collect()]
    hot = spark.range(20_000).select(F.lit(ids[0]).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    docs = hot.unionByName(spark.createDataFrame([(i, f"own {i}") for i in ids[1:]], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 1), (None, 1), (ids[1], None)], "doc_id long, toxic int")
    got = learning_sample(docs, labels, "toxic", len(ids)).collect()
    assert sorted(r["_id"] for r in got) == ids
    assert learning_sample(docs.orderBy(F.desc("text")), labels, "toxic", len(ids)).where(F.col("_id") == ids[0]).collect() == [r for r in got if r["_id"] == ids[0]]
    assert learning_sample(docs, labels, "toxic", 2).count() == 2


def wrapped(text, width, lead=""):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            out.append(lead + line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, lead + line])


def plain_cosine(words_, template, weight, other):
    a, b = Counter(words_), Counter(license_scan.terms(template))
    w = lambda x: weight.get(x, other)
    norm = lambda c: sum((n * w(x)) ** 2 for x, n in c.items()) ** 0.5
    return sum(n * b[x] * w(x) ** 2 for x, n in a.items() if x in b) / (norm(a) * norm(b))


HEADERS = {k: max(v, key=len) for k, v in license_scan.TEMPLATES.items()}


@pytest.mark.parametrize("name", sorted(HEADERS))
@pytest.mark.parametrize("form", ["file", "comment", "code", "docstring"])
def test_every_licence_is_told_from_its_relatives(name, form):
    m = license_scan.Matcher(1000, {"the": 900, "of": 800, "license": 40, "software": 60})
    text = wrapped(HEADERS[name], 70, "# " if form in ("comment", "code") else "")
    text = {"file": f"Copyright (c) 2021 Maria Lopez\n\n{text}\n", "comment": text, "code": f"# Copyright 2021 Lopez\n#\n{text}\n\nimport os\n\ndef f(x):\n    return os.path.join(x, 'y')\n",
            "docstring": f'def first():\n    pass\n\n{text}\n\n' + "value = compute(other)\n" * 30}[form]
    licence, cosine, share = license_scan.notices(text, m, license_scan.LEAST_COSINE)
    assert licence == name and cosine > 0.8
    assert share > 0.5 or form == "docstring"


def test_cosine_is_the_plain_one():
    counts = {"the": 900, "of": 800, "license": 40, "software": 60}
    m = license_scan.Matcher(1000, counts)
    other = m.other ** 0.5
    for name, ts in license_scan.TEMPLATES.items():
        for t in ts:
            unit = license_scan.terms(t)[2:] + ["zzz", "qqq"]
            want = max(plain_cosine(unit, x, m.weight, other) for v in license_scan.TEMPLATES.values() for x in v)
            got = m.best(unit, 0.0)
            assert abs(got[1] - want) < 1e-9
            assert abs(max(plain_cosine(unit, x, m.weight, other) for x in license_scan.TEMPLATES[got[0]]) - want) < 1e-9


def test_short_and_mixed_notices():
    m = license_scan.Matcher(1000, {})
    own = lambda t: license_scan.notices(t, m, license_scan.LEAST_COSINE)[0]
    assert own("Released under the MIT License.\nwords") == "MIT" and own("\n\n") is None and own("no such thing here") is None
    assert own("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991") == "GPL-2.0"
    assert own("# SPDX-License-Identifier: LGPL-2.1-or-later\nimport os") == "LGPL-2.1"


# Disguises, each rule alone in an otherwise plain text.

@pytest.mark.parametrize("text, kind, found", [
    ("plus 44 20 7946 0958", "phone", "plus 44 20 7946 0958"), ("please ring plus 1 555 123 4567 now", "phone", "plus 1 555 123 4567"),
    ("juan arroba ejemplo.com", "email", "juan arroba ejemplo.com"), ("escribe a maria.lopez arroba ejemplo.com hoy", "email", "maria.lopez arroba ejemplo.com"),
    ("it says \"one dot two dot three dot four.\" here", "ip", "one dot two dot three dot four"), ("ana [at] host.org", "email", "ana [at] host.org")])
def test_each_rule_works_alone(text, kind, found):
    base, every = pii.find(text)
    assert not base[kind] and [text[a:b] for a, b in every[kind]] == [found]


@pytest.mark.parametrize("text", ["two plus 2 is four", "una arroba de trigo", "he has plus 3 points", "pesa una arroba mas"])
def test_plain_words_are_no_disguise(text):
    assert not any(pii.find(text)[1].values())


def test_every_passage_of_a_sampled_document_teaches(spark):
    quiet, loud = "plain words in a calm row here now " * 10, "$$ ## ** %% && || << >> " * 10
    texts = [(i, quiet * 200 + (loud if i % 2 else quiet) + quiet * 61) for i in range(60)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels_ = spark.createDataFrame([(i, 1 - i % 2) for i, _ in texts], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in rows(quality_model.score(d, quality_model.train(d, labels_)))}
    assert min(got[i] for i in got if i % 2 == 0) > max(got[i] for i in got if i % 2)
