"""Plain-Python versions of the corpus operators' rules, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"


def words(text):
    return [w for w in BLANKS.split(text or "") if w]


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = words(text)
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for k, x in enumerate(windows) if n[x] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in SYMBOLS), dup, len(covered)


def repeats(texts, match=200):
    """Per text (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[s:s + match] for t in raw for s in range(len(t) - match + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - match + 1):
            if n[t[s:s + match]] > 1:
                gone[s:s + match] = b"\1" * match
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def shingles(text, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(texts, threshold=0.8):
    """(links, least index reached) of each text; texts without words are copies of one another."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = Counter()
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {()}:
            held[x].append(i)
    both = Counter((v[a], v[b]) for v in held.values() for b in range(len(v)) for a in range(b))
    for (i, j), n in both.items():
        union = len(sets[i]) + len(sets[j]) - n
        if not sets[i] or n >= threshold * union - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(links[i], find(i)) for i in range(len(texts))]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def identifiers(text):
    text = text or ""

    def digits(s):
        return re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


def line_pairs(docs, rare=100, least_line=16):
    """{later: [first holders it is aligned with]} for {id: text}, ids in order."""
    lines = {i: (t or "").split("\n") for i, t in docs.items()}
    held = defaultdict(list)
    for i in sorted(lines):
        for s in {s for s in lines[i] if len(s) >= least_line and words(s)}:
            held[s].append(i)
    dfs = defaultdict(list)
    for v in held.values():
        for i in v[1:]:
            dfs[i, v[0]].append(len(v))
    return lines, [p for p, n in dfs.items() if min(n) <= rare or len(n) > 1]


LONG = "lorem ipsum dolor sit amet " * 4000
# Names that operators use for columns of their own.
CLASHES = ["_id", "_text", "d", "h", "c", "key", "pos", "row", "kept", "gone", "score", "host", "w", "t", "n", "root", "rank", "label", "_label", "salt"]


def awkward(spark, extra=()):
    """Null ids and texts, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one two three"), (5, "one two three"), (5, "another text under the same id"),
            (None, "text without an id, at least " + "so many words " * 20), (None, None), (6, LONG), (7, "é" * 300), (8, "\x00\x1c odd \x1f blanks"), *extra]
    df = spark.createDataFrame([(i, t, "en", "src" if i else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})
