"""Personal identifiers, also where they are disguised.

Emails, IP addresses, card and phone numbers are found in the text as it stands (the base), and again
after a chain of transducers has undone look-alike characters, spelled digits and written-out "at" and
"dot". Each transducer keeps, for every character it writes, the stretch of source text it came from, so
that what is found in the normalised text is reported at its place in the source. Found spans are added
where they overlap no base span of their kind; base spans always stay. Offsets are code points.

Defined cases: a null or empty text has no spans; repeated rows get equal spans; an empty table gives
an empty result. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhound.llm.common import reach_workers, whole

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int]

# The four base patterns. Look-behinds only spare hopeless starts: a run of digits that
# fails at its first digit fails at every later one.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping. Works outwards from each @, so a long text without one costs a scan."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    """The four kinds in `text`."""
    digits = any(c in text for c in "0123456789")
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχι",
    "ABESIJKMHOPCTXYaesijopcyxhdqwABEZHIKMNOPTYXavopuxi"))
HIDDEN = "­​‌‍‎‏⁠﻿"
DASHES = "‐‑‒–—−"
# Digit words, nought to nine, in the languages of the corpus.
DIGIT_WORDS = {
    w: str(d) for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for d, w in enumerate(words.split())} | {"oh": "0"}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
ODD = re.compile("[^\x00-ſ]|[" + HIDDEN + "\xa0]")
_SPOKEN_DOT = "dot|punto|punkt|point"
SPELLED = re.compile(rf"\b(?:(?:{_DIGIT})\b(?:[\x20-]+|\s*,\s*)(?:(?:{_SPOKEN_DOT})\x20+)?){{2,}}(?:{_DIGIT})\b", re.I)
DIGIT = re.compile(rf"\b(?:{_DIGIT}|{_SPOKEN_DOT})\b", re.I)
PLUS = re.compile(r"\bplus\s+(?=[0-9])", re.I)
AT, DOT = r"(?:at|arroba|@)", r"(?:dot|punto|punkt|point|\.)"
BOXED_AT = re.compile(rf"(?<=[A-Za-z0-9])\s*[\[({{<]\s*{AT}\s*[\])}}>]\s*(?=[A-Za-z0-9])", re.I)
BOXED_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s*[\[({{<]\s*{DOT}\s*[\])}}>]\s*(?=[A-Za-z0-9])", re.I)
SPACED_DOT = re.compile(rf"(?<=[A-Za-z0-9])\x20+(?:{_SPOKEN_DOT}|\.)\x20+(?=[A-Za-z0-9])", re.I)
# A dot that was written out, until all rules are through.
WRITTEN_DOT = ""
_NAME = r"[A-Za-z0-9-]+"
SPACED_AT = re.compile(
    rf"(?<=[A-Za-z0-9])\x20+{AT}\x20+(?={_NAME}(?:\.{_NAME})*{WRITTEN_DOT}{_NAME})"
    rf"|(?<=[A-Za-z0-9])(?:\x20*@\x20*|\x20+arroba\x20+)(?={_NAME}(?:[.{WRITTEN_DOT}]{_NAME})*[.{WRITTEN_DOT}][A-Za-z]{{2}})", re.I)
# "name at host.com" counts where the name looks like an account: it has a digit or one of ._+-
PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])\x20at\x20(?={_NAME}(?:\.{_NAME})*\.(?:com|org|net|edu|gov|io|info|co|de|fr|es|uk)\b)", re.I)
MARKS = re.compile(rf"[\[({{<]\s*(?:{AT}|{DOT})\s*[\])}}>]", re.I)


class Tape:
    """Text whose every character knows the source stretch it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace each match by what `write` gives: characters with the (tape) stretch each stands for."""
        text, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[last:m.start()])
            start += self.start[last:m.start()]
            end += self.end[last:m.start()]
            for c, a, b in write(m):
                text.append(c)
                start.append(self.start[a])
                end.append(self.end[b - 1])
            last = m.end()
        if last:
            self.text = "".join(text) + self.text[last:]
            self.start = start + self.start[last:]
            self.end = end + self.end[last:]


def plain(m: re.Match) -> list[tuple[str, int, int]]:
    """The Latin form of an odd character; none of a hidden one."""
    c = m[0]
    if c in HIDDEN:
        return []
    form = LOOK_ALIKES.get(c) or ("-" if c in DASHES else None) or unicodedata.normalize("NFKC", c)
    return [(x, m.start(), m.end()) for x in form]


def sign(c: str) -> Callable[[re.Match], list[tuple[str, int, int]]]:
    return lambda m: [(c, m.start(), m.end())]


def digits(m: re.Match) -> list[tuple[str, int, int]]:
    return [(DIGIT_WORDS.get(w[0].lower(), "."), *w.span()) for w in DIGIT.finditer(m.string, m.start(), m.end())]


def account_at(m: re.Match) -> list[tuple[str, int, int]]:
    name = m.string[m.string.rfind(" ", 0, m.start()) + 1:m.start()]
    if any(c in "0123456789._+-" for c in name[:-1]):
        return [("@", m.start(), m.end())]
    return [(m.string[i], i, i + 1) for i in range(m.start(), m.end())]


# Marks that may stand at a word, by the space that parts it from them.
PARTED = dict.fromkeys(map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~«»“”„‘’…"), " ")


def spells_digits(low: str) -> bool:
    """Whether at least three words of the lower-case text are digit words."""
    return len([w for w in low.translate(PARTED).split() if w in DIGIT_WORDS]) > 2


def normalise(text: str) -> Tape | None:
    """The text with its disguises undone, or None where it has none. Each rule is tried only
    where a cheaper look finds what it needs."""
    low = text.lower()
    odd = not text.isascii() and ODD.search(text) is not None
    # An odd character may hide any of the rest.
    spelled = odd or spells_digits(low) and SPELLED.search(text) is not None
    marked = odd or any(s in low for s in (" @", "@ ", " arroba ", " dot ", " punto ", " punkt ", " point ", " . ")) or (
        "plus" in low and PLUS.search(text) is not None) or (
        " at " in low and PLAIN_AT.search(text) is not None) or (
        any(c in text for c in "([{<") and MARKS.search(text) is not None)
    if not (odd or spelled or marked):
        return None
    tape = Tape(text)
    if odd:
        tape.rewrite(ODD, plain)
    for pattern, write in (
            (SPELLED, digits), (PLUS, sign("+")), (BOXED_DOT, sign(WRITTEN_DOT)), (SPACED_DOT, sign(WRITTEN_DOT)),
            (BOXED_AT, sign("@")), (SPACED_AT, sign("@")), (PLAIN_AT, account_at)):
        tape.rewrite(pattern, write)
    tape.text = tape.text.replace(WRITTEN_DOT, ".")
    return tape


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind, in order of their start."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, base
    every = {}
    for kind, spans in detect(tape.text).items():
        more = [(tape.start[a], tape.end[b - 1]) for a, b in spans]
        own = base[kind]
        every[kind] = sorted(own + [(a, b) for a, b in more if not any(a < d and c < b for c, d in own)])
    return base, every


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of all spans by kind, the checksum of the base spans, all spans as text, and as
    `found` with kind, offsets and the identifier in its normalised form's source text."""
    d = whole(docs, id_col, text_col)
    reach_workers(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, names, found, counts = [], [], [], {k: [] for k in KINDS}
            for text in b.column(1).to_pylist():
                base, every = find(text)
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                names.append(listed(every))
                for k in KINDS:
                    counts[k].append(len(every[k]))
                found.append([{"kind": k, "start": s, "end": e, "source": text[s:e]} for k in KINDS for s, e in every[k]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(sha, pa.string()), pa.array(names, pa.string()), pa.array(found, pa.list_(item))],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "found"])

    kind = d.schema["_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS)
                        + ", base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,source:string>>")
