"""Licence scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines, paragraphs, runs of comment lines and the file as a whole are compared with licence templates (short statements,
headers and full texts, each version its own) by the cosine of their TF-IDF vectors. A unit that is
close to a template decides over the units inside it, so licences that share sentences are told apart by the whole. The terms are the templates' words, weighed by their document frequency over the whole
corpus; any other word weighs as one that no document has, so text around a notice lowers its cosine. A
file whose words are mostly licence text, or which is named like one, speaks for its directory. Files
without a notice inherit from the nearest directory above them that has one, by joins on paths.

Defined cases: a null or empty text has no notice; a null path has no directory and inherits nothing;
equal cosines go to the template first by name; repeated rows get equal results; an empty table gives an
empty result. Whole texts are scanned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import reach_workers, stored

LEAST_COSINE = 0.6
# From here on a unit is the template's text, and speaks for its parts too.
WHOLE_COSINE = 0.85
# Share of a file's words inside notices that makes it a licence file.
LICENCE_FILE = 0.5
LICENCE_NAME = r"(?i)^(licen[sc]e|copying|notice)(\..*)?$"

# Sentences that public licences share, statements, headers and full texts.
GNU_GRANT = ("This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
             "the Free Software Foundation{then} either version {version} of the License, or (at your option) any later version.")
GNU_WARRANTY = ("This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
GNU_COPY = "You should have received a copy of the GNU {name} along with this {what}. If not, see https://www.gnu.org/licenses/"
GNU_MAIL = ("You should have received a copy of the GNU {name} along with this {what}; if not, write to the Free Software Foundation, Inc., "
            "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")
BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
             "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
             "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
             "documentation and/or other materials provided with the distribution.")
BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
             "this software without specific prior written permission.")
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
         "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
         "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
             "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
             "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")
ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
             "copyright notice and this permission notice appear in all copies.")
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
APACHE_GRANT = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
APACHE_WARRANTY = ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
                   "and limitations under the License.")


def gnu(name: str, version: str, spdx: str, what: str = "program") -> list[str]:
    """Statement, first paragraph, whole header, title and identifiers of a GNU licence. Before version 3 the header has semicolons and an address."""
    old = float(version) < 3
    words = {"name": name, "version": version, "what": what, "mark": ";" if old else ":", "then": ";" if old else ","}
    grant, rest = GNU_GRANT.format(**words), [t.format(**words) for t in (GNU_WARRANTY, GNU_MAIL if old else GNU_COPY)]
    ids = [f"SPDX-License-Identifier: {spdx}{end}" for end in ("", "-only", "-or-later")]
    return [f"This work is licensed under the GNU {name}, version {version}.", f"GNU {name.upper()} Version {version}", grant, " ".join([grant, *rest]), *ids]


def spdx(name: str) -> str:
    return f"SPDX-License-Identifier: {name}"


TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": gnu("Affero General Public License", "3", "AGPL-3.0"),
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", APACHE_GRANT, f"{APACHE_GRANT} {APACHE_WARRANTY}", spdx("Apache-2.0")],
    "BSD-2-Clause": [f"{BSD_GRANT} {BSD_WARRANTY}", f"BSD 2-Clause License {BSD_GRANT} {BSD_WARRANTY}", spdx("BSD-2-Clause")],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.", f"{BSD_GRANT} {BSD_NAMES} {BSD_WARRANTY}",
        f"BSD 3-Clause License {BSD_GRANT} {BSD_NAMES} {BSD_WARRANTY}", spdx("BSD-3-Clause")],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", spdx("CC-BY-4.0")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", spdx("CC-BY-NC-4.0")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", spdx("CC-BY-SA-4.0")],
    "GPL-2.0": gnu("General Public License", "2", "GPL-2.0"),
    "GPL-3.0": gnu("General Public License", "3", "GPL-3.0"),
    "ISC": ["Released under the ISC License.", ISC_GRANT, f"{ISC_GRANT} {ISC_WARRANTY}", spdx("ISC")],
    "LGPL-2.1": gnu("Lesser General Public License", "2.1", "LGPL-2.1", "library"),
    "LGPL-3.0": gnu("Lesser General Public License", "3", "LGPL-3.0") + gnu("Lesser General Public License", "3", "LGPL-3.0", "library")[2:4],
    "MIT": ["Released under the MIT License.", MIT_GRANT, f"{MIT_GRANT} {AS_IS}", spdx("MIT")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.", spdx("MPL-2.0")],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", spdx("Unlicense")],
}
WORD = re.compile(r"[^\W_]+")
COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|;|%)+\s?")


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = sorted({w for ts in TEMPLATES.values() for t in ts for w in terms(t)})


def term_counts(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """(documents, documents with each template word), over all documents."""
    reach_workers(docs.sparkSession)
    known = frozenset(VOCABULARY)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = Counter(), 0
        for b in parts:
            for t in b.column(0).to_pylist():
                n.update(known.intersection(terms(t)))
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *n]), pa.array([rows, *n.values()], pa.int64())], ["t", "n"])

    found = {r["t"]: r["n"] for r in docs.select("_text").mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


class Matcher:
    """Best template of a unit of text."""

    def __init__(self, documents: int, counts: dict[str, int]):
        self.weight = {w: math.log((1 + documents) / (1 + counts.get(w, 0))) + 1 for w in VOCABULARY}
        self.other = (math.log(1 + documents) + 1) ** 2
        self.index = {w: i for i, w in enumerate(VOCABULARY)}
        self.names, rows = [], []
        for name, texts in TEMPLATES.items():
            for t in texts:
                v = np.zeros(len(VOCABULARY))
                for w, c in Counter(terms(t)).items():
                    v[self.index[w]] = c * self.weight[w]
                self.names.append(name)
                rows.append(v / np.linalg.norm(v))
        self.matrix = np.array(rows)

    def best(self, words: list[str], least: float) -> tuple[str, float] | None:
        weight = self.weight
        known = [w for w in words if w in weight]
        if not known:
            return None
        counts = Counter(known)
        inside = sum((c * weight[w]) ** 2 for w, c in counts.items())
        # The cosine cannot exceed the share of the norm that is made of template words.
        if inside < least * least * (inside + (len(set(words)) - len(counts)) * self.other):
            return None
        other = sum(c * c for c in Counter([w for w in words if w not in weight]).values()) * self.other
        v = np.zeros(len(self.index))
        for w, c in counts.items():
            v[self.index[w]] = c * weight[w]
        cos = self.matrix @ v / math.sqrt(inside + other)
        k = int(np.argmax(cos))
        return (self.names[k], float(cos[k])) if cos[k] >= least else None


def units(lines: list[list[str]], comment: list[bool]) -> Iterator[tuple[int, int]]:
    """Stretches of lines to compare, widest first: the file, runs of comment lines, paragraphs (lines with a word), lines."""
    n = len(lines)
    stretches = {(0, n)}
    yield 0, n
    for inside in (comment, [bool(w) for w in lines]):
        start = 0
        for k in range(n + 1):
            if k == n or not inside[k]:
                if k - start > 1 and (start, k) not in stretches:
                    stretches.add((start, k))
                    yield start, k
                start = k + 1
    if n > 1:
        yield from ((k, k + 1) for k in range(n))


def notices(text: str, m: Matcher, least: float) -> tuple[str | None, float, float]:
    """(licence, cosine, share of the words in notices) of a text. Inside a unit at or above WHOLE_COSINE nothing else is
    looked for; of the rest the highest cosine counts, the widest and first unit of equals."""
    rows = text.split("\n")
    lines = [terms(line) for line in rows]
    total = sum(map(len, lines))
    if not total:
        return None, 0.0, 0.0
    settled, covered = [False] * len(lines), [False] * len(lines)
    whole: list[tuple[float, str]] = []
    parts: list[tuple[float, str]] = []
    for i, j in units(lines, [COMMENT.match(r) is not None for r in rows]):
        if all(settled[i:j]):
            continue
        found = m.best([w for line in lines[i:j] for w in line], least)
        if found:
            covered[i:j] = [True] * (j - i)
            exact = found[1] >= WHOLE_COSINE
            (whole if exact and j - i > 1 else parts).append((found[1], found[0]))
            if exact:
                settled[i:j] = [True] * (j - i)
    if not whole and not parts:
        return None, 0.0, 0.0
    # A single line may be a sentence that licences share; it decides only where no longer unit does.
    cosine, licence = max(whole or parts, key=lambda f: f[0])
    return licence, cosine, sum(len(w) for w, c in zip(lines, covered) if c) / total


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", least: float = LEAST_COSINE) -> DataFrame:
    """One row per input row: `doc_id`, `path`, `own` (licence of its best notice), `cosine`, `is_licence_file`,
    `inherited_from` (directory) and `licence` (own, else inherited)."""
    d = files.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.col(path_col).cast("string").alias("path"))
    documents, counts = term_counts(d)
    reach_workers(files.sparkSession)

    @F.pandas_udf("own string, cosine double, share double")
    def read(text: pd.Series) -> pd.DataFrame:
        m = Matcher(documents, counts)
        return pd.DataFrame([notices(t, m, least) for t in text], columns=["own", "cosine", "share"])

    base = F.element_at(F.split("path", "/"), -1)
    folder = F.expr("nullif(left(path, greatest(length(path) - length(element_at(split(path, '/'), -1)) - 1, 0)), '')")
    own = d.select("_id", "path", folder.alias("dir"), read("_text").alias("r")).select(
        "_id", "path", "dir", "r.own", F.round("r.cosine", 6).alias("cosine"),
        (F.col("r.own").isNotNull() & ((F.col("r.share") >= LICENCE_FILE) | F.coalesce(base.rlike(LICENCE_NAME), F.lit(False)))).alias("is_licence_file"))
    own = stored(own, "licences")
    # The best notice of a directory's licence files speaks for it; equal ones go by name.
    verdict = own.where("is_licence_file AND dir IS NOT NULL").groupBy("dir").agg(
        F.min_by("own", F.struct(-F.col("cosine"), F.col("own"))).alias("licence")).select(F.col("dir").alias("vd"), "licence")
    parts = F.split("dir", "/")
    above = own.select("dir").where("dir IS NOT NULL").distinct().select("dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))).alias("a"))
    # Written first: adaptive execution splits a hot directory only between two plain shuffles.
    nearest = stored(above.join(verdict, F.col("a.up") == F.col("vd")).groupBy("dir").agg(
        F.max_by(F.struct("licence", "vd"), "a.depth").alias("n")).select(F.col("dir").alias("nd"), F.col("n.licence").alias("up_licence"), F.col("n.vd").alias("up")), "nearest-licences")
    return own.join(nearest, F.col("dir") == F.col("nd"), "left").select(
        F.col("_id").alias("doc_id"), "path", "own", "cosine", "is_licence_file",
        F.when(F.col("own").isNull(), F.col("up")).alias("inherited_from"), F.coalesce("own", "up_licence").alias("licence"))
