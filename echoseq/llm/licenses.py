"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are the short statements and headers by which files name a licence, the whole texts of short licences, and the
titles and openings of long ones; more can be given. Scored are a file as a whole and every run of up to as many terms as
the longest template that may fit has, across lines or within one, so a header may be wrapped or stand inside a line, and a licence file
is found by its text. Weights are term frequency times ln((1 + N) / (1 + df)) + 1 with df over all files; a term that no template has
weighs as one that no file has. A run that is a template's text scores 1 whatever the weights. Files are tokenised and
scored a batch at a time; only those whose terms hold enough of a template's weight have their runs scored, and of
those the parts that do: by Cauchy-Schwarz nothing else reaches the threshold, so nothing is lost.

A file takes the best of its own. A file without one takes that of the nearest ancestor directory
which holds a licence file (LICENSE, LICENCE, COPYING, NOTICE with any ending) with a detected licence,
the best by score, then by name, if there are several. Directories are joined, not files, so a large
directory costs one row.

Null or empty text: no licence of its own. Null path: no inheritance. Equal scores go to the first name. Long texts are
scored whole. Repeated rows give repeated rows. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as w
from .common import Scratch, text_steps

LEAST = 0.7
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9][a-z0-9]*)*")
#: Scores of runs that are made at once.
CELLS = 1 << 22
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"

# Public licence wording. Statements and headers by which files name a licence, whole short licences, titles and openings of long ones.
GNU_HEADER = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License"
GNU_LATER = ", or (at your option) any later version."
GNU_WARRANTY = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
GNU_COPIES = " Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + AS_IS,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        GNU_HEADER.format("program", ":", "", ",", "3") + ".",
        GNU_HEADER.format("program", ":", "", ",", "3") + GNU_LATER + GNU_WARRANTY.format("program", ""),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>" + GNU_COPIES + " Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        GNU_HEADER.format("program", ";", "", ";", "2") + ".",
        GNU_HEADER.format("program", ";", "", ";", "2") + GNU_LATER + GNU_WARRANTY.format("program", ""),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA" + GNU_COPIES,
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        GNU_HEADER.format("library", ":", "Lesser ", ",", "3") + ".",
        GNU_HEADER.format("library", ":", "Lesser ", ",", "3") + GNU_LATER + GNU_WARRANTY.format("library", "Lesser "),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-2.1": [
        GNU_HEADER.format("library", ";", "Lesser ", ";", "2.1") + ".",
        GNU_HEADER.format("library", ";", "Lesser ", ";", "2.1") + GNU_LATER + GNU_WARRANTY.format("library", "Lesser "),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "AGPL-3.0": [
        GNU_HEADER.format("program", ":", "Affero ", ",", "3") + ".",
        GNU_HEADER.format("program", ":", "Affero ", ",", "3") + GNU_LATER + GNU_WARRANTY.format("program", "Affero "),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "BSD-2-Clause": [BSD_START + BSD_TWO + BSD_AS_IS, "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [BSD_START + BSD_TWO + BSD_THIRD + BSD_AS_IS, "Released under the BSD 3-Clause License."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.',
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + ISC_AS_IS,
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
}


def terms(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower case; a dot before a digit belongs to the term."""
    return WORD.findall(ascii_lower(text))


def ascii_lower(text: str) -> str:
    return text.translate(UPPER)


UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ALNUM = np.zeros(256, bool)
ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the texts in a buffer, and for each text the number of its first term (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    data = w.LOWER[data]
    inside = ALNUM[data]
    dot = data == ord(".")
    dot[0] = dot[-1] = False
    dot[1:-1] &= inside[:-2] & (data[2:] >= ord("0")) & (data[2:] <= ord("9"))
    # A dot at either edge of a text belongs to no term.
    dot[off[off < len(data)]] = dot[off[off > 0] - 1] = False
    inside = inside | dot
    st, en = inside.copy(), inside.copy()
    st[1:] &= ~inside[:-1]
    en[:-1] &= ~inside[1:]
    a, b = off[off < len(data)], off[off > 0] - 1
    st[a], en[b] = inside[a], inside[b]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return w.word_hashes(data, starts, ends), np.searchsorted(starts, off)


def hash_of(term: str) -> np.uint64:
    raw = np.frombuffer(term.encode(), np.uint8)
    return w.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


class Vocabulary:
    """The templates' terms by hash."""

    def __init__(self, templates: dict[str, list[str]]):
        self.terms = sorted({t for texts in templates.values() for x in texts for t in terms(x)})
        hashes = np.array([hash_of(t) for t in self.terms], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for those that no template has."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def present(number: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, term number) of the templates' terms that each text has, once each."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = np.unique((doc * size + number)[number >= 0])
    return key // size, key % size


def document_frequencies(vocabulary: Vocabulary):
    """For each template term, the files of a task that have it; '' counts the files."""

    def run(batches):
        n, files = np.zeros(len(vocabulary.terms), np.int64), 0
        for rb in batches:
            files += rb.num_rows
            for _, _, data, off in text_steps(rb):
                hashes, first = term_hashes(data, off)
                n += np.bincount(present(vocabulary.numbers(hashes), first, len(n))[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(["", *vocabulary.terms], pa.string()), pa.array([files, *n.tolist()], pa.int64())], ["term", "n"])

    return run


class Matcher:
    """Template vectors; scores of whole texts and of runs of terms."""

    def __init__(self, df: dict[str, int], n: int, least: float = LEAST, templates: dict[str, list[str]] = TEMPLATES):
        self.least, self.rare = least, math.log(1 + n) + 1
        self.vocabulary = Vocabulary(templates)
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in self.vocabulary.terms}
        self.vectors = [(name, self.unit(terms(x))) for name, texts in sorted(templates.items()) for x in texts]
        self.names = [name for name, _ in self.vectors]
        self.weights = np.array([*(self.idf[t] for t in self.vocabulary.terms), self.rare])
        self.units = np.array([[u.get(t, 0.0) for t in self.vocabulary.terms] for _, u in self.vectors])
        self.lengths = np.array([len(terms(x)) for _, texts in sorted(templates.items()) for x in texts])
        self.longest = int(self.lengths.max())

    def unit(self, words: list[str]) -> dict[str, float]:
        v = {t: c * self.idf.get(t, self.rare) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def best(self, text: str) -> tuple[float, str] | None:
        """Highest cosine of one unit and its licence, ties to the first name; None under the threshold. The plain definition of a score."""
        v = self.unit(terms(text))
        out = None
        for name, u in self.vectors:
            s = round(sum(x * v.get(t, 0.0) for t, x in u.items()), 9)
            if s >= self.least and (out is None or s > out[0]):
                out = (s, name)
        return out

    def first_best(self, scores: np.ndarray, which: np.ndarray) -> tuple[float, str] | None:
        """The best of scores of the templates `which`, ties to the first name."""
        if not len(scores):
            return None
        scores = np.round(scores, 9)
        k = int(np.argmax(scores))
        return (float(scores[k]), self.names[which[k]]) if scores[k] >= self.least else None

    def whole(self, hashes: np.ndarray, number: np.ndarray, which: np.ndarray) -> tuple[float, str] | None:
        """Score of all terms of a text."""
        _, at, count = np.unique(hashes, return_index=True, return_counts=True)
        v = count * self.weights[number[at]]
        some = number[at] >= 0
        return self.first_best(self.units[np.ix_(which, number[at][some])] @ v[some] / np.sqrt((v * v).sum()), which)

    def runs_of(self, hashes: np.ndarray, number: np.ndarray, which: np.ndarray) -> tuple[float, str] | None:
        """The best over all runs of terms, each up to the length of the longest template of `which`."""
        longest = int(self.lengths[which].max())
        # By Cauchy-Schwarz a run that scores holds terms with `least` squared of a template's squared weight, so `longest` terms from its first one on do.
        held = np.where(number[:, None] >= 0, self.units[which].T[number] ** 2, 0.0)
        total = np.concatenate([np.zeros((1, len(which))), np.cumsum(held, axis=0)])
        end = np.minimum(np.arange(len(number)) + longest, len(number))
        start = np.flatnonzero((total[end] - total[:-1] >= self.least**2 - 1e-9).any(1))
        mark = np.zeros(len(number) + 1, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, end[start], -1)
        live = np.cumsum(mark)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]]).astype(np.int8)))
        best = np.zeros(len(which))
        for a, b in edge.reshape(-1, 2).tolist():
            for part, some in self.parts(number, a, b, which, longest):
                best[some] = np.maximum(best[some], self.run_scores(hashes[part], number[part], which[some]))
        return self.first_best(best, which)

    def parts(self, number: np.ndarray, a: int, b: int, which: np.ndarray, longest: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Overlapping parts of a stretch, of a size that one step scores, and the templates that each may fit."""
        step = max(longest, CELLS // max(1, len(which)) // 64)
        for lo in range(a, b, step):
            part = slice(lo, min(b, lo + step + longest - 1))
            here = np.unique(number[part])
            some = np.flatnonzero((self.units[np.ix_(which, here[here >= 0])] ** 2).sum(1) >= self.least**2 - 1e-9)
            if len(some):
                yield part, some

    def run_scores(self, hashes: np.ndarray, number: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each template the best cosine of a run, sizes one after the other."""
        ids = np.unique(hashes, return_inverse=True)[1]
        weight = self.weights[number]
        gain = np.where(number[:, None] >= 0, self.units[which].T[number], 0.0) * weight[:, None]
        n, w2 = len(ids), weight * weight
        # Runs of size s that begin at i: the dots with the templates, the squared norm, and how often the last term occurred before.
        dot, norm, seen, top = np.zeros((n, len(which))), np.zeros(n), np.zeros(n), np.zeros(len(which))
        for s in range(min(int(self.lengths[which].max()), n)):
            m = n - s
            if s:
                seen[s:] += ids[s:] == ids[:m]
            dot, norm = dot[:m] + gain[s:], norm[:m] + w2[s:] * (2 * seen[s:] + 1)
            np.maximum(top, (dot / np.sqrt(norm)[:, None]).max(0), out=top)
        return top

    def scan_step(self, data: np.ndarray, off: np.ndarray) -> list[tuple[float, str] | None]:
        """The best of each text of a buffer, over its runs of terms and the whole."""
        hashes, first = term_hashes(data, off)
        number = self.vocabulary.numbers(hashes)
        out: list[tuple[float, str] | None] = [None] * (len(off) - 1)
        doc, term = present(number, first, len(self.vocabulary.terms))
        if not len(doc):
            return out
        cover = np.add.reduceat(self.units.T[term] ** 2, at := np.flatnonzero(np.diff(doc, prepend=-1)), axis=0)
        fits = cover >= self.least**2 - 1e-9
        for row in np.flatnonzero(fits.any(1)).tolist():
            i, which = int(doc[at[row]]), np.flatnonzero(fits[row])
            part = slice(first[i], first[i + 1])
            found = [x for x in (self.whole(hashes[part], number[part], which), self.runs_of(hashes[part], number[part], which)) if x]
            out[i] = min(found, key=lambda x: (-x[0], x[1])) if found else None
        return out

    def scan(self, text: str | None) -> tuple[float, str] | None:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return self.scan_step(raw, np.array([0, len(raw)]))[0]

    def runs(self, text: str) -> tuple[float, str] | None:
        """The best over the runs of terms alone."""
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes, _ = term_hashes(raw, np.array([0, len(raw)]))
        return self.runs_of(hashes, self.vocabulary.numbers(hashes), np.arange(len(self.names)))


def detect(matcher: Matcher):
    def run(batches):
        for rb in batches:
            got = [x for _, _, data, off in text_steps(rb) for x in matcher.scan_step(data, off)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([x and x[1] for x in got], pa.string()), pa.array([x and x[0] for x in got], pa.float64())], ["doc_id", "path", "own", "score"])

    return run


def fit(files: DataFrame, least: float = LEAST, templates: dict[str, list[str]] = TEMPLATES) -> Matcher:
    """Document frequencies of the template terms over all files; the result is bounded by the templates."""
    counts = document_frequencies(Vocabulary(templates))
    rows = files.select(F.col("text").cast("string").alias("text")).mapInArrow(counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in rows}
    return Matcher(df, df.pop("", 0), least, templates)


def parent(path):
    """The directory of a path; '' is the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(spark: SparkSession, files: DataFrame, least: float = LEAST, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """files (doc_id, path, text) to doc_id, path, license, score, origin ('own', 'directory', null), license_dir."""
    scratch = Scratch(spark, "licenses")
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = scratch.table(files.mapInArrow(detect(fit(files, least, templates)), "doc_id long, path string, own string, score double").withColumn("dir", parent(F.col("path"))), "own")
    # max of a struct with the reversed order of names is not at hand, so ties go to the least by a second pass on max score.
    licensed = own.where(F.col("own").isNotNull() & F.col("path").rlike(LICENSE_FILE)).groupBy("dir").agg(F.min(F.struct(-F.col("score"), "own")).alias("best")).select(F.col("dir").alias("license_dir"), F.col("best.own").alias("license"), (-F.col("best.col1")).alias("dir_score"))
    dirs = own.where("own is null and dir is not null").select("dir").distinct()
    # A directory and its ancestors: the prefixes of its path.
    parts = F.split("dir", "/")
    chain = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    up = dirs.select("dir", F.explode(chain).alias("license_dir")).join(licensed, "license_dir")
    nearest = up.groupBy("dir").agg(F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "license", "dir_score")).alias("near"))
    nearest = scratch.table(nearest.select("dir", "near.license_dir", "near.license", "near.dir_score"), "nearest")
    out = own.join(nearest, "dir", "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path",
        F.when(mine, F.col("own")).otherwise(F.col("license")).alias("license"),
        F.round(F.when(mine, F.col("score")).otherwise(F.col("dir_score")), 6).alias("score"),
        F.when(mine, F.lit("own")).when(F.col("license").isNotNull(), F.lit("directory")).alias("origin"),
        F.when(~mine, F.col("license_dir")).alias("license_dir"),
    )
