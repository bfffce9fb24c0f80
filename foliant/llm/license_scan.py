"""License scans: matches of license templates in texts, by winnowed fingerprints and banded alignment.

Words are lower-cased and without punctuation at their ends. A match is a run of the text within floor(n / 5) edits
(words changed, left out or put in) of the whole template of n words. However the edits lie, some run of the template
stays whole; its least length follows from n, and shingle and window are chosen for it: of every window of neighbouring
shingles the one with the least hash is a fingerprint, and each whole run has one. An inverted index gives the
templates and places of a fingerprint; every shingle of a document is looked up. Candidates with fewer of the template's
words around than a match must have are left out; a banded alignment of the template with the text around it confirms
the others. Its matched words over the template's words is the coverage, and runs of matched words are spans.

Words in braces tell a license from its siblings (its name, version or variant): they must be matched, and those that
stand together in the template must stand together in the text. Matches that overlap count once, the one of most
matched words: a notice wins over a line inside it, and a license over a shorter sibling. Null, blank and unlicensed
texts have none. Templates are a list from the user, small beside the documents, which are only scanned. Repeated rows
stay, null ids too.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WORD, enough_near, pieces, split_words

#: Longest shingle and window; shorter where a template's whole runs can be shorter. Edits allowed: one word in so many.
SHINGLE, WINDOW, ONE_IN = 3, 4, 5
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»–—…"
MASK = (1 << 61) - 1

#: Lines and notices that texts carry, as their licenses word them; what tells them apart in braces.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the {Apache} License, Version {2.0}.",
    "cc-by-4.0-line": "Licensed under {CC BY 4.0}.",
    "cc-by-nc-4.0-line": "Licensed under {CC BY-NC 4.0}.",
    "cc-by-nc-nd-4.0-line": "Licensed under {CC BY-NC-ND 4.0}.",
    "cc-by-nc-sa-4.0-line": "Licensed under {CC BY-NC-SA 4.0}.",
    "cc-by-nd-4.0-line": "Licensed under {CC BY-ND 4.0}.",
    "cc-by-sa-4.0-short": "Licensed under {CC BY-SA 4.0}.",
    "cc-by-4.0-long": "This work is licensed under a {Creative Commons Attribution 4.0} International License.",
    "cc-by-nc-4.0-long": "This work is licensed under a {Creative Commons Attribution-NonCommercial 4.0} International License.",
    "cc-by-nc-nd-4.0-long": "This work is licensed under a {Creative Commons Attribution-NonCommercial-NoDerivatives 4.0} International License.",
    "cc-by-nc-sa-4.0-long": "This work is licensed under a {Creative Commons Attribution-NonCommercial-ShareAlike 4.0} International License.",
    "cc-by-nd-4.0-long": "This work is licensed under a {Creative Commons Attribution-NoDerivatives 4.0} International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a {Creative Commons Attribution-ShareAlike 4.0} International License.",
    "gpl-2-line": "This work is licensed under the {GNU General Public License, version 2}.",
    "gpl-3-line": "This work is licensed under the {GNU General Public License, version 3}.",
    "lgpl-2.1-line": "This work is licensed under the {GNU Lesser General Public License, version 2.1}.",
    "lgpl-3-line": "This work is licensed under the {GNU Lesser General Public License, version 3}.",
    "agpl-3-line": "This work is licensed under the {GNU Affero General Public License, version 3}.",
    "mit-line": "Released under the {MIT} License.",
    "apache-2.0-notice": 'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": 'Permission is hereby granted, {free of charge}, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose {with or without fee} is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "gpl-2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation; either {version 2} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {GNU General Public License} for more details.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {GNU General Public License} for more details.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation; either {version 2.1} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {GNU Lesser General Public License} for more details.",
    "lgpl-3-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {GNU Lesser General Public License} for more details.",
    "agpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {GNU Affero General Public License} for more details.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: The clauses that licenses of the BSD family share, and the third that only one of them has.
TWO_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
THIRD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote products} derived from this software without specific prior written permission. "
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES |= {"bsd-2": TWO_CLAUSES + DISCLAIMER, "bsd-3": TWO_CLAUSES + THIRD_CLAUSE + DISCLAIMER}
#: More whole licenses, heads of license files, and the names that identifiers give licenses.
WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
TEMPLATES |= {
    "mit": TEMPLATES["mit-notice"] + WARRANTY,
    "zlib": "This software is provided {'as-is', without any express or implied warranty}. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "mit-head": "{MIT License} Copyright (c)", "isc-head": "{ISC License} Copyright (c)", "bsd-2-head": "{BSD 2-Clause License} Copyright (c)", "bsd-3-head": "{BSD 3-Clause License} Copyright (c)",
    "apache-2.0-head": "{Apache License Version 2.0}, January 2004", "mpl-2.0-head": "{Mozilla Public License Version 2.0}", "gpl-2-head": "{GNU GENERAL PUBLIC LICENSE Version 2}, June 1991", "gpl-3-head": "{GNU GENERAL PUBLIC LICENSE Version 3}, 29 June 2007",
}
IDENTIFIERS = "MIT ISC Zlib BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 Unlicense".split()
TEMPLATES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {{{x}}}" for x in IDENTIFIERS}
#: Words that, right before a match, say that the license does not hold.
DENIALS = {"not", "never", "isn't", "aren't", "nor"}


def bare(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=PUNCTUATION)


def mixed(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes, each with one word more."""
    out = (hashes * 1_000_003 + words * 7_919 + 13) & MASK
    return ((out ^ out >> 31) * 40_503 + 11) & MASK


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, given as numbers."""
    out = np.zeros(max(0, len(words) - size + 1), np.int64)
    for i in range(size):
        out = mixed(out, words[i : len(out) + i])
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """The places of fingerprints: of each window the rightmost least hash; all places where there are fewer than a window."""
    if len(hashes) <= window:
        return list(range(len(hashes)))
    return sorted({i + window - 1 - int(np.argmin(hashes[i : i + window][::-1])) for i in range(len(hashes) - window + 1)})


@dataclass
class Index:
    names: list[str]
    words: dict[str, int] = field(default_factory=dict)
    templates: list[np.ndarray] = field(default_factory=list)
    #: of each template the runs [first, end) of words that must be matched together
    marks: list[list[tuple[int, int]]] = field(default_factory=list)
    #: (template, word) of the words that a template has, as sorted numbers
    members: np.ndarray | None = None
    #: shingle size: sorted hashes, their templates and places
    inverted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def template_words(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a template, and the runs of them that stand in braces."""
    words, marks = [], []
    for i, part in enumerate(re.split(r"\{([^{}]*)\}", text or "")):
        new = [x for x in bare(pa.array(part.split(), pa.string())).to_pylist() if x]
        if i % 2 and new:
            marks.append((len(words), len(words) + len(new)))
        words += new
    return words, marks


def build(templates: dict[str, str], one_in: int = ONE_IN) -> Index:
    kept = {k: w for k, v in templates.items() if (w := template_words(v))[0]}
    index = Index(list(kept), marks=[m for _, m in kept.values()])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, (words, _) in enumerate(kept.values()):
        numbers = np.array([index.words.setdefault(w, len(index.words) + 1) for w in words], np.int64)
        index.templates.append(numbers)
        edits = len(numbers) // one_in
        whole = -(-(len(numbers) - edits) // (edits + 1))  # words of some run that no edit touches
        size = min(SHINGLE, whole)
        hashes = shingle_hashes(numbers, size)
        found.setdefault(size, []).extend((int(hashes[i]), k, i) for i in winnow(hashes, min(WINDOW, whole - size + 1)))
    index.members = np.unique(np.array([k * (len(index.words) + 1) + x for k, w in enumerate(index.templates) for x in set(w.tolist())], np.int64))
    for size, rows in found.items():
        h, k, i = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
        index.inverted[size] = h, k, i
    return index


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
    """Edits, and pairs of matched places, of the best alignment of the whole template with some run of the text whose place less the template's stays within low and high. Row by row over all diagonals at once."""
    n, width = len(template), high - low + 1
    step, cost = np.arange(width, dtype=np.int32), np.zeros((n + 1, width), np.int32)
    at = np.arange(low, high + 1)
    inside = lambda i: np.where((at + i >= 0) & (at + i < len(text)), text[np.clip(at + i, 0, len(text) - 1)], -1)
    for i in range(n):
        row = cost[i] + (inside(i) != template[i])
        row[:-1] = np.minimum(row[:-1], cost[i, 1:] + 1)
        cost[i + 1] = np.minimum.accumulate(row - step) + step
    j = int(np.argmin(cost[n]))
    i, edits, out = n, int(cost[n, j]), []
    while i > 0:
        place = i - 1 + low + j
        same = 0 <= place < len(text) and text[place] == template[i - 1]
        if cost[i, j] == cost[i - 1, j] + (not same):
            if same:
                out.append((i - 1, place))
            i -= 1
        elif j + 1 < width and cost[i, j] == cost[i - 1, j + 1] + 1:
            i, j = i - 1, j + 1
        else:
            j -= 1
    return edits, out[::-1]


def marked(marks: list[tuple[int, int]], pairs: list[tuple[int, int]]) -> bool:
    """Whether all runs of marked words are matched, each by neighbouring words."""
    place = dict(pairs)
    return all(a in place and all(place.get(i) == place[a] + i - a for i in range(a, b)) for a, b in marks)


def matches(index: Index, texts: pa.Array, one_in: int = ONE_IN) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(text, template, matched words, first, end, matched places) of each match; places are word numbers in the text."""
    flat, owner = split_words(texts)
    if not len(flat) or not index.words:
        return []
    coded = flat.dictionary_encode()
    distinct = bare(coded.dictionary)
    number = pc.fill_null(pc.add(pc.index_in(distinct, pa.array(index.words, distinct.type)), 1), 0).to_numpy().astype(np.int64)
    number[pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)] = -1
    words = number[coded.indices.to_numpy()]
    words, owner = words[words >= 0], owner[words >= 0]
    known, hits = np.r_[0, np.cumsum(words > 0)], []
    lengths = np.fromiter(map(len, index.templates), np.int64, len(index.templates))
    starts, ends = (np.searchsorted(owner, np.arange(len(texts)), side=side) for side in ("left", "right"))
    for size, (keys, who, place) in index.inverted.items():
        if len(words) < size:
            continue
        at = np.flatnonzero((known[size:] - known[:-size] == size) & (owner[size - 1 :] == owner[: len(owner) - size + 1]))
        grams = np.zeros(len(at), np.int64)
        for i in range(size):
            grams = mixed(grams, words[at + i])
        lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
        hit = np.flatnonzero(hi > lo)
        many = (hi - lo)[hit]
        k = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        p = np.repeat(at[hit], many)
        doc, template, shift = owner[p], who[k], p - place[k]
        n, edits = lengths[template], lengths[template] // one_in
        some = enough_near(words, np.maximum(starts[doc], shift - edits), np.minimum(ends[doc], shift + n + edits), template, index.members, len(index.words) + 1, edits)
        hits += zip(doc[some].tolist(), template[some].tolist(), shift[some].tolist(), strict=True)
    out, tried = [], {}
    for doc, k, shift in sorted(set(hits)):
        template = index.templates[k]
        edits = len(template) // one_in
        if shift <= tried.get((doc, k), -(1 << 60)):
            continue
        tried[doc, k] = shift + edits  # the alignment below covers all that goes through these diagonals
        first, end = int(starts[doc]), int(ends[doc])
        lo, hi = max(first, shift - edits), min(end, shift + len(template) + 3 * edits)
        cost, pairs = align(template, words[lo:hi], shift - edits - lo, shift + 2 * edits - lo)
        if pairs and cost <= edits and marked(index.marks[k], pairs):
            places = [lo - first + at for _, at in pairs]
            out.append((doc, k, len(pairs), places[0], places[-1] + 1, places))
    kept: dict[int, list[tuple[int, int]]] = {}
    best = []
    for m in sorted(out, key=lambda x: (-x[2], x[4] - x[3], x[3], x[1])):  # of overlapping matches the one of most words
        taken = kept.setdefault(m[0], [])
        i = bisect.bisect_left(taken, (m[4],))
        if not i or taken[i - 1][1] <= m[3]:
            taken.insert(i, (m[3], m[4]))
            best.append(m)
    return sorted(best, key=lambda m: (m[0], m[3], m[1]))


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end, in code points, of each word that is not mere punctuation."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(WORD, text)]
    some = bare(pa.array([w for *_, w in found], pa.string())).to_pylist()
    return [(a, b) for (a, b, _), w in zip(found, some, strict=True) if w]


COLUMNS = "doc_id long, template string, coverage double, matched long, template_words long, start long, end long, spans string, denied boolean"


def runs(places: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring places."""
    cuts = [i for i in range(1, len(places)) if places[i] != places[i - 1] + 1]
    return [(places[a], places[b - 1]) for a, b in pairwise([0, *cuts, len(places)])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """COLUMNS for each match in each row of docs (doc_id, text). start, end and spans (start:end, comma-joined) are code points, end exclusive; denied: the word before it is one of `DENIALS`."""
    index = docs.sparkSession.sparkContext.broadcast(build(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, places = [], {}
            for doc, k, matched, _, _, at in matches(index.value, batch.column(1)):
                if doc not in places:
                    text = batch.column(1)[doc].as_py()
                    places = {doc: word_places(text)}
                spans = [(places[doc][a][0], places[doc][b][1]) for a, b in runs(at)]
                n = len(index.value.templates[k])
                before = text[slice(*places[doc][at[0] - 1])].lower().strip(PUNCTUATION) if at[0] else ""
                rows.append((batch.column(0)[doc].as_py(), index.value.names[k], matched / n, matched, n, spans[0][0], spans[-1][1], ",".join(f"{a}:{b}" for a, b in spans), before in DENIALS))
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[c.split()[1]]) for x, c in zip(columns, COLUMNS.split(", "), strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)
