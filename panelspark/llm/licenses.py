"""License scans by patience alignment (operator 5).

Texts and templates are words, lower-cased, with ASCII punctuation as blanks. A template is sought in windows
of 1, 1.5 and 2 times its length that begin at each place of the whole text whose word is among the template's
first words (so many that one of them must be aligned). In a window, words that are unique to both sides are the
anchors, the longest increasing subsequence of them is kept, and the gaps between are aligned in the same
way after equal ends are taken off. The template's coverage is its share of aligned words; the aligned part of
the text must not be more than twice as long as the words aligned in it. The words that tell a license from its
neighbours (name, version, NC or SA) must stand in the aligned part as they stand in the template, without a
word between. Of licenses whose places overlap only the one with the most aligned words stays.

A window is aligned only if it has as many words of the template, and as many different ones, as the coverage
asks for; as aligned words are words of the template, that leaves out no license.

Edge cases: null, empty and blank texts hold no license; a text that repeats a license reports its best
place, the first of equals; repeated rows are reported as often as they come, null ids as they are; templates
without words match nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, word_hashes

#: Texts of public licenses and the usual notices of their use.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "bsd-notice": "Released under the BSD License.",
    "isc-notice": "Released under the ISC License.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "mit-part": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "apache-2.0-part": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3.0-part": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "gpl-2.0-part": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "lgpl-2.1-part": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."
    ),
    "lgpl-3.0-part": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "agpl-3.0-part": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "bsd-part": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "isc-part": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

_MIT_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
    "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_THIRD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
    "the License for the specific language governing permissions and limitations under the License."
)


def _gnu_rest(what: str, name: str) -> str:
    return (
        f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more "
        f"details. You should have received a copy of the GNU {name} along with this {what}. If not, see "
        "<https://www.gnu.org/licenses/>."
    )


# Whole license texts, and the whole notices of licenses that are used by notice.
TEMPLATES |= {
    "mit": TEMPLATES["mit-part"] + _MIT_WARRANTY,
    "isc": TEMPLATES["isc-part"] + _ISC_WARRANTY,
    "bsd-2-clause": TEMPLATES["bsd-part"] + _BSD_WARRANTY,
    "bsd-3-clause": TEMPLATES["bsd-part"] + _BSD_THIRD + _BSD_WARRANTY,
    "apache-2.0": TEMPLATES["apache-2.0-part"] + _APACHE_REST,
    "gpl-2.0": TEMPLATES["gpl-2.0-part"] + _gnu_rest("program", "General Public License"),
    "gpl-3.0": TEMPLATES["gpl-3.0-part"] + _gnu_rest("program", "General Public License"),
    "lgpl-2.1": TEMPLATES["lgpl-2.1-part"] + _gnu_rest("library", "Lesser General Public License"),
    "lgpl-3.0": TEMPLATES["lgpl-3.0-part"] + _gnu_rest("program", "Lesser General Public License"),
    "agpl-3.0": TEMPLATES["agpl-3.0-part"] + _gnu_rest("program", "Affero General Public License"),
}

#: Phrases that must stand in the aligned part word for word; the other texts differ from all others anyway.
PHRASES = {
    "mit-notice": ("MIT License",),
    "bsd-notice": ("BSD License",),
    "isc-notice": ("ISC License",),
    "apache-2.0-notice": ("Apache License", "Version 2.0"),
    "apache-2.0": ("Apache License", "Version 2.0"),
    "mpl-2.0-notice": ("Mozilla Public License", "Version 2.0"),
    "gpl-2.0-notice": ("GNU General Public License", "version 2"),
    "gpl-3.0-notice": ("GNU General Public License", "version 3"),
    "lgpl-2.1-notice": ("GNU Lesser General Public License", "version 2.1"),
    "lgpl-3.0-notice": ("GNU Lesser General Public License", "version 3"),
    "agpl-3.0-notice": ("GNU Affero General Public License", "version 3"),
    "gpl-2.0": ("GNU General Public License", "version 2"),
    "gpl-3.0": ("GNU General Public License", "version 3"),
    "lgpl-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License", "version 3"),
    "agpl-3.0": ("GNU Affero General Public License", "version 3"),
    "cc-by-4.0-notice": ("CC BY 4.0",),
    "cc-by-sa-4.0-notice": ("CC BY-SA 4.0",),
    "cc-by-nd-4.0-notice": ("CC BY-ND 4.0",),
    "cc-by-nc-4.0-notice": ("CC BY-NC 4.0",),
    "cc-by-nc-sa-4.0-notice": ("CC BY-NC-SA 4.0",),
    "cc-by-nc-nd-4.0-notice": ("CC BY-NC-ND 4.0",),
    "bsd-3-clause": ("Neither the name of", "endorse or promote"),
}
PHRASES |= {f"{k}-part": PHRASES[k] for k in ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0")}

#: Least share of a template's words that must be aligned.
COVERAGE = 0.8
_BLANKS = bytes(b if b >= 128 or chr(b).isalnum() or b in b" \t\n\v\f\r" else 32 for b in range(256)).lower()


def words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_BLANKS))


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = last[k - 1] if k else -1
        tops[k : k + 1], last[k : k + 1] = [v], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), in order, by patience."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        n, m = Counter(text[a:b]), Counter(template[c:d])
        at = {w: c + j for j, w in enumerate(template[c:d])}
        anchors = [(a + i, at[w]) for i, w in enumerate(text[a:b]) if n[w] == 1 and m.get(w) == 1]
        kept = [anchors[i] for i in _increasing([y for _, y in anchors])]
        if kept:
            out += kept
            ends = [(a - 1, c - 1), *kept, (b, d)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _place(part: list, whole: list) -> tuple[int, int]:
    """First and end place of a part in a list that has it."""
    return next((i, i + len(part)) for i in range(len(whole)) if whole[i : i + len(part)] == part)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, phrases: dict[str, tuple[str, ...]]):
        self.coverage = coverage
        self.names = [k for k, v in templates.items() if len(words(v))]
        every = [words(templates[k]) for k in self.names]
        self.lists = [w.tolist() for w in every]
        self.phrases = [[_place(words(x).tolist(), w) for x in phrases.get(k, ())] for k, w in zip(self.names, self.lists, strict=True)]
        # Numbers of the words that templates have; the last number stands for all others.
        self.vocabulary = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        numbers = [np.searchsorted(self.vocabulary, w) for w in every]
        self.needed = [math.ceil(coverage * len(w) - 1e-9) for w in every]
        self.member = np.zeros((len(every), len(self.vocabulary) + 1), bool)
        self.head = self.member.copy()
        for k, (w, least) in enumerate(zip(numbers, self.needed, strict=True)):
            self.member[k, w] = True
            # One of the first words is aligned, or more than may be missing are not.
            self.head[k, w[: len(w) - least + 1]] = True
        self.different = [len(set(w)) - (len(w) - least) for w, least in zip(self.lists, self.needed, strict=True)]

    def sizes(self, k: int) -> list[int]:
        n = len(self.lists[k])
        return sorted({n, math.ceil(1.5 * n), 2 * n})

    def _windows(self, k: int, numbers: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int]]:
        """Windows (begin, end) that can hold the template: enough of its words, and enough different ones."""
        hits = known[self.member[k][numbers[known]]]
        if len(hits) < self.needed[k]:
            return
        begins = self.head[k][numbers[hits]]
        counts = [np.searchsorted(hits, hits + size) - np.arange(len(hits)) for size in self.sizes(k)]
        for i in np.flatnonzero(begins & (counts[-1] >= self.needed[k])).tolist():
            for size, count in zip(self.sizes(k), counts, strict=True):
                if count[i] >= self.needed[k] and len(set(numbers[hits[i : i + count[i]]].tolist())) >= self.different[k]:
                    yield int(hits[i]), min(len(numbers), int(hits[i]) + size)

    def _place(self, k: int, text: list, a: int, b: int) -> tuple[int, int, int] | None:
        """Aligned words, first word and end word of a template in a window; None if it isn't there."""
        pairs = align(text[a:b], self.lists[k])
        if not pairs:
            return None
        first, end = a + pairs[0][0], a + pairs[-1][0] + 1
        if len(pairs) / len(self.lists[k]) < self.coverage or end - first > 2 * len(pairs):
            return None
        at = {j: i for i, j in pairs}
        for low, high in self.phrases[k]:
            if any(j not in at or at[j] != at.get(low, -1) + j - low for j in range(low, high)):
                return None
        return len(pairs), first, end

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) of the best place of every license found."""
        w = words(text)
        if not len(w) or not len(self.vocabulary):
            return []
        numbers = np.minimum(np.searchsorted(self.vocabulary, w), len(self.vocabulary) - 1)
        numbers[self.vocabulary[numbers] != w] = len(self.vocabulary)
        known = np.flatnonzero(numbers < len(self.vocabulary))
        found, as_list = set(), None
        for k in range(len(self.names)):
            whole = 0
            for a, b in self._windows(k, numbers, known):
                # Inside a copy that is there word for word nothing better begins.
                if a < whole:
                    continue
                as_list = as_list or w.tolist()
                if place := self._place(k, as_list, a, b):
                    found.add((-place[0], -place[0] / len(self.lists[k]), place[2] - place[1], *place[1:], k))
                    if place[0] == len(self.lists[k]) == place[2] - place[1]:
                        whole = place[2]
        return self.compete(found)

    def compete(self, found: set[tuple[int, float, int, int, int, int]]) -> list[tuple[str, float, int, int]]:
        """Licenses compete for a place: the one with the most aligned words takes it, then the one that spans least.

        found: less the aligned words, less the coverage, span, first word, end word, number of the template.
        """
        taken: list[tuple[int, int]] = []
        best: dict[int, tuple[float, int, int]] = {}
        for _, share, _, first, end, k in sorted(found):
            at = bisect_left(taken, (first, end))
            if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end):
                continue
            taken.insert(at, (first, end))
            if k not in best or (share, first) < best[k][:2]:
                best[k] = share, first, end
        return [(self.names[k], -share, first, end) for k, (share, first, end) in sorted(best.items())]


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, phrases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document and license in it: doc_id, license, coverage, first_word, end_word.

    phrases are words of a template that must stand in the text as they are; templates of one's own have none.
    """
    phrases = phrases or (PHRASES if templates is None else {})
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, coverage, phrases))
    fields = [("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]

    def batch(texts: list[str | None]) -> list[pa.Array]:
        names = [n for n, _ in fields]
        rows = [[dict(zip(names, hit, strict=True)) for hit in shared.value.scan(t)] for t in texts]
        return [pa.array(rows, pa.list_(pa.struct(fields)))]

    hits = map_texts(docs, ["doc_id"], batch, "hits array<struct<license:string,coverage:double,first_word:bigint,end_word:bigint>>")
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
