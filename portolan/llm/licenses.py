"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment verifies them.

Templates and texts are cut into words (lower-cased A-Z, without ASCII punctuation at their ends). A text's K-word
fingerprints are winnowed: of each WINDOW consecutive ones the least stays, so a shared run of K + WINDOW - 1 = 4 words
always shares one. Where a fifth of a template's words are others, a run of 4 stands unchanged in those of more than SHORT
words, of 3 in those of 6 to SHORT and of 2 in those of 5: these are looked up by all their fingerprints, the shortest by
those of 2 words. So no passage with that many words replaced is lost. The inverted index gives the templates and places
of the fingerprints; hits of one template on near diagonals are one candidate, which a banded local alignment of words
scores. Reported are candidates whose matched words cover MIN_COVERAGE of the template, with the words' and characters'
spans.

The index holds the templates only, so its size is that of the list of templates and it is sent to every worker.

Defined results: null and empty texts match nothing; a template with fewer than two words is refused; of passages that
overlap the one with the best coverage is reported, then the longest; null doc_ids and repeated rows are rows like any other; other
columns, whatever their names, aren't read; empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, byte_texts, slices, table
from .decontamination import Numbers, item_words

K = 3
WINDOW = 2
#: Templates up to so many words are looked up by all their fingerprints, those under 6 by fingerprints of 2 words.
SHORT, SHORTEST, SHORTEST_K = 15, 5, 2
MIN_COVERAGE = 0.8
BASE = 0x9E3779B97F4A7C15

# The notices and conditions of common licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly "
        "perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, "
        "sell, import, and otherwise transfer the Work.",
        "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except "
        "as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.",
        "Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its "
        "Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without "
        "limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By "
        "contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to "
        "make sure it remains free software for all its users.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "all-rights-reserved": ["All rights reserved."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public "
        "License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its "
        "users.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public "
        "License, supplemented by the additional permissions listed below.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to "
        "ensure cooperation with the community in the case of network server software.",
    ],
    "GPL-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Covered Software is provided under this License on an \"as is\" basis, without warranty of any kind, either expressed, implied, or "
        "statutory, including, without limitation, warranties that the Covered Software is free of defects, merchantable, fit for a "
        "particular purpose or non-infringing.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following:",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
        "to the public domain worldwide.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which "
        "accompanies this distribution.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}


def winnow(h, bounds, window: int = WINDOW):
    """Places of the fingerprints h that are the last least of some `window` consecutive ones in their stretch.

    bounds: the stretches' starts and, last, the number of fingerprints. A stretch shorter than the window has one window.
    """
    import numpy as np

    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64)
    end = bounds[np.searchsorted(bounds, np.arange(n), side="right")]
    at, best = np.arange(n), h.copy()
    for step in range(1, window):
        i = np.nonzero(np.arange(n) + step < end)[0]
        better = i[h[i + step] <= best[i]]
        best[better], at[better] = h[better + step], better + step
    begin = bounds[np.searchsorted(bounds, np.arange(n), side="right") - 1]
    return np.unique(at[(np.arange(n) + window <= end) | (np.arange(n) == begin)])


def align(template: list[int], words: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched, first, end) of the best local alignment of the template's words within `band` of the diagonal: a match
    counts 1, a mismatch or gap -1; matched is its number of matches and words[first:end] its span."""
    worst = (-1, 0, 0, 0)
    best = (0, 0, 0, 0)
    row: dict[int, tuple] = {}
    for i, x in enumerate(template):
        now: dict[int, tuple] = {}
        for j in range(max(0, i + diagonal - band), min(len(words), i + diagonal + band + 1)):
            score, matched, first, _ = row.get(j - 1, worst)
            if score <= 0:
                score, matched, first = 0, 0, j
            options = [(score + 1, matched + 1, first, j + 1) if words[j] == x else (score - 1, matched, first, j + 1)]
            options += [(s - 1, m, f, e) for s, m, f, e in (row.get(j, worst), now.get(j - 1, worst)) if s > 1]
            cell = max(options, key=lambda c: (c[0], c[1], -c[2]))
            if cell[0] > 0:
                now[j] = cell
                if cell[:2] > best[:2]:
                    best = cell
        row = now
    return best[1:]


def with_tags(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """The templates, and each license's identifier tag as one more."""
    return {k: [*texts, f"SPDX-License-Identifier: {k}"] for k, texts in templates.items()}


class Templates:
    """The inverted index: for each fingerprint width its sorted names with their templates and places."""

    def __init__(self, templates: dict[str, list[str]], k: int = K, window: int = WINDOW):
        import numpy as np

        from .substrings import span_names

        self.window = window
        self.labels, self.texts, self.words = [], [], {}
        found: dict = {k: [], SHORTEST_K: []}
        short: dict = {k: [], SHORTEST_K: []}
        for label, texts in templates.items():
            for text in texts:
                own = [self.words.setdefault(w, len(self.words) + 1) for w in item_words(text.encode())]
                if len(own) < SHORTEST_K:
                    raise ValueError(f"a template of {label} has fewer than {SHORTEST_K} words")
                width = SHORTEST_K if len(own) <= SHORTEST else k
                x = np.array(own, dtype=np.uint64)
                h = span_names(x, np.arange(len(x) - width + 1), np.arange(width, len(x) + 1), BASE)
                whole = len(own) <= SHORT
                places = np.arange(len(h)) if whole else winnow(h, np.array([0, len(h)]), window)
                found[width] += [(int(h[p]), len(self.texts), p) for p in places.tolist()]
                short[width] += h.tolist() if whole else []
                self.labels.append(label)
                self.texts.append(own)
        self.index = {}
        for width, entries in found.items():
            if entries:
                names, which, place = zip(*sorted(entries))
                self.index[width] = (np.array(names, dtype=np.uint64), np.array(which), np.array(place), np.unique(np.array(short[width], dtype=np.uint64)))

    def candidates(self, x, bounds, text):
        """(text, template, diagonal) of the hits among the fingerprints of the word numbers x, sorted."""
        import numpy as np

        from .substrings import span_names

        n = len(x)
        known = np.concatenate([[0], np.cumsum(x == 0)])
        out = [np.zeros((0, 3), np.int64)]
        for k, (names, which, template_place, short) in self.index.items():
            at = np.arange(max(n - k + 1, 0))
            ends = np.append(bounds, n)[np.searchsorted(bounds, at, side="right")]
            at = at[(known[at + k] == known[at]) & (at + k <= ends)]
            h = span_names(x, at, at + k, BASE)
            # stretches of consecutive places are winnowed on their own, as fingerprints with unknown words never hit
            starts = np.nonzero(np.append(True, np.diff(at) != 1))[0] if len(at) else np.zeros(0, dtype=np.int64)
            kept = np.nonzero(np.isin(h, short))[0]
            if k > SHORTEST_K:
                kept = np.union1d(winnow(h, np.append(starts, len(at)), self.window), kept)
            lo, hi = np.searchsorted(names, h[kept], side="left"), np.searchsorted(names, h[kept], side="right")
            many = hi - lo
            entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            place = np.repeat(at[kept], many)
            out.append(np.stack([text[place], which[entry], place - template_place[entry]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, x, bounds, begins, sizes, text, least: float = MIN_COVERAGE):
        """(text, template, matched, first word, end word), a text's spans apart from each other."""
        words = x.tolist()
        found: dict = {}
        last = (-1, -1, 0)
        for t, k, diagonal in self.candidates(x, bounds, text).tolist():
            template = self.texts[k]
            band = 2 + len(template) // 8
            if (t, k) == last[:2] and diagonal <= last[2]:
                continue
            last = (t, k, diagonal + band // 2)
            begin = int(begins[t])
            own = words[max(begin, diagonal - band) : min(begin + int(sizes[t]), diagonal + len(template) + band)]
            off = max(begin, diagonal - band)
            matched, first, end = align(template, own, diagonal - off, band)
            if matched >= least * len(template):
                found.setdefault(t, []).append((matched / len(template), matched, first + off - begin, end + off - begin, k))
        out = []
        for t, spans in found.items():
            taken: list = []
            for share, m, a, b, k in sorted(spans, key=lambda s: (-s[0], -s[1], s[2:])):
                if all(b <= c or a >= d for c, d in taken):
                    taken.append((a, b))
                    out.append((t, k, m, a, b))
        return sorted(out)


_NUMBERS: dict = {}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def license_matches(docs: DataFrame, templates: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text", least: float = MIN_COVERAGE) -> DataFrame:
    """(key, license, template, coverage, first_word, end_word, first_char, end_char) for each passage; characters are
    code points, ends exclusive; template counts the license's templates from 0. By default TEMPLATES and their tags."""
    told = docs.sparkSession.sparkContext.broadcast(Templates(with_tags(TEMPLATES) if templates is None else templates))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["key", "license", "template", "coverage", "first_word", "end_word", "first_char", "end_char"]
    kinds = [rows.schema["key"].dataType.simpleString(), "string", "int", "double", "int", "int", "int", "int"]

    def batches(parts):
        import numpy as np
        import pyarrow as pa

        index = told.value
        for batch in parts:
            for part in slices(batch):
                if _NUMBERS.get("of") is not index or len(_NUMBERS["numbers"]) > CACHE_ENTRIES:
                    _NUMBERS.update(of=index, numbers=Numbers(index.words))
                texts = byte_texts(part)
                words = [x.lower().split() for x in texts]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                begins = np.cumsum(sizes) - sizes
                flat = [w for ws in words for w in ws]
                x = np.fromiter(map(_NUMBERS["numbers"].__getitem__, flat), dtype=np.uint64, count=len(flat))
                out, at, places = [], -1, []
                for t, k, matched, first, end in index.matches(x, begins[sizes > 0], begins, sizes, np.repeat(np.arange(len(sizes)), sizes), least):
                    if t != at:
                        at, places = t, [m.span() for m in _WORD.finditer(texts[t].decode())]
                    label = index.labels[k]
                    out.append((t, label, k - index.labels.index(label), matched / len(index.texts[k]), first, end, places[first][0], places[end - 1][1]))
                if out:
                    t, *rest = zip(*out)
                    types = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(t)), *map(pa.array, rest, types)], names=names)

    return rows.mapInArrow(batches, ", ".join(map(" ".join, zip(names, kinds)))).withColumnRenamed("key", key)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))
