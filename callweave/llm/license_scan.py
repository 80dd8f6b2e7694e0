"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

Text and templates are lower-cased (A-Z), everything that is not a letter, a digit or beyond
ASCII becomes a space, and words are cut at spaces. A template is compared with stretches of
a text as long as itself, D = 2 |A and B| / (|A| + |B|) over bags of bigrams.

Candidates are pruned by size first: D >= t needs |A| >= t / (2 - t) |B|, so a text with fewer
bigrams drops the template, and a stretch that the text's ends cut below this is dropped.
Then only stretches are compared whose number of bigrams that the template has, wherever they
stand, is at least t (|A| + |B|) / 2: the bags share no more than that, so no match is lost.

Defined cases: null and empty texts have no licence; of equal coefficients the longer
template wins, then the earlier, then the earlier stretch; repeated rows are scanned one by one; an
empty table gives an empty table; further columns are ignored; texts are scanned whole. Templates
are broadcast in parts of MAX_TEMPLATES, and texts are scanned once for each part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_column, text_bytes

THRESHOLD = 0.8
#: Templates that are broadcast at once.
MAX_TEMPLATES = 5000

#: Short forms in which licences are named in running text.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved. No part may be reproduced without written permission."),
]

#: Whole texts of short licences without their copyright line, and the notices
#: by which files are put under long ones.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
TEMPLATES += [
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_CLAUSES} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} {_BSD_THIRD} {_BSD_END}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0-or-later", _GNU_NOTICE.format("General Public License", "2")),
    ("GPL-3.0-or-later", _GNU_NOTICE.format("General Public License", "3")),
    ("LGPL-3.0-or-later", _GNU_NOTICE.format("Lesser General Public License", "3")),
    ("AGPL-3.0-or-later", _GNU_NOTICE.format("Affero General Public License", "3")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_NORMAL = bytes(c if c >= 128 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        self.vocabulary: dict[bytes, int] = {}
        words = [normal_words(text.encode()) for _, text in templates]
        if any(len(w) < 2 for w in words):
            raise ValueError("a template needs two words")
        ids = [[self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w] for w in words]
        self.bags = [Counter(zip(x, x[1:])) for x in ids]
        self.sizes = [len(x) - 1 for x in ids]
        self.holders: dict[tuple[int, int], list[int]] = {}
        for t, bag in enumerate(self.bags):
            for pair in bag:
                self.holders.setdefault(pair, []).append(t)

    def windows(self, hits: np.ndarray, n: int, size: int) -> np.ndarray:
        """The stretches (start, end) of n bigrams that pass both bounds; hits: places of the template's bigrams."""
        start = np.arange(hits[0] - size + 1, hits[-1] + 1)
        first, last = np.maximum(start, 0), np.minimum(start + size, n)
        held = np.searchsorted(hits, last) - np.searchsorted(hits, first)
        # A little below the bounds, so that rounding drops nothing; what passes is verified.
        fits = (last - first >= self.threshold / (2 - self.threshold) * size - 1e-6) & (2 * held >= self.threshold * (last - first + size) - 1e-6)
        return np.stack([first[fits], last[fits]], 1)

    def scan(self, text: bytes | None) -> tuple[float, int, int] | None:
        """(coefficient, template, first word) of the best stretch at the threshold or above."""
        known = self.vocabulary.get
        words = np.fromiter((known(w, -1) for w in normal_words(text or b"")), np.int64)
        n = len(words) - 1
        places: dict[int, list[int]] = {}
        for at in np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0)).tolist():
            for t in self.holders.get((int(words[at]), int(words[at + 1])), ()):
                places.setdefault(t, []).append(at)
        best = None
        for t, hits in places.items():
            size, bag = self.sizes[t], self.bags[t]
            if len(hits) < self.threshold / (2 - self.threshold) * size - 1e-6:
                continue
            # The bag of a stretch is carried on to the next one.
            held, shared, begin, end = Counter(), 0, 0, 0
            for first, last in self.windows(np.array(hits), n, size).tolist():
                if first >= end:
                    held, shared, begin, end = Counter(), 0, first, first
                for at in range(end, last):
                    pair = (int(words[at]), int(words[at + 1]))
                    shared += held[pair] < bag[pair]
                    held[pair] += 1
                for at in range(begin, first):
                    pair = (int(words[at]), int(words[at + 1]))
                    held[pair] -= 1
                    shared -= held[pair] < bag[pair]
                begin, end = first, last
                found = 2 * shared / (last - first + size)
                key = (-found, -size, t, first)
                if found >= self.threshold and (best is None or key < best):
                    best = key
        return best and (-best[0], best[2], best[3])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license (null for none), dice and first_word of the best stretch of every text."""
    outputs = {"license": "string", "dice": "double", "first_word": "bigint"}
    rows = docs.select(F.col(id_col).alias("l_id"), text_bytes(text_col).alias("l_text"))
    measured = outputs | {"size": "int"}
    for k in range(0, max(1, len(templates)), MAX_TEMPLATES):
        found = map_column(rows, F.col("l_text"), rows.columns, {f"n_{c}": t for c, t in measured.items()}, scanning(docs, templates[k : k + MAX_TEMPLATES], threshold))
        # A later template wins by a larger coefficient, or by an equal one and its length.
        better = (F.col("n_dice") > F.col("dice")) | ((F.col("n_dice") == F.col("dice")) & (F.col("n_size") > F.col("size"))) if k else F.lit(True)
        rows = found.select("l_id", "l_text", *[F.when(better, F.col(f"n_{c}")).otherwise(F.col(c) if k else None).alias(c) for c in measured])
    return rows.select(F.col("l_id").alias(id_col), *outputs)


def scanning(docs: DataFrame, templates: list[tuple[str, str]], threshold: float):
    """What each task runs: the best stretch of each text of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast((templates, threshold))

    def start():
        scanner = Scanner(*shared.value)

        def scan(batch):
            found = [scanner.scan(x) for x in batch.to_pylist()]
            return [[f and scanner.names[f[1]] for f in found], [f[0] if f else 0.0 for f in found], [f[2] if f else None for f in found], [scanner.sizes[f[1]] if f else 0 for f in found]]

        return scan

    return start
