"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Templates of like length share a scan, and a window finds those that agree with it by a search
in the band's sorted minhashes, so the cost of a text hardly grows with the templates.  The text's word shingles are cut into blocks of
about a quarter of the template's length and windows of consecutive blocks, long enough
that each stretch of a template's length lies whole in one of them.  A window and a
template that agree in one of BANDS bands of one minhash each are compared exactly: the
share of the template's distinct shingles that the window has must reach CONTAINMENT.
A whole occurrence has a similarity of at least n / (n + 2 block) >= 1/3 to its window,
so a band collides with probability 1 - (2/3)**32 > 0.999997.

Words are runs of ASCII letters, digits and bytes beyond ASCII, lower-cased.

Defined results: null and empty texts, and texts under SHINGLE words, match nothing;
overlapping windows of one occurrence give one match; repeated rows each give theirs; a
null id is kept as null; no templates, no matches.  Other columns are ignored, whatever their
names.  Texts are scanned in chunks of about a megabyte, a longer one by itself and whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare
from .textops import batch, chunks, mix, shingle_hashes, texts_of, word_hashes

SHINGLE, BANDS, CONTAINMENT = 5, 32, 0.8
#: Up to so many templates of one size are compared one by one, which is the faster way then.
FEW = 4

#: Notices by which public licences are announced, and their passages, so that a
#: later part of a licence is found as well as its beginning.
TEMPLATES = {
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-header-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "gpl-2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-header-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by-4-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_KEEP = np.full(256, 32, dtype=np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _KEEP[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_KEEP = _KEEP.tobytes()


def normal(text: bytes) -> bytes:
    return text.translate(_KEEP)


class Group:
    """Templates that fill as many blocks of one size: their minhashes, sorted in each band."""

    def __init__(self, templates: list[tuple[int, np.ndarray]]) -> None:
        self.numbers = np.array([number for number, _ in templates])
        least = np.array([least for _, least in templates])
        self.order = np.argsort(least, axis=0, kind="stable")
        self.least = np.take_along_axis(least, self.order, axis=0)
        self.bits = np.zeros((BANDS, 1 << 12), dtype=bool)  # low bits that some minhash of a band has
        self.bits[np.arange(BANDS), least & np.uint64(4095)] = True

    def agreeing(self, band: int, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, window) of each pair that has the band's minhash in common."""
        least = self.least[:, band]
        if len(least) <= FEW:
            hits = np.flatnonzero(np.logical_or.reduce([window == x for x in least]))
        else:
            hits = np.flatnonzero(self.bits[band][(window & np.uint64(4095)).view(np.int64)])
        first = np.searchsorted(least, window[hits])
        same = least[np.minimum(first, len(least) - 1)] == window[hits]
        first, hits = first[same], hits[same]
        n = np.searchsorted(least, window[hits], side="right") - first
        each = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.numbers[self.order[each, band]], np.repeat(hits, n)


class Scanner:
    """Templates by block size and number of blocks, with their shingle sets."""

    def __init__(self, templates: dict[str, str], containment: float) -> None:
        self.containment = containment
        self.factors = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        self.templates: list[tuple[str, np.ndarray, int]] = []  # name, shingles, length of a window
        self.widest = 0
        found: dict[int, dict[int, list]] = {}
        for name, text in templates.items():
            words, bounds = word_hashes([normal(text.encode())])
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has under {SHINGLE} words")
            shingles, _ = shingle_hashes(words, bounds, SHINGLE)
            block = 1 << max(0, (len(shingles) // 4).bit_length() - 1)
            width = -(-len(shingles) // block) + 1  # one block more than the template fills
            least = (shingles[:, None] * self.factors).min(axis=0)
            found.setdefault(block, {}).setdefault(width, []).append((len(self.templates), least))
            self.templates.append((name, np.unique(shingles), width * block))
            self.widest = max(self.widest, (width + 1) * block)
        self.groups = {block: {width: Group(found[block][width]) for width in sorted(found[block])} for block in sorted(found)}

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, int, int, float]]:
        """(text, template, first word, word after the last, containment) of each match.

        Each band takes a pass over the text and a search for each window, however many
        templates there are; only windows that agree are compared.
        """
        words, bounds = word_hashes([normal(t) for t in texts])
        shingles, at = shingle_hashes(words, bounds, SHINGLE)
        short = np.diff(bounds) < SHINGLE
        if not len(shingles) or not self.templates:
            return []
        last = np.uint64(2**64 - 1)
        rest = np.full(self.widest, last)  # so that the last windows are whole
        pairs = []
        for band, factor in enumerate(self.factors):
            level, size = np.concatenate((shingles * factor, rest)), 1
            for block, groups in self.groups.items():
                while size < block:
                    if len(level) % 2:
                        level = np.append(level, last)
                    level, size = np.minimum(level[::2], level[1::2]), 2 * size
                window, width = level, 1
                for wanted, group in groups.items():
                    while width < wanted:
                        window, width = np.minimum(window[:-1], level[width:]), width + 1
                    number, place = group.agreeing(band, window)
                    pairs.append(number << 40 | place * block)
        pairs = np.unique(np.concatenate(pairs))
        number, begin = pairs >> 40, pairs & ((1 << 40) - 1)
        cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True]))) if len(pairs) else np.zeros(1, np.int64)
        out = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out += self._confirm(*self.templates[number[i]], begin[i:j], shingles, at, short)
        return sorted(out)

    def _confirm(self, name, members, length, begins, shingles, at, short):
        """Matches of one template in the windows that begin at sorted places."""
        begins = begins[begins < len(shingles)]
        if not len(begins):
            return []
        ends = np.minimum(begins + length, len(shingles))
        # windows that overlap or touch are one run; the runs' shingles are looked up once
        new = np.concatenate(([True], begins[1:] > ends[:-1]))
        start, stop = begins[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
        base = np.concatenate(([0], np.cumsum(stop - start)))
        shift = (base[:-1] - start)[np.cumsum(new) - 1]
        places = np.arange(base[-1]) - np.repeat(base[:-1] - start, stop - start)
        inside = np.isin(shingles[places], members)
        sums = np.concatenate(([0], np.cumsum(inside)))
        enough = sums[ends + shift] - sums[begins + shift] >= self.containment * len(members)
        spans: dict[int, list[list]] = {}
        for lo, hi, by in zip(begins[enough].tolist(), ends[enough].tolist(), shift[enough].tolist()):
            hits = lo + np.flatnonzero(inside[lo + by : hi + by])
            owner = np.searchsorted(at, hits, side="right") - 1
            for doc in np.unique(owner).tolist():
                if short[doc]:
                    continue
                mine = hits[owner == doc]
                share = len(np.unique(shingles[mine])) / len(members)
                if share >= self.containment:
                    spans.setdefault(doc, []).append([int(mine[0] - at[doc]), int(mine[-1] - at[doc]) + SHINGLE, share])
        out = []
        for doc, own in spans.items():
            own.sort()
            merged = [own[0]]
            for first, end, share in own[1:]:
                if first < merged[-1][1]:
                    merged[-1] = [merged[-1][0], max(end, merged[-1][1]), max(share, merged[-1][2])]
                else:
                    merged.append([first, end, share])
            out += [(doc, name, *m) for m in merged]
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, first_word, end_word, containment), a row for each match."""
    prepare(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, containment)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        for b in batches:
            texts, ids = texts_of(b.column(1)), b.column(0).to_pylist()
            rows = [(ids[i + k], *rest) for i, j in chunks(texts) for k, *rest in scanner.scan(texts[i:j])]
            if rows:
                yield batch(dict(zip(schema.names, zip(*rows))), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, first_word long, end_word long, containment double")
