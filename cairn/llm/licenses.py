"""License scans by conditional compression.

Lines that hold a key of license notices, with as many words around as the longest template may span, are candidate
blocks; blocks that meet are one. A block is compressed with
zstandard alone and with each template as a raw dictionary; templates are ranked by the size that they save. In
that order a template is confirmed by its exact wording: the words of both are aligned, and it is found if few of
its words are missing or changed and few are put in; the first one confirmed without a difference wins, else the one that
explains the most words, differences taken off. What is found is cut out, and the rest of the block is tried again, so a
block may hold several notices.

Result: a row for each notice found, with its span in code points, the share of the size saved, and the
differences (none: `exact`). Nulls: null and empty texts hold nothing; a null doc_id stays null. Repeated rows
are each scanned. Ties of the saving go to the longer template, then to the first by name. A block is cut where it exceeds
BLOCK_LINES lines (and three times the longest template) or a line LINE_CHARS characters, with an overlap of the longest
template; of spans that overlap, found on either side of a cut, the longest stands. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

#: Notices by license. The wording is that of the public license texts and of customary short notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "GPL-2.0-only": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-3.0-only": ["SPDX-License-Identifier: GPL-3.0-only"],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "This material may not be reproduced, distributed or transmitted without the prior written permission of the publisher."],
}
#: What a line of a notice holds, lower case.
KEYS = ["licen", "copyright", "rights reserved", "permission", "warrant", "redistribut", "public domain", "creative commons", "free software", "permitted provided", "without restriction"]

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Most words of a template that may be missing or changed, or put in, by share.
MISSING, EXTRA = 0.1, 0.1
#: Words that a difference takes from those that a template explains.
DIFFERS = 3
#: A key may be parted by a line's end and what a comment's lines begin with.
KEY = re.compile("|".join(re.escape(k).replace("\\ ", r"[\W_]+") for k in KEYS), re.IGNORECASE)
FIRST = [k.split()[0] for k in KEYS]
#: Lines of a block and characters of a line that are taken at once.
BLOCK_LINES, LINE_CHARS = 60, 20_000
FOUND = "doc_id long, license string, span_start int, span_end int, saved double, missing int, extra int, exact boolean"


class Scanner:
    """Templates, each with a compressor that has it as its dictionary."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, level: int = 3):
        import zstandard as z

        self.alone = z.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.known = []
        for name in sorted(templates):
            for text in templates[name]:
                held = z.ZstdCompressionDict(text.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=level)
                with_it = z.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
                self.known.append((name, WORD.findall(text.lower()), with_it))
        self.counts = [Counter(w) for _, w, _ in self.known]
        self.reach = max(sum(map(len, w)) + 2 * len(w) for _, w, _ in self.known)
        longest = max(len(w) for _, w, _ in self.known)
        self.span = longest + int(EXTRA * longest) + 1

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of lines around keys, a template's words to either side, no longer than allowed, overlapping by a template."""
        low = text.lower()
        keys = [m.start() for m in KEY.finditer(low if len(low) == len(text) else text)] if any(k in low for k in FIRST) else []
        if not keys:
            return
        spans, at = [], 0
        for line in text.split("\n"):
            end = at + len(line)
            for lo in range(at, max(end, at + 1), LINE_CHARS):
                spans.append((lo, min(end, lo + LINE_CHARS + self.reach)))
            at = end + 1
        begins = [a for a, _ in spans]
        # a key near the end of a cut line's piece lies in the next one too
        hits = sorted({i for k in keys for i in [bisect_right(begins, k) - 1] for i in ([i - 1, i] if i and spans[i - 1][1] > k else [i])})
        sizes: dict[int, int] = {}

        def size(i: int) -> int:
            if i not in sizes:
                sizes[i] = len(WORD.findall(text, *spans[i]))
            return sizes[i]

        def away(i: int, step: int, until: int) -> int:
            """The line up to which a template's words go from line i."""
            words = 0
            while i != until and words < self.span:
                i += step
                words += size(i)
            return i

        around: list[list[int]] = []
        for i in hits:
            if around and i <= around[-1][1]:
                if i > around[-1][2]:
                    around[-1][1:] = [max(around[-1][1], away(i, 1, len(spans) - 1)), i]
                continue
            first, last = away(i, -1, 0), away(i, 1, len(spans) - 1)
            if around and first <= around[-1][1]:
                around[-1][1:] = [last, i]
            else:
                around.append([first, last, i])
        for first, last, _ in around:
            start, words = first, 0
            for i in range(first, last + 1):
                words += size(i)
                if i == last or (i - start + 1 >= BLOCK_LINES and words >= 3 * self.span):
                    yield spans[start][0], max(b for _, b in spans[start : i + 1])
                    if i < last:
                        back = away(i + 1, -1, start)
                        start, words = back, sum(size(j) for j in range(back, i + 1))

    def rank(self, block: str) -> list[tuple[float, int]]:
        """All templates by the share of the block's compressed size that they save (a short block may save nothing)."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        own = len(self.alone.compress(raw))
        saved = [((own - len(c.compress(raw))) / own, k) for k, (_, _, c) in enumerate(self.known)]
        return sorted(saved, key=lambda x: (-x[0], -len(self.known[x[1]][1]), x[1]))

    def confirm(self, words: list[str], template: list[str]) -> tuple[int, int, int, int] | None:
        """(first word, end, words of the template missing, words put in) of the template's place among the words."""
        match = SequenceMatcher(None, words, template, autojunk=False)
        seed = match.find_longest_match()
        if seed.size == 0 or seed.size < min(3, len(template)):
            return None
        # the template lies around its longest common run: aligned there, with room for what is put in
        room = len(template) + int(EXTRA * len(template)) + 1
        lo, hi = max(0, seed.a - seed.b - room + len(template)), min(len(words), seed.a - seed.b + room)
        same = [m for m in SequenceMatcher(None, words[lo:hi], template, autojunk=False).get_matching_blocks() if m.size]
        first, end = lo + same[0].a, lo + same[-1].a + same[-1].size
        found = sum(m.size for m in same)
        missing, extra = len(template) - found, end - first - found
        return (first, end, missing, extra) if missing <= MISSING * len(template) and extra <= EXTRA * len(template) else None

    def scan_block(self, block: str) -> list[tuple[str, int, int, float, int, int]]:
        spots = [(m.group(), m.start(), m.end()) for m in WORD.finditer(block.lower())] if len(block.lower()) == len(block) else [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(block)]
        out, parts = [], [(0, len(spots))]
        while parts:
            lo, hi = parts.pop()
            if lo >= hi:
                continue
            words = [s[0] for s in spots[lo:hi]]
            piece = block[spots[lo][1] : spots[hi - 1][2]]
            held, best, most = Counter(words), None, 0
            for saved, k in self.rank(piece):
                name, template, counts = self.known[k][0], self.known[k][1], self.counts[k]
                if sum(min(n, held[w]) for w, n in counts.items()) >= (1 - MISSING) * len(template) and (got := self.confirm(words, template)):
                    # wordings may differ in a word: an exact one stands, else the one that explains the most words
                    explained = len(template) - got[2] - DIFFERS * (got[2] + got[3])
                    if best is None or explained > most:
                        best, most = (name, saved, got), explained
                    if got[2] == got[3] == 0:
                        break
            if best:
                name, saved, (a, b, missing, extra) = best
                out.append((name, spots[lo + a][1], spots[lo + b - 1][2], saved, missing, extra))
                parts += [(lo, lo + a), (lo + b, hi)]
        return sorted(out, key=lambda x: x[1])

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
        found = [(n, a + lo, a + hi, *rest) for a, b in (self.blocks(text) if text else ()) for n, lo, hi, *rest in self.scan_block(text[a:b])]
        # within a block no two overlap; across a cut the longer is the whole notice
        kept: list[tuple[int, int]] = []
        out = []
        for f in sorted(found, key=lambda f: (f[1] - f[2], f[1], f[0])):
            at = bisect_right(kept, (f[1], f[1]))
            if (at == 0 or kept[at - 1][1] <= f[1]) and (at == len(kept) or kept[at][0] >= f[2]):
                kept.insert(at, (f[1], f[2]))
                out.append(f)
        return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each license notice in the whole text of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [(d, *f[:5], f[5], f[4] == f[5] == 0) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for f in scanner.scan(t.as_py())]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["doc_id", "license", "span_start", "span_end", "saved", "missing", "extra", "exact"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
