"""License statements: zstandard with each template as dictionary ranks them, wording differences confirm the winners."""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import batches, texts

#: Wording of public licenses and notices, and of notices that keep or give up rights. 2000 stands for any year.
TEXTS = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU Affero General Public License, version 3."],
    "All-Rights-Reserved": ["All rights reserved."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC0-1.0": ["Licensed under CC0.", "Licensed under CC0 1.0.", "Released under CC0.", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Copyright": ["Copyright (c)", "(c) 2000", "Copyright 2000", "Copyright by", "This work is protected by copyright."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS',
        "Licensed under the ISC License.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "This project uses the MIT License.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Public-Domain": ["This work is in the public domain.", "Released into the public domain.", "Dedicated to the public domain."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
#: The kinds of Creative Commons licenses, what ports their versions name, and identifiers with their licenses' names.
CREATIVE = {"BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
PORTS = {"2.0": "Generic", "3.0": "Unported", "4.0": "International"}
IDENTIFIED = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")


def all_templates() -> dict[str, list[str]]:
    """The texts, the notices of Creative Commons licenses by kind and version, and lines that name a license by its identifier."""
    out = {name: list(texts_) for name, texts_ in TEXTS.items()}
    for kind, name in CREATIVE.items():
        for version, port in PORTS.items():
            out[f"CC-{kind}-{version}"] = [f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {name} {version} {port} License."]
    for name in IDENTIFIED:
        out[name].append(f"SPDX-License-Identifier: {name}")
    return dict(sorted(out.items()))


TEMPLATES = all_templates()
#: Words of a statement that say which license it is: they stand as they are and together, or it isn't this license.
NAMES = re.compile(
    r"\b(?:spdx license identifier [a-z0-9 ]+|apache license|mozilla public license|eclipse public license 2 0|the mpl|2 0|bsd [23] clause license|cc by(?: nc)?(?: sa| nd)? [234] 0"
    r"|attribution(?: noncommercial)?(?: sharealike| noderivatives)? [234] 0|gnu (?:lesser |affero )?general public license|version 2 1|version [23]\b(?! [01])|isc license"
    r"|mit license|cc0(?: 1 0)?|public domain|waived all copyright|protected by copyright)\b"
)
WORD = re.compile(r"\(c\)|©|[^\W_]+", re.I)
YEAR = "<year>"
SAME = {"(c)": "©"} | {str(y): YEAR for y in range(1900, 2100)}
#: One word in so many may be changed, left out or added.
WORDS_AN_EDIT = 5
#: Of these a passage may not have more than the statement: they turn its meaning round.
NEGATIONS = {"not", "no", "never", "nor", "neither", "cannot", "isn", "aren", "wasn"}
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
NEVER = 1 << 60


def plain_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case, and where each stands."""
    found = list(WORD.finditer(text))
    return [SAME.get(w := m[0].lower(), w).replace("licence", "license") for m in found], [m.span() for m in found]


@dataclass
class Hit:
    """Words start to end of a text, which differ in so many words from a statement with ``same`` words alike."""

    start: int
    end: int
    differing: int
    same: int
    name: str


class Statement:
    """A statement's words, those that may not differ, and phrases of which each text within its bounds holds one."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, plain_words(text)[0]
        self.most = len(self.words) // WORDS_AN_EDIT
        self.reach = len(self.words) + self.most
        self.count = Counter(self.words)
        line = " ".join(self.words)
        spans = [(line.count(" ", 0, m.start()), m[0].count(" ") + 1) for m in NAMES.finditer(line)]
        self.fixed, self.glued = np.zeros(len(self.words), bool), np.zeros(len(self.words), bool)
        for at, n in spans:
            self.fixed[at : at + n] = True
            self.glued[at : at + n - 1] = True
        if spans:
            at, n = max(spans, key=lambda x: (x[1], len(" ".join(self.words[x[0] : x[0] + x[1]]))))
            self.phrases = [" ".join(self.words[at : at + n])]
        else:  # with so many edits at most, one of one piece more is as it was
            self.phrases = [" ".join(x) for x in np.array_split(np.array(self.words, object), self.most + 1)]

    def align(self, words: list[str], count: Counter) -> list[Hit]:
        """Where the words hold the statement with the fewest words changed, left out or added, ``most`` at most."""
        if len(self.words) - sum(min(n, count[w]) for w, n in self.count.items()) > self.most:
            return []
        n = len(words)
        one = n + 1  # an edit; less than one tells the start
        step = np.arange(n + 1) * one
        known = {w: i for i, w in enumerate(self.count)}
        code = np.array([known.get(w, -1) for w in words])
        best = np.arange(n, -1, -1)
        for i, w in enumerate(self.words):
            after = np.full(n + 1, NEVER)
            after[1:] = best[:-1] + np.where(code == known[w], 0, NEVER if self.fixed[i] else one)
            if not self.fixed[i]:
                after = np.minimum(after, best + one)
            if i + 1 < len(self.words) and not self.glued[i]:
                after = np.minimum.accumulate(after - step) + step
            best = np.minimum(after, NEVER)
        cost = best // one
        hits = [Hit(int(n - best[j] % one), int(j), int(cost[j]), len(self.words) - int(cost[j]), self.name) for j in np.flatnonzero(cost <= self.most)]
        denied = np.cumsum([0, *(w in NEGATIONS for w in words)])
        own = sum(w in NEGATIONS for w in self.words)
        return apart(sorted((h for h in hits if denied[h.end] - denied[h.start] <= own), key=lambda h: (h.differing, h.end)))


def apart(hits: list[Hit]) -> list[Hit]:
    """The hits that don't overlap an earlier one of the list."""
    taken, out = [], []
    for h in hits:
        i = bisect(taken, (h.start, h.end))
        if h.start < h.end and (i == 0 or taken[i - 1][1] <= h.start) and (i == len(taken) or taken[i][0] >= h.end):
            insort(taken, (h.start, h.end))
            out.append(h)
    return out


class Templates:
    """The statements, and a zstandard compressor without and one with each template as raw dictionary."""

    def __init__(self, templates: dict[str, list[str]]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False)
        self.packed = {}
        for name in sorted(templates):
            raw = "\n".join(templates[name]).encode()
            raw = zstandard.ZstdCompressionDict(raw + b"\n" * max(0, 8 - len(raw)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.packed[name] = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False)
        self.statements = {name: [x for text in templates[name] if (x := Statement(name, text)).words] for name in sorted(templates)}
        self.reach = {}
        for x in (x for own in self.statements.values() for x in own):
            for phrase in x.phrases:
                self.reach[phrase] = max(x.reach, self.reach.get(phrase, 0))
        self.signs, self.marks, self.any = set(), (), False
        for phrase in self.reach:
            fixed = [w for w in phrase.split() if w.isascii() and w != YEAR]
            if fixed:
                self.signs.add(phrase.encode() if len(fixed) == len(phrase.split()) else max(fixed, key=len).encode())
            elif "©" in phrase:
                self.marks = (b"(c)", b"(C)", "©".encode())
            else:
                self.any = True  # nothing in it that the quick look knows

    def reduction(self, part: bytes, name: str) -> float:
        """Share of the compressed size that the template as dictionary saves."""
        return 1 - len(self.packed[name].compress(part)) / len(self.plain.compress(part))

    def ranked(self, block: bytes) -> list[str]:
        """The templates, those first that as dictionary shrink a block most."""
        return sorted(self.packed, key=lambda name: (len(self.packed[name].compress(block)), name))

    def may_hold(self, doc: bytes) -> bool:
        line = b" ".join(doc.translate(PLAIN).split()).replace(b"licence", b"license")
        return self.any or any(x in line for x in self.signs) or any(x in doc for x in self.marks)

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """Windows of words around each phrase, wide enough for its statements; those that overlap are one block."""
        line = f" {' '.join(words)} "
        starts = np.cumsum([1, *(len(w) + 1 for w in words)])
        spans = []
        for phrase, reach in self.reach.items():
            at = line.find(f" {phrase} ")
            while at >= 0:
                i = int(np.searchsorted(starts, at + 1))
                spans.append((max(0, i - reach), min(len(words), i + reach)))
                at = line.find(f" {phrase} ", at + 1)
        out = []
        for a, b in sorted(spans):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def scan_blocks(doc: bytes, t: Templates) -> tuple[int, list[tuple[str, float, int, str]]]:
    """(candidate blocks, (license, reduction, differing words, passage) of each statement found)."""
    if not t.may_hold(doc):
        return 0, []
    text = doc.decode("utf-8", "ignore")
    words, at = plain_words(text)
    blocks, found = t.blocks(words), []
    between = lambda a, b: text[at[a][0] : at[b - 1][1]]
    for a, b in blocks:
        count, taken = Counter(words[a:b]), []
        for name in t.ranked(between(a, b).encode()):  # the template that shrinks the block most first: what it confirms no other may claim
            hits = [h for x in t.statements[name] for h in x.align(words[a:b], count)]
            taken = apart([*taken, *sorted(hits, key=lambda h: (-h.same, h.differing))])
        for h in sorted(taken, key=lambda h: h.start):
            part = between(a + h.start, a + h.end)
            found.append((h.name, t.reduction(part.encode(), h.name), h.differing, part))
    return len(blocks), found


def _scan(templates: dict[str, list[str]]):
    hit = pa.struct([("license", pa.string()), ("reduction", pa.float64()), ("differing", pa.int64()), ("block", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_blocks", pa.int64()), ("licenses", pa.list_(pa.string())), ("hits", pa.list_(hit))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates)
        for batch in it:
            found = [scan_blocks(d, t) for d in texts(batch.column(1))]
            yield batches({"doc_id": batch.column(0).cast(pa.int64()), "n_blocks": [n for n, _ in found], "licenses": [sorted({h[0] for h in hits}) for _, hits in found], "hits": pa.array([[dict(zip(("license", "reduction", "differing", "block"), h, strict=True)) for h in hits] for _, hits in found], pa.list_(hit))}, schema)

    return run, "doc_id long, n_blocks long, licenses array<string>, hits array<struct<license:string,reduction:double,differing:long,block:string>>"


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each row: doc_id, n_blocks, licenses, hits.

    Candidate blocks are windows of words, whatever lines they stand in, around the phrases of which a statement must
    hold one; line ends, comment marks, punctuation and case don't count. A statement is found where its words, aligned
    with the block's, differ in a fifth at most (``differing``: words changed, left out or added) not in the
    license's name or version, and not by a negation. Each block is compressed with each template as dictionary, and the templates are
    tried in the order of what they save: their statements are aligned, those with the most words alike first, and what one
    confirms no later one may claim. ``reduction`` is the share that the template saves of the passage's compressed size.
    A null or empty text has no blocks. Repeated rows and null ids are scanned like others; other columns are ignored;
    an empty table gives no rows.
    """
    fn, kind = _scan(templates or TEMPLATES)
    return docs.select("doc_id", "text").mapInArrow(fn, kind)
