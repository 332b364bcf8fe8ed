"""Operator 2, licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines with words, so that a wrapped header is one text. A softmax
regression over hashed word n-grams (one and two words) tells "none", the licence families
and "unknown" (a licence of no known family) apart. It is trained on the driver from
TEMPLATES and OTHERS (whole, in windows, varied by seeded word loss and surrounding text) and
from a bounded sample of the corpus's own lines (``NEGATIVES``, chosen by hash) as "none". A
temperature fitted on held-out examples calibrates the probabilities.

Every word of every text is classified: sums of the words' weights give the probability of
any stretch (a word that repeats the one before it adds nothing). Stretches are the lines, and windows of WINDOW words, STRIDE apart, of each
paragraph. A line that by itself is a known licence and like a template stands alone. Of the
other words, windows that are likelier a licence than none are joined to statements, and the
surest of a statement's windows says which family it is; below ``certain`` it is "unknown".
A template of the family confirms a statement if it has the share ``confirm`` of the template's
word pairs; that is told, and rejects nothing. A line of reserved rights beside a licence in the same
paragraph is no statement of its own.

The scan is one narrow pass; what is broadcast is the model, of fixed size.

Defined results: a null or empty text has no findings; repeated rows give repeated results;
without any negatives the templates alone are trained against a plain "none"; an empty table
gives none; further columns of the documents are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import hash_sample, mix, slices, span_hashes, text_bytes, word_spans

#: How licences are named and stated, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the terms of the Apache License 2.0.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution license.", "SPDX-License-Identifier: CC-BY-4.0", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Content is available under CC BY-NC-SA 4.0 and may not be used for commercial purposes.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020 Example Corporation. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced or distributed in any form without prior written permission of the publisher."],
}
#: Licences of no known family, for "unknown".
OTHERS = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.",
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appears in all copies.",
    "You are free to use this software, including for commercial purposes, and to change and redistribute it, subject to these conditions.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "This database is made available under the Open Database License.",
    "Distributed under the terms of the Artistic License.",
    "Released under the Microsoft Reciprocal License.",
    "The contents of this file are subject to the Common Development and Distribution License.",
    "Licensed under the Academic Free License version 3.0.",
    "You may use this work under the terms of the Open Government Licence.",
    "SPDX-License-Identifier: Zlib",
    "This package is distributed under the Python Software Foundation License.",
    "Use, reproduction and distribution are governed by the terms of the PostgreSQL License.",
]
FAMILIES = ["none", "unknown", *TEMPLATES]
#: Weights by hash; training; how many lines of the corpus at most stand for "none".
BUCKETS, VARIANTS, EPOCHS, NEGATIVES = 1 << 18, 45, 16, 3000
#: Characters of such a line at most that the driver reads: training takes 40 words of each.
EXAMPLE = 400
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 24, 8
SCHEMA = "doc_id long, n_findings long, n_confirmed long, n_unknown long, families string, best_family string, best_probability double"
_WORD = np.array([b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256)], np.uint8)
_U, _I = np.uint64, np.int64


def normal(text: str) -> list[bytes]:
    return _WORD[np.frombuffer(text.encode(), np.uint8)].tobytes().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return span_hashes(data, starts, ends)


def single(words: np.ndarray) -> np.ndarray:
    """The buckets of words."""
    return (words % _U(BUCKETS)).astype(_I)


def paired(words: np.ndarray) -> np.ndarray:
    """The buckets of pairs of neighbouring words; one fewer than words."""
    return (mix(words[:-1] * _U(0xC2B2AE3D27D4EB4F) + words[1:]) % _U(BUCKETS)).astype(_I)


def fresh_words(words: np.ndarray) -> np.ndarray:
    """Which words differ from the one before; a word said again and again is no more evidence."""
    return np.concatenate([[True], words[1:] != words[:-1]]) if len(words) else np.zeros(0, bool)


def windows(n: int) -> list[tuple[int, int]]:
    """The windows of a paragraph of n words."""
    starts = [*range(0, max(1, n - WINDOW + 1), STRIDE)]
    if starts[-1] + WINDOW < n:
        starts.append(n - WINDOW)
    return [(a, min(n, a + WINDOW)) for a in starts]


def _examples(negatives: list[str], rnd: random.Random) -> list[tuple[list[bytes], int]]:
    """Stretches of words and their families."""
    filler = [w for text in negatives[:400] for w in normal(text)][:4000] or [b"the", b"of", b"and", b"in"]
    filler = filler * (64 // len(filler) + 1)

    def around(n: int) -> list[bytes]:
        at = rnd.randrange(len(filler) - n)
        return filler[at : at + n]

    out: list[tuple[list[bytes], int]] = []
    for label, texts in [(1, OTHERS), *((FAMILIES.index(f), t) for f, t in TEMPLATES.items())]:
        for text in texts:
            whole = normal(text)
            parts = [whole, *(whole[a:b] for a, b in windows(len(whole)) if len(whole) > WINDOW)]
            for v in range(VARIANTS):
                words = [w for w in parts[v % len(parts)] if v < len(parts) or rnd.random() > 0.08]
                if v % 3 == 1 and len(words) > 12:
                    words = words[rnd.randrange(len(words) // 3) : len(words) - rnd.randrange(len(words) // 3)]
                # A window seldom begins and ends where a statement does.
                if v % 2 and len(words) < WINDOW:
                    before = rnd.randrange(WINDOW - len(words) + 1)
                    words = [*around(before), *words, *around(WINDOW - len(words) - before)]
                out.append((words, label))
    for text in negatives:
        words = normal(text)
        at = rnd.randrange(max(1, len(words) - 30))
        out.append((words[at : at + rnd.randrange(4, 40)], 0))
    # Single words and pairs of licences in prose aren't licences.
    stated = [normal(t) for texts in [OTHERS, *TEMPLATES.values()] for t in texts]
    for k, words in enumerate(sorted({(w,) for t in stated for w in t} | {p for t in stated for p in zip(t, t[1:], strict=False)})):
        if len(words) == 1 or k % 3 == 0:
            out.append(([*around(rnd.randrange(2, 12)), *words, *around(rnd.randrange(2, 12))], 0))
    # Nor are the words of licences in an order of no licence.
    every = [w for t in stated for w in t]
    for _ in range(400):
        out.append((rnd.sample(every, rnd.randrange(2, 20)), 0))
    # Words that were never seen say that there is none.
    strange = lambda: bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(1, 9)))
    out += [([strange() for _ in range(rnd.randrange(3, WINDOW + 1))], 0) for _ in range(400)]
    rnd.shuffle(out)
    return out


class Classifier:
    """Softmax regression over hashed n-grams, with a temperature and templates."""

    def __init__(self, negatives: list[str], seed: int = 17):
        rnd = random.Random(seed)
        examples = []
        for words, label in _examples(negatives, rnd):
            own = word_hashes(words)
            if len(own):
                new = fresh_words(own)
                buckets, times = np.unique(np.concatenate([single(own)[new], paired(own)[new[1:]]]), return_counts=True)
                examples.append((buckets, (times / np.sqrt(len(own))).astype(np.float32), label))
        held, learn = examples[::5], [x for i, x in enumerate(examples) if i % 5]
        self.weights, self.bias = np.zeros((BUCKETS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        squares = np.full((BUCKETS, len(FAMILIES)), 1e-2, np.float32)
        soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        logits = lambda x, v: v @ self.weights[x] + self.bias
        for _ in range(EPOCHS):
            for x, v, y in learn:
                p = soft(logits(x, v))
                p[y] -= 1
                g = np.outer(v, p)
                squares[x] += g * g
                self.weights[x] -= 0.3 * (g + 2e-5 * self.weights[x]) / np.sqrt(squares[x])
                self.bias -= 0.01 * p
            rnd.shuffle(learn)
        loss = lambda t: -sum(np.log(max(soft(logits(x, v) / t)[y], 1e-9)) for x, v, y in held)
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        self.held_accuracy = float(np.mean([int(np.argmax(logits(x, v)) == y) for x, v, y in held]))
        self.pairs = {f: [frozenset(zip(w, w[1:], strict=False)) for w in map(normal, texts)] for f, texts in TEMPLATES.items()}

    def sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the weights of words, and of the pairs that end at each word."""
        one, two = np.zeros((len(words) + 1, len(FAMILIES))), np.zeros((len(words) + 1, len(FAMILIES)))
        if len(words):
            new = fresh_words(words)[:, None]
            np.cumsum(self.weights[single(words)] * new, axis=0, dtype=np.float64, out=one[1:])
            np.cumsum(self.weights[paired(words)] * new[1:], axis=0, dtype=np.float64, out=two[2:])
        return one, two

    def probabilities(self, sums: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The calibrated probabilities of stretches of words (none of them empty), a row each."""
        z = (sums[0][hi] - sums[0][lo] + sums[1][hi] - sums[1][lo + 1]) / np.sqrt(hi - lo)[:, None]
        z = (z + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, words: list[bytes], certain: float = 0.6) -> tuple[str, float, float]:
        """The family of a stretch of words, its calibrated probability, and the share of the family's best template that it has."""
        p = self.probabilities(self.sums(word_hashes(words)), np.zeros(1, _I), np.array([len(words)]))[0]
        family, q = _judged(p, certain) if p[0] < 0.5 else ("none", float(p[0]))
        return family, q, self.share(family, words)

    def share(self, family: str, words: list[bytes]) -> float:
        """The share of a template's word pairs that a stretch has; that of the family's best template."""
        own = set(zip(words, words[1:], strict=False))
        return max(len(t & own) / max(1, len(t)) for t in self.pairs.get(family, [frozenset()]))


def train(docs: DataFrame, negatives: int = NEGATIVES) -> Classifier:
    """A classifier whose "none" is a sample of the corpus's lines without licence words, chosen by hash; of a long line, a stretch that its hash places."""
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line"))
    total = docs.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    plain = lines.filter((F.length("line") > 0) & ~F.lower("line").rlike(r"licen[sc]|copyright|rights|spdx|redistribut|permission"))
    place = F.pmod(F.xxhash64("line"), F.greatest(F.length("line") - EXAMPLE, F.lit(0)) + 1).cast("int")
    chosen = hash_sample(plain, "line", negatives, total).select(F.substring(F.col("line"), place + 1, F.lit(EXAMPLE)))
    return Classifier([r[0] for r in chosen.collect()])


def _judged(p: np.ndarray, certain: float) -> tuple[str, float]:
    """The family that probabilities speak for, and how surely; "unknown" if it is a licence and no known family is sure."""
    k = 2 + int(np.argmax(p[2:]))
    return (FAMILIES[k], float(p[k])) if p[k] >= certain else ("unknown", float(1 - p[0]))


def _findings(data: np.ndarray, offsets: np.ndarray, model: Classifier, certain: float, confirm: float) -> Iterator[tuple[int, int, int, str, float, bool]]:
    """(document, start, end in bytes of the slice, family, probability, confirmed), in the order of the texts."""
    flat = _WORD[data]
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10)]))
    starts, ends, first = word_spans(flat, edges)
    if not len(starts):
        return
    sums = model.sums(span_hashes(flat, starts, ends))
    text = lambda lo, hi: flat[starts[lo] : ends[hi - 1]].tobytes().split()
    lines = np.flatnonzero(np.diff(first) > 0)
    p = model.probabilities(sums, first[lines], first[lines + 1])
    found: list[tuple[int, int, int, str, float, bool]] = []  # line's paragraph is added below
    alone = np.zeros(len(edges), bool)
    for i in np.flatnonzero(p[:, 2:].max(axis=1) >= certain).tolist():
        line, (family, q) = int(lines[i]), _judged(p[i], certain)
        lo, hi = int(first[line]), int(first[line + 1])
        if model.share(family, text(lo, hi)) >= confirm:
            alone[line] = True
            found.append((line, lo, hi, family, q, True))
    # Paragraphs: runs of lines with words within a document; lines that stand alone divide them.
    empty = np.diff(first) == 0
    fresh = np.isin(edges[:-1], offsets) | empty
    fresh[1:] |= empty[:-1]
    paragraph = np.cumsum(fresh)
    divided = fresh | alone[:-1]
    divided[1:] |= alone[:-2]
    run = np.cumsum(divided)
    keep = ~empty & ~alone[:-1]
    runs, at = np.unique(run[keep], return_index=True)
    begin = first[:-1][keep][at]
    last = np.searchsorted(run[keep], runs, "right") - 1
    end = first[1:][keep][last]
    # All windows of all runs at once.
    n = end - begin
    many = np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1
    owner = np.repeat(np.arange(len(runs)), many)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    lo = begin[owner] + np.minimum(inside * STRIDE, np.maximum(n[owner] - WINDOW, 0))
    hi = np.minimum(lo + WINDOW, end[owner])
    p = model.probabilities(sums, lo, hi) if len(lo) else np.zeros((0, len(FAMILIES)))
    hit = np.flatnonzero(p[:, 0] < 0.5)
    group: list[int] = []
    for i, k in enumerate(hit.tolist()):
        group.append(k)
        if i + 1 < len(hit) and owner[hit[i + 1]] == owner[k] and lo[hit[i + 1]] <= hi[k]:
            continue
        best = max(group, key=lambda g: (p[g, 2:].max(), -g)) if any(p[g, 2:].max() >= certain for g in group) else min(group, key=lambda g: (p[g, 0], g))
        family, q = _judged(p[best], certain)
        a, b = int(lo[group[0]]), int(hi[group[-1]])
        line = int(np.searchsorted(first, a, "right")) - 1
        found.append((line, a, b, family, q, family != "unknown" and model.share(family, text(a, b)) >= confirm))
        group = []
    licensed = {int(paragraph[x[0]]) for x in found if x[3] != "proprietary"}
    for line, a, b, family, q, confirmed in sorted(found, key=lambda x: x[1]):
        if family == "proprietary" and int(paragraph[line]) in licensed:
            continue
        doc = int(np.searchsorted(offsets, starts[a], "right")) - 1
        yield doc, int(starts[a] - offsets[doc]), int(ends[b - 1] - offsets[doc]), family, q, confirmed


def _pass(docs: DataFrame, model: Classifier, certain: float, confirm: float, emit, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = []
            for lo, hi in slices(offsets):
                part = _findings(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], sent.value, certain, confirm)
                rows += [(lo + doc, *rest) for doc, *rest in part]
            yield emit(batch.column(0), rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def findings(docs: DataFrame, model: Classifier | None = None, certain: float = 0.6, confirm: float = 0.6) -> DataFrame:
    """One row per licence statement: document, place in bytes of its UTF-8 text, family, probability, confirmed by a template."""
    names = ["doc_id", "start", "end", "family", "probability", "confirmed"]

    def emit(ids: pa.Array, rows: list) -> pa.RecordBatch:
        keys = ids.to_pylist()
        columns = list(zip(*((keys[i], *rest) for i, *rest in rows), strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _pass(docs, model or train(docs), certain, confirm, emit, "doc_id long, start long, end long, family string, probability double, confirmed boolean")


def scan(docs: DataFrame, model: Classifier | None = None, certain: float = 0.6, confirm: float = 0.6) -> DataFrame:
    """One row per document: its findings by number and family, and the surest."""

    def emit(ids: pa.Array, rows: list) -> pa.RecordBatch:
        n = len(ids)
        total, sure, unknown, names, best, top = [0] * n, [0] * n, [0] * n, [set() for _ in range(n)], [None] * n, [0.0] * n
        for i, _, _, family, p, confirmed in rows:
            total[i] += 1
            sure[i] += confirmed
            unknown[i] += family == "unknown"
            names[i].add(family)
            if best[i] is None or (p, family) > (top[i], best[i]):
                best[i], top[i] = family, p
        values = (total, sure, unknown, [",".join(sorted(x)) for x in names], best, top)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.record_batch([ids, *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return _pass(docs, model or train(docs), certain, confirm, emit, SCHEMA)
