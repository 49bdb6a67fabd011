"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are blocks between blank lines, read in overlapping windows of at most ``2 * BLOCK`` words that
begin at every line and every ``BLOCK`` words of a line: windows of one line, and windows that run over
line ends, so that a wrapped notice is seen whole. Their sparse features are the word n-grams (one to
three words, across line ends) that occur in the templates; a logistic regression over licence families
and an unknown class scores them. It learns from damaged templates and, for the unknown class, from
template words out of order and from all paragraphs of a bounded sample of the corpus that share little
with any template; a temperature fitted on left-out examples calibrates its probabilities. A predicted
family counts only if the window also shares enough word pairs with one of that family's templates; of
overlapping windows of a family the one that shares most counts.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.arrowtext import encode_words, held, segment_sum, slices, texts_of

#: Rows of the corpus whose paragraphs stand for the unknown class in training.
SAMPLE_ROWS = 300
BLOCK = 40
LEAST_PROBABILITY = 0.5
LEAST_OVERLAP = 0.5
UNKNOWN = "unknown"
# fixed values: usual notices of public licences, by family
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "all-rights-reserved": ("All rights reserved.", "Copyright (c) 2020 Example Holder. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', "Released under the Apache License 2.0."),
    "bsd": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.', 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.'),
    "mpl-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."),
    "unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
}
_STRIP = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    return [w for w in (_STRIP.sub("", x) for x in text.lower().split()) if w]


@dataclass
class Model:
    families: list[str]  # the unknown class comes last
    vocabulary: dict[str, int]  # from 1; 0 is any other word
    keys: np.ndarray  # sorted n-grams
    weights: np.ndarray  # (n-grams, classes)
    bias: np.ndarray
    temperature: float = 1.0

    def grams(self, ids: np.ndarray, line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(feature number, position of its first word) of all known n-grams within paragraphs."""
        size = len(self.vocabulary) + 1
        key, ok = ids.copy(), ids > 0
        for n in range(3):
            if n:
                key = key[:-1] * size + ids[n:]
                ok = ok[:-1] & (ids[n:] > 0) & (line[: len(line) - n] == line[n:])
            at = np.flatnonzero(ok)
            place = np.minimum(np.searchsorted(self.keys, key[at]), max(len(self.keys) - 1, 0))
            hit = self.keys[place] == key[at] if len(self.keys) else np.zeros(len(at), bool)
            yield place[hit], at[hit]

    def logits(self, ids: np.ndarray, line: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
        out = np.zeros((blocks, len(self.bias)))
        for feature, at in self.grams(ids, line):
            for c in range(len(self.bias)):
                out[:, c] += np.bincount(block[at], self.weights[feature, c], minlength=blocks)
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def scan(self, texts: pa.Array) -> list[list[tuple[int, str, float, float]]]:
        """(line number, family, probability, overlap) of the confirmed windows of each text, in order of lines."""
        lines = pc.split_pattern(texts, "\n")
        starts = lines.offsets.to_numpy().astype(np.int64)
        flat = lines.values.slice(starts[0], starts[-1] - starts[0])
        starts = starts - starts[0]
        codes, offsets, raw = encode_words(pc.utf8_split_whitespace(pc.utf8_lower(flat)))
        blank = np.array([not w for w in raw], bool)
        written = segment_sum((~blank[codes]).astype(np.int64), offsets) > 0 if len(codes) else np.zeros(len(flat), bool)
        names = [w if w.isalnum() else _STRIP.sub("", w) for w in raw]
        keep = np.fromiter(map(bool, names), bool, len(names))[codes] if len(codes) else np.zeros(0, bool)
        known = np.fromiter((self.vocabulary.get(w, 0) for w in names), np.int64, len(names))
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        n = np.diff(offsets)
        doc = np.searchsorted(starts, np.arange(len(n)), side="right") - 1
        # a paragraph ends with its text and at a line without a word
        ends = np.concatenate([[True], (doc[1:] != doc[:-1]) | ~written[1:] | ~written[:-1]])
        paragraph = np.cumsum(ends)
        per_line = -(-n // BLOCK)
        first = np.cumsum(per_line) - per_line
        block = np.repeat(first, n) + (np.arange(len(codes)) - np.repeat(offsets[:-1], n)) // BLOCK
        total = int(per_line.sum())
        logits = self.logits(known[codes] if len(codes) else codes, np.repeat(paragraph, n), block, total)
        line = np.repeat(np.arange(len(n)), per_line)
        low = offsets[line] + (np.arange(total) - first[line]) * BLOCK if total else np.zeros(0, np.int64)
        high = np.minimum(low + BLOCK, offsets[line + 1]) if total else low
        summed = np.concatenate([np.zeros((1, logits.shape[1])), np.cumsum(logits, axis=0)])
        # the last block of each window: within its line, and within its paragraph
        own = np.arange(total)
        last = [np.minimum(own + 1, (first + per_line)[line] - 1)]
        behind = np.searchsorted(high, low + 2 * BLOCK, side="right") - 1
        last.append(np.maximum(np.minimum(behind, np.searchsorted(paragraph[line], paragraph[line], side="right") - 1), last[0]))
        found: list[list[_Window]] = [[] for _ in range(len(texts))]
        for upto in last if (last[1] > last[0]).any() else last[:1]:
            p = self.probabilities(summed[upto + 1] - summed[own])
            best = p.argmax(axis=1) if total else own
            for b in np.flatnonzero((best < len(self.families) - 1) & (p.max(axis=1, initial=0.0) >= LEAST_PROBABILITY)).tolist():
                s, e = int(low[b]), int(high[upto[b]])
                family, words = self.families[int(best[b])], [names[c] for c in codes[s:e].tolist()]
                shared, common = overlap(words, family)
                if shared >= LEAST_OVERLAP:
                    at = int(line[b])
                    found[int(doc[at])].append(_Window(-common, -shared, e - s, s, family, at - int(starts[doc[at]]), float(p[b].max()), words))
        return [sorted((w.line, w.family, w.probability, -w.shared) for w in _apart(x)) for x in found]


@dataclass(order=True)
class _Window:
    """Ordered by how much it says: word pairs in common, their share, then the shorter and the earlier."""

    common: int
    shared: float
    length: int
    start: int
    family: str
    line: int
    probability: float
    words: list[str]


def _apart(windows: list[_Window]) -> list[_Window]:
    """Of overlapping windows the best: of one family, and of others where the better one's family explains both as well."""
    kept: list[_Window] = []
    begins: list[int] = []
    for w in sorted(windows):
        near = kept[bisect_left(begins, w.start - 2 * BLOCK) : bisect_left(begins, w.start + w.length)]
        near = [k for k in near if k.start + k.length > w.start]
        if not any(k.family == w.family or overlap(w.words, k.family)[0] >= -0.9 * w.shared for k in near):
            at = bisect_right(begins, w.start)
            begins.insert(at, w.start)
            kept.insert(at, w)
    return kept


def overlap(words: list[str], family: str) -> tuple[float, int]:
    """Largest share of a template's word pairs that the words hold in order, or of the words' that a template holds; and most pairs in common."""
    own = {*zip(words, words[1:], strict=False)} or {(w,) for w in words}
    best, most = 0.0, 0
    for template in TEMPLATES.get(family, ()):
        other = words_of(template)
        pairs = {*zip(other, other[1:], strict=False)} or {(w,) for w in other}
        common = len(own & pairs)
        best, most = max(best, common / len(pairs), common / max(len(own), 3)), max(most, common)
    return best, most


def fit(corpus: list[str], seed: int = 0, copies: int = 60) -> Model:
    """Learn from the templates and from texts that stand for the unknown class."""
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    examples: list[tuple[list[str], int]] = []
    pool = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)})
    background = [words[at : at + 2 * BLOCK] for text in corpus for words in _paragraphs(text) for at in range(0, len(words), 2 * BLOCK)]
    for c, family in enumerate(families[:-1]):
        for template in TEMPLATES[family]:
            words = words_of(template)
            for k in range(copies):
                kept = [w for w in words if k == 0 or rng.random() > 0.1]
                if k % 3 == 1 and background:  # prose around it
                    other = background[rng.integers(len(background))]
                    at = int(rng.integers(len(other) + 1))
                    kept = other[:at] + kept + other[at:]
                if kept:
                    examples.append((kept, c))
    for _ in range(copies * 40):
        size = int(rng.integers(3, 40))
        examples.append(([pool[i] for i in rng.integers(len(pool), size=size)], len(families) - 1))
    examples += [(words, len(families) - 1) for words in background]
    vocabulary = {w: i + 1 for i, w in enumerate(pool)}
    size = len(vocabulary) + 1
    keys: set[int] = set()
    for ts in TEMPLATES.values():
        for t in ts:
            ids = [vocabulary[w] for w in words_of(t)]
            for k in (1, 2, 3):
                for i in range(len(ids) - k + 1):
                    key = 0
                    for x in ids[i : i + k]:
                        key = key * size + x
                    keys.add(key)
    model = Model(families, vocabulary, np.array(sorted(keys), np.int64), np.zeros((len(keys), len(families))), np.zeros(len(families)))
    ids = np.array([vocabulary.get(w, 0) for words, _ in examples for w in words], np.int64)
    row = np.repeat(np.arange(len(examples)), [len(w) for w, _ in examples])
    truth = np.array([c for _, c in examples])
    parts = [(f, row[at]) for f, at in model.grams(ids, row)]
    feature, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    held = np.arange(len(examples)) % 5 == 0
    use = ~held[owner]
    feature_t, owner_t = feature[use], owner[use]
    classes = len(families)
    squares, bias_squares = np.full_like(model.weights, 1e-8), np.full(classes, 1e-8)
    onehot = np.eye(classes)[truth]

    def scores(f: np.ndarray, o: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(o, model.weights[f, c], minlength=len(examples)) for c in range(classes)], axis=1)

    for _ in range(60):
        error = onehot - model.probabilities(scores(feature_t, owner_t))
        error[held] = 0
        gradient = np.stack([np.bincount(feature_t, error[owner_t, c], minlength=len(model.keys)) for c in range(classes)], axis=1) / len(examples) - 1e-5 * model.weights
        squares += gradient**2
        model.weights += 0.2 * gradient / np.sqrt(squares)
        step = error.sum(axis=0) / len(examples)
        bias_squares += step**2
        model.bias += 0.1 * step / np.sqrt(bias_squares)
    left = scores(feature, owner)[held]
    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(np.maximum(_at(model, left, t)[np.arange(held.sum()), truth[held]], 1e-12)).mean())
    return model


def _at(model: Model, logits: np.ndarray, temperature: float) -> np.ndarray:
    z = (logits + model.bias) / temperature
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit with at most ``sample_rows`` rows of the corpus, chosen by a hash of their id, for the unknown class; paragraphs that share much with a template are left out."""
    ids = docs.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).dropDuplicates([id_col])
    rows = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).collect()  # bounded by sample_rows
    texts = [r[1] for r in sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0]) if r[1]]
    return fit(["\n\n".join(" ".join(words) for words in _paragraphs(t) if max(overlap(words, f)[0] for f in TEMPLATES) < LEAST_OVERLAP / 2) for t in texts])


def _paragraphs(text: str) -> list[list[str]]:
    return [words for words in (words_of(p) for p in re.split(r"\n\s*\n", text)) if words]


SCHEMA = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("overlap", T.DoubleType())]))
_FOUND = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64())]))


def scan_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``licenses``: array<line, family, probability, overlap> (a column of that name is replaced).

    Whole texts, however long; a window is told by its first line, lines counted from zero; of windows
    that tie the shorter and then the earlier counts. Null and empty texts find nothing; repeated
    rows stay; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    key = uuid.uuid4().hex
    source = docs.drop("licenses")
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(key, lambda: pickle.loads(shared.value))
        for batch in slices(batches, text_col):
            found = [[dict(zip(("line", "family", "probability", "overlap"), f, strict=True)) for f in fs] for fs in model.scan(texts_of(batch, text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND)], [*names, "licenses"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("licenses", SCHEMA)]))
