"""License scans: a trained paragraph classifier confirmed by template comparison.

A passage is a run of words in a paragraph (lines up to a blank one, so wrapped and commented notices
are whole) that keeps using word pairs known from notices. The classifier is a multinomial logistic
regression over the distinct word unigrams and bigrams of a passage, trained on variations of known
notices, on notices of made-up names (the class ``unknown``) and on a bounded sample of the corpus's
own paragraphs (the class ``none``). Its temperature is set on variations kept out of training. A
family is confirmed where a passage has enough of one of its templates, and the words that tell it
from its relatives; each confirmed family gives a row, a notice without any is ``unknown``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_values, chunks, lowest, mix, prefix_sums, span_hash, utf8, word_spans
from spanloom.sources.shipping import ship

# Notices by family.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal Public Domain Dedication."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Words that a family's notice must have, and words that show a relative of it.
NEEDS = {
    "AGPL-3.0": (["affero", "3"], []),
    "Apache-2.0": (["apache", "2"], []),
    "BSD-2-Clause": (["bsd", "2"], []),
    "BSD-3-Clause": ([], []),
    "CC-BY-4.0": (["4"], ["nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike"]),
    "CC-BY-NC-4.0": (["4"], ["nd", "sa", "noderivatives", "sharealike"]),
    "CC-BY-ND-4.0": (["4"], ["nc", "sa", "noncommercial", "sharealike"]),
    "CC-BY-SA-4.0": (["4"], ["nc", "nd", "noncommercial", "noderivatives"]),
    "CC0-1.0": ([], []),
    "GPL-2.0": (["2"], ["lesser", "library", "affero"]),
    "GPL-3.0": (["3"], ["lesser", "library", "affero"]),
    "ISC": ([], []),
    "LGPL-3.0": (["lesser", "3"], []),
    "MIT": ([], []),
    "MPL-2.0": (["mozilla", "2"], []),
    "Unlicense": ([], []),
}
OPENINGS = ["Licensed under the", "Released under the", "This work is licensed under the", "Distributed under the terms of the", "Subject to the terms of the", "Use is governed by the"]
ENDINGS = ["License", "Public License", "Software License, version {n}", "Community License {n}", "Source License, Version {n}.0", "Documentation License", "Data License, version {n}", "proprietary license"]
GAP = 6
NOTICE_PAIRS = 4
_PARTS = np.ones(256, bool)
_PARTS[128:] = False
_PARTS[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = False
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_U = np.uint64


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _U(3) + words[1:] * _U(0xD6E8FEB86659FD93)) if len(words) > 1 else words[:0]


def _words(text: str) -> np.ndarray:
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _PARTS)
    return span_hash(prefix_sums(byte_values(data)), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def _grams(words: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate((words, _pairs(words))))


def made_up(n: int, seed: int) -> list[str]:
    """Notices of licenses that don't exist."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        name = "".join("bdfgklmnprstvz"[rng.integers(14)] + "aeiou"[rng.integers(5)] for _ in range(rng.integers(2, 5))).capitalize()
        out.append(f"{OPENINGS[rng.integers(len(OPENINGS))]} {name} {ENDINGS[rng.integers(len(ENDINGS))].format(n=rng.integers(1, 10))}.")
    return out


def examples(others: list[str], copies: int, seed: int) -> list[tuple[np.ndarray, str]]:
    """Variations of notices: words lost, and text of the corpus before or after them."""
    rng, out = np.random.default_rng(seed), []
    sources = [(f, t) for f, texts in TEMPLATES.items() for t in texts for _ in range(copies)] + [("unknown", t) for t in made_up(12 * copies, seed)]
    for family, text in sources:
        words = [w for w in text.split() if rng.random() > 0.05]
        extra = others[rng.integers(len(others))].split() if others and rng.random() < 0.5 else []
        out.append((_grams(_words(" ".join([*extra[: rng.integers(1, 8)], *words] if rng.random() < 0.5 else [*words, *extra[: rng.integers(1, 8)]]))), family))
    return out


class Model:
    """Sorted feature hashes, a column of weights for each class, biases and the temperature."""

    def __init__(self, others: list[str], copies: int = 12, epochs: int = 150, rate: float = 0.5, l2: float = 1e-4, prior: float = 0.01):
        self.classes = ["none", "unknown", *sorted(TEMPLATES)]
        known = [_words(t) for texts in TEMPLATES.values() for t in texts] + [_words(f"{o} {e.format(n=1)}") for o in OPENINGS for e in ENDINGS]
        self.hashes = np.unique(np.concatenate([_grams(w) for w in known]))
        self.pairs = np.unique(np.concatenate([_pairs(w) for w in known]))
        half = 3 * len(others) // 4
        kept_out = others[half:]
        train = [*examples(others[:half], copies, 1), *((g, "none") for g in self._ordinary(others[:half]))]
        check = [*examples(kept_out, max(2, copies // 4), 2), *((g, "none") for g in self._ordinary(kept_out))]
        x, y = self._matrix(train)
        w, b = np.zeros((len(self.hashes), len(self.classes))), np.zeros(len(self.classes))
        b[0] = 1.0  # a passage without any of the words is none of them
        goal = np.eye(len(self.classes))[y]
        weight = (1.0 / np.bincount(y, minlength=len(self.classes)).clip(1))[y][:, None]
        step = np.zeros_like(w)
        for _ in range(epochs):  # AdaGrad over the whole bounded sample
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - goal) * weight
            gw = x.T @ g + l2 * w
            step += gw * gw
            w -= rate * gw / (np.sqrt(step) + 1e-8)
            b[1:] -= rate * g.sum(axis=0)[1:]
        self.weights, self.bias = w, b
        x, y = self._matrix(check)
        z = x @ w + b

        def loss(t: float) -> float:
            s = z * t
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        # classes weigh the same in training; of the passages that are looked at few are notices
        self.prior = np.zeros(len(self.classes))
        self.prior[1:] = np.log(prior / (1 - prior))
        self.templates = {f: [_grams(_words(t)) for t in texts] for f, texts in TEMPLATES.items()}
        self.needs = {f: tuple(np.array([_words(w)[0] for w in side], np.uint64) for side in sides) for f, sides in NEEDS.items()}

    def _ordinary(self, lines: list[str]) -> list[np.ndarray]:
        """N-grams of ordinary lines, and of the passages that are looked at in them; lines that may be notices themselves are left out."""
        lines = [t for t in lines if np.isin(_pairs(_words(t)), self.pairs).sum() < NOTICE_PAIRS]
        found = passages(*utf8(pa.array(lines, pa.string())), self.pairs, sieve_of(self.pairs)) if lines else []
        return [_grams(_words(t)) for t in lines] + [x[-1] for x in found]

    def _matrix(self, rows: list[tuple[np.ndarray, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.hashes)))
        for i, (h, _) in enumerate(rows):
            x[i] = np.isin(self.hashes, h)
        return x, np.array([self.classes.index(c) for _, c in rows])

    def probabilities(self, own: np.ndarray) -> np.ndarray:
        z = (self.weights[np.isin(self.hashes, own)].sum(axis=0) + self.bias) * self.temperature + self.prior
        p = np.exp(z - z.max())
        return p / p.sum()

    def similarity(self, family: str, own: np.ndarray, core: np.ndarray) -> float:
        """Share of the closest template's n-grams that are there; 0 without the words that the family needs, or with a relative's among the words of the notice itself (core)."""
        needs, bars = self.needs[family]
        if not np.isin(needs, own).all() or np.isin(bars, core).any():
            return 0.0
        return max(float(np.isin(t, own).mean()) for t in self.templates[family])

    def families(self, own: np.ndarray, core: np.ndarray, sure: float, alike: float, least: float) -> list[tuple[str, float, float, bool]]:
        """(family, probability, similarity, confirmed) of a passage, as the classifier names them.

        Each class of at least ``least`` is a candidate, the likeliest first; its templates confirm or refute
        it. The n-grams of a confirmed one are taken out, and the classifier is asked again about the
        rest, as a passage may hold several notices. A passage that is a notice by ``sure``, but of which no candidate is
        confirmed, is unknown.
        """
        out, left = [], own
        while len(left):
            p = self.probabilities(left)
            ranked = [k for k in np.argsort(-p, kind="stable") if p[k] >= least and k > 1]
            found = next(((self.classes[k], float(p[k]), s) for k in ranked for s in [self.similarity(self.classes[k], left, core)] if s >= alike), None) if 1 - p[0] >= least else None
            if found is None:
                break
            out.append((*found, True))
            best = max(self.templates[found[0]], key=lambda t: np.isin(t, left).mean())
            left = left[~np.isin(left, best)]
        p = self.probabilities(own)
        if not out and 1 - p[0] >= sure:
            out.append(("unknown", float(1 - p[0]), max(self.similarity(f, own, core) for f in TEMPLATES), False))
        return out


def sieve_of(known: np.ndarray) -> np.ndarray:
    """For each value of the first 20 bits whether a known hash begins with it."""
    sieve = np.zeros(1 << 20, bool)
    sieve[(known >> _U(44)).astype(np.int64)] = True
    return sieve


def passages(data: np.ndarray, offs: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> list[tuple]:
    """(row, paragraph, line, start, end, words, n-grams with those of the words beside it) of the passages of all rows; start and end are byte places of whole lines."""
    low = _LOWER[data]
    starts, ends, rows = word_spans(low, offs, _PARTS)
    if len(starts) < 2:
        return []
    words = span_hash(prefix_sums(byte_values(low)), starts, ends)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    newlines = np.concatenate(([0], np.cumsum(data == 10)))
    line = newlines[starts]
    opens = np.ones(len(words), bool)  # a paragraph ends where a line without words stands between
    opens[1:] = (row[1:] != row[:-1]) | (line[1:] - line[:-1] > 1)
    block = np.cumsum(opens)
    pairs = _pairs(words)
    hit = np.flatnonzero(sieve[(pairs >> _U(44)).astype(np.int64)])  # most pairs end here
    at = np.minimum(np.searchsorted(known, pairs[hit]), len(known) - 1)
    hit = hit[(known[at] == pairs[hit]) & (block[hit + 1] == block[hit])]
    if not len(hit):
        return []
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > GAP) | (block[hit[1:]] != block[hit[:-1]])
    first, last = hit[new], np.append(hit[np.flatnonzero(new)[1:] - 1], hit[-1]) + 1
    out = []
    breaks = np.flatnonzero(data == 10)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        r = int(row[a])
        low_word, high_word = max(a - 2, int(np.searchsorted(block, block[a]))), min(b + 3, int(np.searchsorted(block, block[a], side="right")))
        own = words[low_word:high_word]
        before = np.searchsorted(breaks, starts[a])
        start = max(int(offs[r]), int(breaks[before - 1]) + 1 if before else 0)
        after = np.searchsorted(breaks, ends[b] - 1)
        end = min(int(offs[r + 1]), int(breaks[after]) + 1 if after < len(breaks) else len(data))
        base = int(offs[r])
        out.append((r, int(block[a] - block[rows[r]]), int(line[a] - newlines[base]), start - base, end - base, words[a : b + 1], _grams(own)))
    return out


def sample_paragraphs(docs: DataFrame, documents: int, most: int) -> list[str]:
    """Lines of the ``documents`` rows of lowest hash, at most ``most``, without any that names a license."""
    chosen = lowest(docs.where("text is not null").select("doc_id", "text"), "doc_id", documents, docs.count())
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("p")).where("length(p) between 20 and 2000 and not lower(p) like '%licen%' and not lower(p) like '%copyright%'")
    return [r.p for r in lines.orderBy(F.xxhash64("p"), "p").limit(most).collect()]


def license_scan(docs: DataFrame, documents: int = 1000, most: int = 4000, sure: float = 0.5, alike: float = 0.7, least: float = 0.05) -> DataFrame:
    """License notices in the paragraphs of every whole text.

    Returns (doc_id, paragraph, line, start, end, family, probability, similarity, confirmed), a row
    for each family of each passage that is taken for a notice: the number of the paragraph (lines
    with words up to one without), of the passage's first line and the byte range of its lines in the
    text, the family or 'unknown', the calibrated probability of the family (of any notice, if it is unknown), the share
    of its closest template's n-grams that the passage has, and whether that confirms the family (``alike`` or
    more). The classifier names the families, its classes of ``least`` or more; templates only confirm or refute them. A null doc_id is kept. Null and empty texts give no rows, nor does an empty table; repeated rows each give
    theirs. Texts of any length are searched whole. ``documents`` and ``most`` bound the sample of
    ordinary lines that the classifier is trained on. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    model = Model(sample_paragraphs(docs, documents, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sieve_of(model.pairs)
        for whole in batches:
            for batch in chunks(whole, "text"):
                out = []
                for r, paragraph, line, start, end, core, own in passages(*utf8(batch.column("text")), model.pairs, sieve):
                    out += [(r, paragraph, line, start, end, *found) for found in model.families(own, core, sure, alike, least)]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                names = ["paragraph", "line", "start", "end", "family", "probability", "similarity", "confirmed"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([x[0] for x in out], pa.int64())), *(pa.array([x[k + 1] for x in out], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])

    schema = "doc_id long, paragraph long, line long, start long, end long, family string, probability double, similarity double, confirmed boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
