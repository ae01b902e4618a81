"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Units are a text's lines, the text as a whole and, for each template, every window of as many words as it has, across
line breaks. Words are runs of ASCII letters and digits in lower case (dots inside
numbers count); a unit's bigrams are a set, with both ends marked, so one word has bigrams too. Two sets of sizes
m and n have a Dice coefficient of at most 2 min(m, n) / (m + n): templates are sorted by size, and only those whose
bound reaches the threshold are compared. Of equal coefficients the earlier template name wins, then the earlier line.

Windows are compared only for templates of which the text has as many bigrams as the threshold takes. Of windows that
share words the best one counts; one with words of a line that matches, or in a text that matches, is no further unit.

Null and empty texts and texts without a match give null licence and dice, 0 units. Repeated rows each give a row;
extra columns are ignored.
"""

import bisect
import re
from importlib import resources

import numpy as np
import pyarrow as pa

THRESHOLD = 0.8
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Public licence notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: Full texts (licenses/NAME.txt, without copyright lines) and the parts of them that stand alone.
for _name in ("Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "MIT", "MPL-2.0"):
    TEMPLATES[_name].append(resources.files(__package__).joinpath("licenses", f"{_name}.txt").read_text("utf-8"))
_apache, _mit = TEMPLATES["Apache-2.0"][-1], TEMPLATES["MIT"][-1]
TEMPLATES["Apache-2.0"].append(_apache[_apache.rindex("Licensed under the Apache License") :])
TEMPLATES["MIT"].append(_mit[: _mit.index("The above copyright notice")])


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(text: str | list[str]) -> frozenset:
    """Of a text or its words."""
    words = ["<", *(words_of(text) if isinstance(text, str) else text), ">"]
    return frozenset(zip(words, words[1:])) if len(words) > 2 else frozenset()


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        rows = sorted((len(b), name, b) for name, texts in templates.items() for b in map(bigrams, texts))
        self.sizes, self.rows, self.threshold = [r[0] for r in rows], rows, threshold
        self.most = max(self.sizes, default=0) * (2 - threshold) / threshold
        # for windows: (name, words, bigrams), and which template has which bigram within (ends aside), by number
        self.texts = [(name, w, len(bigrams(w))) for name, texts in templates.items() for w in map(words_of, texts) if w]
        self.vocab = {w: i for i, w in enumerate(sorted({w for _, ws, _ in self.texts for w in ws}), 1)}
        codes = [np.unique(self.codes(self.numbers(w))) for _, w, _ in self.texts]
        self.known = np.unique(np.concatenate([[0], *codes])).astype(np.int64)
        self.has = np.array([np.isin(self.known, c) for c in codes]).reshape(len(codes), len(self.known))
        self.need = np.array([threshold * n / (2 - threshold) for *_, n in self.texts]) - 2 - 1e-9

    def numbers(self, words: list[str]) -> np.ndarray:
        """Of each word its number in the templates, or 0."""
        return np.fromiter((self.vocab.get(w, 0) for w in words), np.int64, len(words))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Of each bigram its number, 0 where a word is in no template."""
        return np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * (len(self.vocab) + 1) + ids[1:], 0)

    def windows(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(dice, name, first word, end) of the windows at the threshold or over it, the best of those that share words."""
        codes = self.codes(self.numbers(words))
        at = np.searchsorted(self.known, codes).clip(max=len(self.known) - 1)
        at[self.known[at] != codes] = 0
        found = np.unique(at[at > 0])
        likely = np.flatnonzero(self.has[:, found].sum(axis=1) >= self.need)
        likely = [t for t in likely.tolist() if len(self.texts[t][1]) <= len(words)]
        if not likely:
            return []
        own = {}
        ids = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words))
        pairs = ids[:-1] * len(own) + ids[1:]
        order = np.argsort(pairs, kind="stable")
        again = np.flatnonzero(pairs[order][1:] == pairs[order][:-1])
        before = np.full(len(pairs), -1)  # the place of the same bigram before
        before[order[again + 1]] = order[again]

        def distinct(places, length, starts):
            """Of each window the number of its unlike bigrams at these places: each counts where it comes first."""
            low, high = np.maximum(np.maximum(before[places] + 1, places - length + 2), 0), np.minimum(places, starts - 1)
            low, high = low[low <= high], high[low <= high]
            return np.cumsum(np.bincount(low, minlength=starts + 1) - np.bincount(high + 1, minlength=starts + 1))[:starts]

        hits = []
        for t in likely:
            name, text, n = self.texts[t]
            length, starts = len(text), len(words) - len(text) + 1
            m = distinct(np.arange(len(pairs)), length, starts) + 2
            common = distinct(np.flatnonzero(self.has[t][at] & (at > 0)), length, starts)
            common = common + (ids[:starts] == own.get(text[0], -1)) + (ids[length - 1 :] == own.get(text[-1], -1))
            dice = 2 * common / (m + n)
            hits += [(float(dice[i]), name, i, i + length) for i in np.flatnonzero(dice >= self.threshold).tolist()]
        taken, out = np.zeros(len(words), bool), []
        for hit in sorted(hits, key=lambda x: (-x[0], *x[1:])):
            if not taken[hit[2] : hit[3]].any():
                taken[hit[2] : hit[3]] = True
                out.append(hit)
        return out

    def match(self, unit: str | list[str]) -> tuple[float, str] | None:
        """The best (dice, name) at the threshold or over it."""
        # a bigram has a word, so a unit with far more words than bigrams repeats itself; sets decide, not lengths
        own = bigrams(unit)
        m, t, best = len(own), self.threshold, None
        if not m or m > self.most + 1:
            return None
        at = bisect.bisect_left(self.sizes, int(m * t / (2 - t)) - 1)
        for n, name, other in self.rows[at:]:
            if n > m * (2 - t) / t + 1:
                break
            dice = 2 * len(own & other) / (m + n)
            if dice >= t and (best is None or (-dice, name) < (-best[0], best[1])):
                best = (dice, name)
        return best

    def scan(self, text: str | None) -> tuple[str | None, float | None, int, list[str]]:
        """Best licence, its coefficient, units that match, all licences found."""
        lines = [words_of(x) for x in (text or "").split("\n") if x]
        words = [w for x in lines for w in x]
        ends = np.cumsum([len(x) for x in lines]).tolist()
        got, taken = [], np.zeros(len(words), bool)
        for line, end in zip(lines, ends):
            if x := self.match(line):
                got.append(x)
                taken[end - len(line) : end] = True
        if len(lines) > 1 and (x := self.match(words)):
            got.append(x)
            taken[:] = True
        near = self.windows(words)
        n = len(got) + sum(not taken[a:b].any() for *_, a, b in near)
        got += [x[:2] for x in near]
        best = min(got, key=lambda x: (-x[0], x[1]), default=None)
        return (best[1], best[0], n, sorted({n for _, n in got})) if best else (None, None, 0, [])


def license_scan(docs, templates=TEMPLATES, threshold: float = THRESHOLD):
    def run(batches):
        s = Scanner(templates, threshold)
        for b in batches:
            rows = [(d, *s.scan(t)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "dice", "n_units", "licenses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, dice double, n_units long, licenses array<string>")


def op4_license_scan(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_license_scan": op4_license_scan}
