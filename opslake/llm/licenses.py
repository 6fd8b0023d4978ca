"""License scan: MinHash bands over overlapping text windows, exact shingle containment.

A template of fewer than ``ngram`` words is looked for by shingles of all its words,
the others by shingles of ``ngram`` words; each shingle length has its own bands.
Templates are grouped by their number of word shingles.  For a group of at most
``L`` shingles a document's shingle stream is cut into blocks of ``L``; two
neighbouring blocks are a window, so every run of L shingles lies inside a window
(for ``L`` = 1 the block itself, which one band finds for certain).
A window that holds the wanted share ``c`` of a template of n shingles has Jaccard
similarity of at least ``c n / (2 L + (1 - c) n)`` with it; the number of one-row
bands is the least one whose collision probability at that similarity is
``probability``.  Windows that agree with a template in a band are verified by exact
containment of its shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from opslake.llm import textops as T

#: fixed values: notices and opening paragraphs of public licences
LICENSE_TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC0-1.0", "CC0 1.0"),
]


def bands(n: int, block: int, containment: float, probability: float) -> int:
    """Least number of one-row bands that find a template of ``n`` shingles with the given probability."""
    j = containment * n / (2 * block + (1 - containment) * n)
    return 1 if j >= 1 else max(1, math.ceil(math.log(1 - probability) / math.log(1 - j)))


class TemplateIndex:
    def __init__(self, templates: list[tuple[str, str]], ngram: int, containment: float, probability: float, seed: int = 5):
        self.names, self.containment = [x for x, _ in templates], containment
        words = self._words(pa.array([x for _, x in templates], pa.string()))
        size = np.minimum(np.diff(T.by_doc(words[0], len(templates))), ngram)
        self.sets = [np.empty(0, np.uint64)] * len(templates)
        groups: dict[tuple[int, int], list[int]] = {}
        for k in sorted({int(x) for x in size if x}):
            at, h = self._shingles(words, k)[:2]
            for i in np.flatnonzero(size == k):
                self.sets[i] = s = np.unique(h[at[i]:at[i + 1]])
                # group sizes grow by a half
                block = math.ceil(1.5 ** math.ceil(math.log(len(s), 1.5) - 1e-9) - 1e-9)
                groups.setdefault((k, block), []).append(int(i))
        self.need = [math.ceil(containment * len(s) - 1e-9) for s in self.sets]
        r = np.random.default_rng(seed)
        self.groups: dict[int, list[tuple]] = {}
        for (k, block), rows in sorted(groups.items()):
            b = bands(min(len(self.sets[i]) for i in rows), block, containment, probability) if block > 1 else 1
            mul = r.integers(0, 1 << 63, b, np.uint64) * np.uint64(2) + np.uint64(1)
            mins = np.array([[(self.sets[i] * m).min() for m in mul] for i in rows])
            self.groups.setdefault(k, []).append((block, rows, mul, mins))

    def _words(self, text: pa.Array):
        raw, off = T.flat(pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), "")))
        return *T.words(raw, off, T.ALNUM_WORDS, lower=False), off

    def _shingles(self, words: tuple, k: int):
        doc, _, _, h, off = words
        at, sh = T.shingles(doc, h, k)
        return T.by_doc(doc[at], len(off) - 1), sh, at

    def matches(self, text: pa.Array):
        """(document, template, containment, start byte, end byte in the lower-cased text) of verified windows."""
        words = self._words(text)
        if len(words[0]):
            for k, groups in self.groups.items():
                yield from self._matches(words, k, groups)

    def _matches(self, words: tuple, k: int, groups: list[tuple]):
        doc, s, e, _, off = words
        cut, sh, at = self._shingles(words, k)
        for block, rows, mul, mins in groups:
            n = -(-len(sh) // block)
            padded = np.full(n * block, np.iinfo(np.uint64).max, np.uint64)
            found = set()
            for b, m in enumerate(mul):
                padded[:len(sh)] = sh * m
                low = padded
                if block > 1:
                    low = padded.reshape(n, block).min(1)
                    low[:-1] = np.minimum(low[:-1], low[1:])
                for t in range(len(rows)):
                    found.update((int(x), rows[t]) for x in np.flatnonzero(low == mins[t, b]))
            best: dict[tuple[int, int], tuple] = {}
            for x, t in found:
                lo, hi = x * block, min((x + min(block, 2)) * block, len(sh))
                for d in range(doc[at[lo]], doc[at[hi - 1]] + 1):
                    a, z = max(lo, cut[d]), min(hi, cut[d + 1])
                    hit = a + np.flatnonzero(np.isin(sh[a:z], self.sets[t]))
                    shared = len(np.unique(sh[hit]))
                    if shared < self.need[t]:
                        continue
                    last = min(at[hit[-1]] + k, np.searchsorted(doc, d, "right")) - 1
                    got = (shared / len(self.sets[t]), -int(s[at[hit[0]]] - off[d]), -int(e[last] - off[d]))
                    best[d, t] = max(best.get((d, t), got), got)
            for (d, t), (c, start, end) in best.items():
                yield d, t, c, -start, -end


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, ngram: int = 5, containment: float = 0.8,
                    probability: float = 0.99999) -> DataFrame:
    """Licence notices in every whole text: doc_id, license, template (index), containment, start, end.

    One row per document and template with the best (then first) window; start
    and end are byte positions in the lower-cased text.  Words are runs of
    letters, digits and non-ASCII characters, lower case; a template of fewer than
    ``ngram`` words is one shingle of all its words and is found in any text that
    holds them in sequence.  Null and empty texts have no match, repeated rows give repeated
    matches, extra columns are ignored.  ``templates`` is a fixed short list.
    """
    index = TemplateIndex(templates or LICENSE_TEMPLATES, ngram, containment, probability)

    def run(batches):
        for b in T.slices(batches):
            got = sorted(index.matches(b.column("text")))
            d = pa.array([x[0] for x in got], pa.int32())
            yield pa.record_batch([b.column("doc_id").take(d), pa.array([index.names[x[1]] for x in got], pa.string()),
                                   pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.float64()),
                                   pa.array([x[3] for x in got], pa.int64()), pa.array([x[4] for x in got], pa.int64())],
                                  ["doc_id", "license", "template", "containment", "start", "end"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, license string, template int, containment double, start long, end long")
