"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates are sets of 5-word shingles (one shingle of all words if they are fewer). An occurrence is a stretch of up
to 5/4 of a template that holds a share CONTAINED of its shingles. Templates whose number of shingles m is between 2**c
and 2**(c+1) are looked for in windows of WIDE * 2**c shingles, one every 2**c: stretches of (WIDE - 1) * 2**c, more
than 5/4 of any of them, lie whole in a window. Such a window has a Jaccard similarity of CONTAINED / (1 + WIDE -
CONTAINED), 0.19, or more with the template, whatever m; with BANDS bands of one minimum hash each the chance that all
bands miss is below (1 - 0.19) ** BANDS, MISSED. What the bands bring up is compared with the
template's shingles within the window, word by word; only the exact containment decides. Every occurrence is told.
"""

from __future__ import annotations

import math
import pkgutil
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import arrow_map, column, pieces

SHINGLE, CONTAINED, WIDE, MISSED = 5, 0.8, 4, 1e-4
BANDS = math.ceil(math.log(MISSED) / math.log(1 - CONTAINED / (1 + WIDE - CONTAINED)))
#: Bytes of text whose bands are taken at once: their arrays stay in a core's cache.
SCAN_BYTES = 300_000

#: Licenses of which the whole text, or BSD's clauses and disclaimer, is a file beside this one.
WHOLE = ("Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "CC0-1.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause")

#: Fixed values: (license, text) of notices as they are commonly written, and whole texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("reserved", "All rights reserved."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    *((name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in WHOLE),
)


def _shingles(w: tv.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the shingle of k words that begins there, and whether there is one."""
    hashes, there = np.zeros(len(w.hash), tv.U), np.zeros(len(w.hash), bool)
    g, ok = tv.grams(w.hash, k), tv.together(w.doc, k)
    hashes[: len(g)], there[: len(g)] = g ^ tv.U(k), ok
    return hashes, there


def _band(hashes: np.ndarray, b: int) -> np.ndarray:
    """A band's order of shingles: hashes are mixed already, so a product with an odd number (one for each band) will do."""
    return hashes * (tv.mix(np.full(1, b + 1, tv.U)) | tv.U(1))


class Matcher:
    """Templates by shingle size and size class, with the minimum hashes of each."""

    def __init__(self, templates: tuple[tuple[str, str], ...], bands: int) -> None:
        w = tv.words(pa.array([t for _, t in templates], pa.string()), tv.ALNUM)
        self.bands, self.words, self.data = bands, w, np.concatenate([w.data, np.zeros(8, np.uint8)])
        self.most = [max(n - SHINGLE + 1, 1) * 5 // 4 for n in w.counts.tolist()]  # places of an occurrence with some words put in
        self.classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        self.at: dict[int, np.ndarray] = {}  # for each template the first word of each of its shingles
        for i, (n, a) in enumerate(zip(w.counts.tolist(), w.first.tolist(), strict=True)):
            if n:
                k = min(SHINGLE, n)
                s, first = np.unique(tv.grams(w.hash[a : a + n], k) ^ tv.U(k), return_index=True)
                self.at[i] = a + first
                self.classes.setdefault((k, len(s).bit_length() - 1), []).append((i, s))
        self.least = {key: [np.stack([_band(s, b).min() for b in range(bands)]) for _, s in ts] for key, ts in self.classes.items()}

    def find(self, w: tv.Words) -> list[tuple[int, int, int, int, int]]:
        """(text, template, shingles at the best place, first word, last word + 1) of each window that holds CONTAINED of a template."""
        out, data = [], np.concatenate([w.data, np.zeros(8, np.uint8)])
        first, counts = w.first, w.counts
        for k in sorted({k for k, _ in self.classes}):
            hashes, there = _shingles(w, k)
            kinds = sorted(c for size, c in self.classes if size == k)
            none = np.flatnonzero(~there)
            begins = {c: _begins(first, np.maximum(counts - k + 1, 0), 1 << c) for c in kinds}
            steps, same = {}, {}
            for c, finer in zip(kinds, [None, *kinds], strict=False):  # blocks are made of the next finer class's
                steps[c] = begins[c] if finer is None else np.searchsorted(begins[finer], begins[c])
                doc = w.doc[begins[c]]
                same[c] = [doc[far:] == doc[: max(len(doc) - far, 0)] for far in range(1, WIDE)]  # windows of blocks of the same text
            met: dict[int, set[tuple[int, int]]] = {c: set() for c in kinds}
            for b in range(self.bands if len(begins[kinds[0]]) else 0):
                block = _band(hashes, b)
                block[none] = ~tv.U(0)
                for c in kinds:
                    block = np.minimum.reduceat(block, steps[c])
                    window = block.copy()
                    for far, one in enumerate(same[c], 1):
                        np.minimum(window[: len(one)], block[far:], out=window[: len(one)], where=one)
                    for j, mins in enumerate(self.least[k, c]):
                        met[c].update((int(i), j) for i in np.flatnonzero(window == mins[b]))
            for c in kinds:
                for i, j in met[c]:
                    t, s = self.classes[k, c][j]
                    a = int(begins[c][i])
                    d = int(w.doc[a])
                    z = min(a + (WIDE << c), int(first[d] + counts[d]) - k + 1)
                    here = self._same(w, data, a, hashes[a:z], t, s, k)
                    todo = [here]
                    while todo:  # the best stretch, then what lies on both sides of it
                        here = todo.pop()
                        if len(here) < CONTAINED * len(s) or len(np.unique(hashes[a + here])) < CONTAINED * len(s):
                            continue
                        n, i, j = _tightest(hashes[a + here], here, self.most[t])
                        if n < CONTAINED * len(s):
                            continue
                        out.append((d, t, n, a + i - int(first[d]), a + j + k - int(first[d])))
                        todo += [here[here < i], here[here > j]]
        return out

    def _same(self, w: tv.Words, data: np.ndarray, a: int, hashes: np.ndarray, t: int, s: np.ndarray, k: int) -> np.ndarray:
        """The places from word a on whose shingles are the template's."""
        place = np.minimum(np.searchsorted(s, hashes), len(s) - 1)
        here = np.flatnonzero(s[place] == hashes)
        same, own = np.ones(len(here), bool), self.words
        for x in range(k):
            p, q = a + here + x, self.at[t][place[here]] + x
            same &= tv.same_spans(data, w.start[p], w.end[p], self.data, own.start[q], own.end[q], (True, True))
        return here[same]


def _tightest(hashes: np.ndarray, at: np.ndarray, most: int) -> tuple[int, int, int]:
    """The stretch of up to most places with the most distinct hashes, the shortest of these: their number, its first and last place."""
    _, kinds = np.unique(hashes, return_inverse=True)
    have, left, n, best = [0] * len(kinds), 0, 0, (0, 0, 0)
    kinds, places = kinds.tolist(), at.tolist()
    for right, kind in enumerate(kinds):
        n += not have[kind]
        have[kind] += 1
        while places[right] - places[left] >= most or have[kinds[left]] > 1:
            have[kinds[left]] -= 1
            n -= not have[kinds[left]]
            left += 1
        if (n, places[left] - places[right]) > (best[0], best[1] - best[2]):
            best = n, places[left], places[right]
    return best


def _begins(first: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """Where windows begin: every step shingles from each text's first on."""
    blocks = -(-n // step)
    return np.repeat(first - step * (np.cumsum(blocks) - blocks), blocks) + step * np.arange(blocks.sum())


@cache
def matcher(templates: tuple[tuple[str, str], ...], bands: int) -> Matcher:
    """One matcher a Python worker."""
    return Matcher(templates, bands)


_FOUND = pa.list_(pa.struct([("template", pa.int32()), ("shingles", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("kept", pa.bool_())]))


def _scanned(batch: pa.RecordBatch, templates: tuple[tuple[str, str], ...], bands: int) -> Iterator[pa.RecordBatch]:
    m = matcher(templates, bands)
    for part in pieces(batch, "text", SCAN_BYTES):
        rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
        for d, t, n, a, z in m.find(tv.words(column(part, "text"), tv.ALNUM)):
            rows[d].append({"template": t, "shingles": n, "start": a, "stop": z})
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([_judged(_occurrences(r), templates) for r in rows], _FOUND)], ["doc_id", "found"])


def _occurrences(found: list[dict]) -> list[dict]:
    """Each occurrence of a template once: of those that overlap the one of the most shingles, the shortest of these."""
    out: list[dict] = []
    for f in sorted(found, key=lambda f: (f["template"], f["start"], f["stop"])):
        if out and out[-1]["template"] == f["template"] and f["start"] < out[-1]["stop"]:
            if (f["shingles"], f["start"] - f["stop"]) > (out[-1]["shingles"], out[-1]["start"] - out[-1]["stop"]):
                out[-1] = f
        else:
            out.append(f)
    return out


def _judged(found: list[dict], templates: tuple[tuple[str, str], ...]) -> list[dict]:
    """found with kept: whether no match of another license over half of its place or more is the better one.

    The better one holds a larger share of its template's shingles, or with equal shares more of them. Occurrences of one
    template don't overlap, and one over half of a place holds its middle or what is next to it.
    """
    sizes = _sizes(templates)
    own: dict[int, list[dict]] = {}
    for f in found:
        own.setdefault(f["template"], []).append(f)
    starts = {t: [f["start"] for f in fs] for t, fs in own.items()}
    for f in found:
        f["kept"] = True
        for t, fs in own.items():
            if templates[t][0] == templates[f["template"]][0]:
                continue
            i = bisect_right(starts[t], (f["start"] + f["stop"]) // 2)
            for g in fs[max(i - 2, 0) : i + 1]:
                shared = min(f["stop"], g["stop"]) - max(f["start"], g["start"])
                ours, theirs = f["shingles"] * sizes[t], g["shingles"] * sizes[f["template"]]
                if 2 * shared >= f["stop"] - f["start"] and (theirs, g["shingles"]) > (ours, f["shingles"]):
                    f["kept"] = False
    return found


def scan_licenses(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, bands: int = BANDS) -> DataFrame:
    """doc_id, found for each row of documents (doc_id, text; other columns are ignored).

    found has, for each occurrence of a template (a stretch of up to 5/4 of it that holds a share CONTAINED of its
    shingles or more), the template's number, the distinct shingles found, the place in words (digits, letters and all
    beyond ASCII, A-Z lower-cased), and whether it is kept beside the other licenses found there. Null and empty texts find nothing; templates without words are left out. Rows come back
    one for one. Templates go to every worker; they are a parameter, not data.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), lambda b: _scanned(b, templates, bands), f"doc_id {kind}, found array<struct<template:int,shingles:int,start:int,stop:int,kept:boolean>>")


@cache
def _sizes(templates: tuple[tuple[str, str], ...]) -> list[int]:
    """The distinct shingles of each template."""
    sizes = dict.fromkeys(range(len(templates)), 1)
    for ts in Matcher(templates, 1).classes.values():
        sizes |= {i: len(s) for i, s in ts}
    return list(sizes.values())


def license_report(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, bands: int = BANDS) -> DataFrame:
    """doc_id, licenses (sorted, comma-joined), n_matches, first_word (of the first match, null without) of each row.

    Licenses word much alike: matches that give way to a better one of another license at their place don't count.
    """
    names = F.array(*(F.lit(name) for name, _ in templates))
    found = scan_licenses(documents, templates, bands).select("doc_id", F.filter("found", lambda f: f["kept"]).alias("found"))
    licenses = F.array_sort(F.array_distinct(F.transform("found", lambda f: F.get(names, f["template"]))))
    return found.select("doc_id", F.array_join(licenses, ",").alias("licenses"), F.size("found").cast("bigint").alias("n_matches"), F.array_min(F.transform("found", lambda f: f["start"])).cast("bigint").alias("first_word"))
