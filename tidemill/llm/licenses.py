"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a template anchor the alignment; the longest increasing
subsequence of the anchors is kept, and the gaps between them are aligned the same way after their common
beginnings and ends are matched.  Coverage is the share of the template's words that the alignment matches.

Stretches are found by a template's keywords, its words that few other texts hold.  Of a notice each keyword occurrence fixes
where the template would lie; of a license's body, where many keywords agree on a place.  The stretch around it is
aligned three times: as it stands, reduced to the template's own words, and so with as many words more on either side
as the template has.  A notice may thus hold foreign words at any number of places, up to ``gap`` of them (or four times the
template's length) at each; at a wider gap it ends.  Words of the license's identifier that stand in a notice, as in "MIT" or
"version 3", must be among those matched.  Every occurrence in the whole text is tried.

Edge cases: null, empty and wordless texts match nothing; where stretches overlap, the one with more matched
words stays (then the greater coverage, the one of the tighter stretch, the earlier, the first by name), so a notice counts for the most
specific license; repeated rows are each reported; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public notices, by the identifier of their license.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
#: Words too common in any text to find a template by.
COMMON = frozenset("a an and any are as at by copy except file following for form free from in is it may modification not obtain of on or person provided public published source subject terms that the this to under use version with without work you v all be but can do even if into its large list made make must name such these they we will 0 1 2 3 4".split())
WORD = re.compile(r"[^\W_]+")
LEAST, SLACK = 0.8, 4
#: Foreign words that a notice may hold at one place, if its template is short.
GAP = 64
#: Templates of so many words are bodies: found by the votes of many keywords.
BODY = 60


def templates_of(folder: str | Path) -> dict[str, list[str]]:
    """License texts of a folder: each ``.txt`` file, or file without a suffix of letters, under its name."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file() and (p.suffix == ".txt" or not p.suffix[1:].isalpha()))
    return {p.name.removesuffix(".txt"): [p.read_text("utf-8")] for p in files}


def all_templates() -> dict[str, list[str]]:
    """The notices above and the bodies that come with the package."""
    bodies = templates_of(Path(__file__).parent / "license_texts")
    return {name: TEMPLATES.get(name, []) + bodies.get(name, []) for name in [*TEMPLATES, *(n for n in bodies if n not in TEMPLATES)]}


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: index pairs of equal words, increasing in both.

    Works from a stack of gaps rather than by recursion, so long texts do not nest.
    """
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        lo, hi, left, right = gaps.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            out.append((lo, left))
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            out.append((hi, right))
        if lo >= hi or left >= right:
            continue
        once_a, once_b = Counter(a[lo:hi]), Counter(b[left:right])
        place = {w: j for j, w in enumerate(b[left:right], left) if once_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[lo:hi], lo) if once_a[w] == 1 and w in place]
        if not anchors:
            continue
        chain = increasing(anchors)
        out += chain
        edges = [(lo - 1, left - 1), *chain, (hi, right)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in its second members."""
    tops, at, back = [], [], [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back[n] = at[k - 1] if k else -1
        tops[k : k + 1], at[k : k + 1] = [j], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], gap: int = GAP):
        self.templates = [(name, words) for name, texts in templates.items() for t in texts if (words := WORD.findall(t.lower()))]
        self.gap, self.vocabulary = gap, [frozenset(words) for _, words in self.templates]
        self.every = frozenset().union(*self.vocabulary)
        #: words that an alignment must match
        self.named = [frozenset(WORD.findall(name.lower())) & held if len(words) < BODY else frozenset() for (name, words), held in zip(self.templates, self.vocabulary, strict=True)]
        spread = Counter(w for held in self.vocabulary for w in held)
        self.keys: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.votes = []  # that a body needs
        for k, (_, words) in enumerate(self.templates):
            rare = sorted({w for w in words if w not in COMMON} or set(words), key=lambda w: (spread[w], -len(w), w))
            # an alignment of enough coverage holds one of any words that make up more of the template than it may miss
            missed = int(len(words) * (1 - LEAST))
            times, chosen, held = Counter(words), [], 0
            for w in rare:
                if held >= (max(2, missed + 1) if len(words) < BODY else 2 * missed):
                    break
                chosen.append(w)
                held += times[w]
            self.votes.append(max(1, held - missed))
            for w in chosen:
                self.keys[w] += [(k, i) for i, x in enumerate(words) if x == w]

    def candidates(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, first place, place after the last) of the stretches that may hold it."""
        single: dict[tuple[int, int], None] = {}
        voted: dict[int, Counter] = defaultdict(Counter)
        for p, w in enumerate(words):
            for k, offset in self.keys.get(w, ()):
                n = len(self.templates[k][1])
                if n < BODY:
                    single[k, p - offset] = None
                else:
                    voted[k][(p - offset) // n] += 1
        out = [(k, start, start + len(self.templates[k][1])) for k, start in single]
        for k, own in voted.items():
            n = len(self.templates[k][1])
            # insertions before a keyword move its vote on, by less than a template's length within one place of the grid
            out += [(k, b * n, (b + 3) * n) for b in sorted({c - d for c in own for d in (0, 1)}) if own[b] + own[b + 1] >= self.votes[k]]
        return out

    def reduced(self, k: int, lo: int, hi: int, where: dict[str, list[int]], slack: int) -> list[int]:
        """Places of the template's words about a stretch, out to ``slack`` such words or the first wide gap."""
        held = where.get(k)
        if held is None:
            held = where[k] = sorted(p for w in self.vocabulary[k] for p in where.get(w, ()))
        a, b = bisect_left(held, lo), bisect_left(held, hi)
        wide = max(self.gap, 4 * len(self.templates[k][1])) + 1
        left, right = max(0, a - slack), min(len(held), b + slack)
        mid = (a + b) // 2
        first = next((i for i in range(min(mid, len(held) - 1), left, -1) if held[i] - held[i - 1] > wide), left)
        last = next((i for i in range(max(mid, first + 1), right) if held[i] - held[i - 1] > wide), right)
        return held[first:last]

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """Matches of a whole text: (license, start, end, coverage), in code points."""
        text = text or ""
        if self.keys.keys().isdisjoint(WORD.findall(text.lower())):
            return []
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        where: dict = defaultdict(list)
        for p, w in enumerate(words):
            if w in self.every:
                where[w].append(p)
        where.default_factory = None
        found = []
        for k, start, end in self.candidates(words):
            name, template = self.templates[k]
            stretches = (
                # the tight stretch tells close notices apart, the others hold what was put into a notice
                lambda: list(range(max(0, start - SLACK), min(len(words), end + SLACK))),  # noqa: B023
                lambda: self.reduced(k, start, end, where, SLACK),  # noqa: B023
                lambda: self.reduced(k, start, end, where, max(SLACK, len(template))),  # noqa: B023
            )
            for nth, stretch in enumerate(stretches):
                at = stretch()
                pairs = align([words[p] for p in at], template)
                coverage = len(pairs) / len(template)
                if coverage >= LEAST and self.named[k] <= {template[j] for _, j in pairs}:
                    found.append((-len(pairs), -coverage, nth, at[pairs[0][0]], at[pairs[-1][0]], name))
                if coverage == 1:
                    break
        taken: list[tuple[int, int]] = []
        out = []
        for _, less, _, a, b, name in sorted(found):
            i = bisect_left(taken, (a, b))
            if (i == 0 or taken[i - 1][1] < a) and (i == len(taken) or taken[i][0] > b):
                taken.insert(i, (a, b))
                out.append((name, places[a][0], places[b][1], -less))
        return sorted(out, key=lambda m: m[1])


MATCHES = "array<struct<license: string, start: int, end: int, coverage: double>>"


def _scan(templates: dict[str, list[str]], gap: int):
    match = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("matches", pa.list_(match))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, gap)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [[dict(zip(("license", "start", "end", "coverage"), m, strict=True)) for m in scanner.scan(t.as_py())] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    return run


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] | None = None, gap: int = GAP) -> DataFrame:
    """``documents`` (doc_id, text): the license notices of each row as ``matches``.

    ``templates`` (by default ``all_templates()``) maps a license's identifier to texts; ``templates_of`` reads them from
    a folder.  ``gap`` is the number of foreign words that a notice may hold at one place.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(templates or all_templates(), gap), f"doc_id long, matches {MATCHES}")
