"""License scans: the Dice coefficient of word bigrams between licence templates and passages.

Text and templates are normalised to lower-case words of letters and digits. A passage of a
text is compared with a template by ``2 * shared / (bigrams of the passage + bigrams of the
template)`` over multisets of bigrams. A coefficient of ``t`` or more bounds the sizes: a passage has between
``t / (2 - t)`` and ``(2 - t) / t`` times the template's bigrams, and must share at least half
of ``t`` times both together. Templates without enough shared bigrams in a text are pruned before
any passage is looked at, and passages start and end at shared bigrams, since trimming others only
raises the coefficient. Overlapping passages of one template are reported once, the best first.

Templates are a parameter, a small stated set; one pass over whole texts, no shuffle.

Defined results: null and empty texts hold no licence; templates of fewer than two words are
rejected; repeated rows are reported each; of equal coefficients the earlier passage counts;
columns of any name may be present.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

LEAST = 0.8

# The notices by which these licences ask to be named, as published.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause line": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT line": "Released under the MIT License.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@dataclass
class Compared:
    """Templates as bigram multisets, and which templates hold a bigram."""

    names: list[str]
    counts: list[dict[int, int]]
    sizes: list[int]
    grams: np.ndarray
    holders: dict[int, list[int]]

    @staticmethod
    def of(templates: dict[str, str]) -> Compared:
        names, counts, holders = sorted(templates), [], {}
        for k, name in enumerate(names):
            hashes, _ = kernel.words(*kernel.text_bytes(pa.array([templates[name]])), kernel.PLAIN)
            if len(hashes) < 2:
                raise ValueError(f"template {name} has fewer than two words")
            uniq, n = np.unique(kernel.combine(hashes, 2), return_counts=True)
            counts.append(dict(zip(uniq.tolist(), n.tolist())))
            for g in uniq.tolist():
                holders.setdefault(g, []).append(k)
        return Compared(names, counts, [sum(c.values()) for c in counts], np.array(sorted(holders), np.uint64), holders)


def passages(places: np.ndarray, grams: list[int], counts: dict[int, int], size: int, least: float) -> list[tuple[float, int, int]]:
    """``(coefficient, first bigram, last bigram)`` of the best passages of one text.

    ``places`` and ``grams``: the text's bigrams that the template holds. Passages do not overlap.
    """
    longest = int(size * (2 - least) / least + 1e-9)
    found = []
    for i, start in enumerate(places.tolist()):
        left, shared = counts.copy(), 0
        for j in range(i, len(grams)):
            long = int(places[j]) - start + 1
            if long > longest:
                break
            if left[grams[j]]:
                left[grams[j]] -= 1
                shared += 1
            dice = 2 * shared / (long + size)
            if dice >= least - 1e-12:
                found.append((dice, start, int(places[j])))
    found.sort(key=lambda f: (-f[0], f[1], f[2]))
    chosen: list[tuple[float, int, int]] = []
    taken: set[int] = set()
    for f in found:
        if taken.isdisjoint(range(f[1], f[2] + 1)):
            taken.update(range(f[1], f[2] + 1))
            chosen.append(f)
    return sorted(chosen, key=lambda f: f[1])


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``id, license, dice, first_word, last_word`` of every matching passage of every row."""
    compared = Compared.of(templates)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row, data, offsets in kernel.doc_slices(batch, "t"):
                hashes, at = kernel.words(data, offsets, kernel.PLAIN)
                grams = kernel.combine(hashes, 2)
                at_most = max(len(compared.grams) - 1, 0)
                near = np.minimum(np.searchsorted(compared.grams, grams), at_most)
                place = np.flatnonzero(compared.grams[near] == grams)
                doc = np.searchsorted(at, place, "right") - 1
                place = place[place + 2 <= at[doc + 1]]
                doc = np.searchsorted(at, place, "right") - 1
                rows = []
                for a, b in _runs(doc):
                    own, offset = place[a:b], int(at[doc[a]])
                    by_template: dict[int, list[int]] = {}
                    for p in own.tolist():
                        for k in compared.holders[int(grams[p])]:
                            by_template.setdefault(k, []).append(p)
                    for k, hits in sorted(by_template.items()):
                        # a passage shares at most this much, and is at least as long as what it shares
                        size = compared.sizes[k]
                        if 2 * len(hits) < least * (size + min(len(hits), size)) - 1e-9:
                            continue
                        for dice, first, last in passages(np.array(hits), [int(grams[p]) for p in hits], compared.counts[k], size, least):
                            rows.append((row + int(doc[a]), compared.names[k], dice, first - offset, last + 1 - offset))
                r, name, dice, first, last = zip(*rows) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r, pa.int64())), pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["id", "license", "dice", "first_word", "last_word"])

    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("t"))
    return slim.mapInArrow(run, f"id {kind}, license string, dice double, first_word bigint, last_word bigint").withColumnRenamed("id", id)


def _runs(values: np.ndarray):
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)])
