"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

A text's units are its lines, its paragraphs (parted by blank lines) and the whole. A unit is normalised (A-Z
lower-cased, everything but a-z, 0-9 one space) and gives its set of word bigrams; it is compared with a template
only if a coefficient of the threshold t is possible at their sizes, a unit's and b template's bigrams:
t/(2-t) <= a/b <= (2-t)/t. As a match shares at least t/(2-t) of the template's bigrams, it has one of the template's
probes, words that more than the others of its bigrams hold; a text without any template's probe has no units made.
Everything is a projection of the row: array functions alone, no shuffle.

Defined results: null and empty texts, and units of one word, match nothing; of equally close templates the first by
name wins; a unit that is both a line and a paragraph counts once, as equal units of a text do; texts are read
whole. Repeated rows get a row each; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, sorted."""
    words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))).split()
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and the largest number of bigrams with which a coefficient of the threshold is possible."""
    able = [a for a in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(a, n) >= threshold * (a + n)]
    return min(able), max(able)


def probes(own: list[str], threshold: float) -> set[str]:
    """Words, long ones first, one of which is in any unit that matches the template."""
    spare = len(own) * (2 - 2 * threshold) / (2 - threshold)
    chosen: set[str] = set()
    for word in sorted({w for x in own for w in x.split()}, key=lambda w: (-len(w), w)):
        if sum(not chosen.isdisjoint(x.split()) for x in own) > spare:
            break
        chosen.add(word)
    return chosen


def _plain(text: Column) -> Column:
    """Normalised but for its lines."""
    return F.regexp_replace(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9\n]+", " ")


def _units(plain: Column) -> Column:
    """The distinct normalised units of two words or more."""
    clean = lambda u: F.trim(F.regexp_replace(u, "[ \n]+", " "))
    units = F.concat(F.split(plain, "\n"), F.split(plain, "\n *\n"), F.array(plain))
    return F.filter(F.array_distinct(F.transform(units, clean)), lambda u: F.contains(u, F.lit(" ")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document the number of units that match, the closest template, its coefficient, and all that match."""
    known = [(name, bigrams(text)) for name, text in sorted(templates.items())]
    known = [(name, own, *size_bounds(len(own), threshold)) for name, own in known if own]

    def best(unit: Column) -> Column:
        words = F.split(unit, " ")
        own = F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

        def compare(pairs: Column) -> Column:
            n = F.size(pairs)
            dice = [F.when(n.between(lo, hi), F.struct((2.0 * F.size(F.array_intersect(pairs, F.array(*map(F.lit, t)))) / (n + len(t))).alias("dice"), F.lit(-k).alias("k"))) for k, (_, t, lo, hi) in enumerate(known)]
            return F.array_max(F.array(*dice))

        return F.element_at(F.transform(F.array(own), compare), 1)

    none = F.array().cast("array<struct<dice:double,k:int>>")
    wanted = sorted(set().union(*(probes(own, threshold) for _, own, *_ in known)))
    units = docs.select(F.col(id_col).alias("doc_id"), _plain(F.col(text_col)).alias("plain"))
    # The probes are looked up in the words of the row; a null text has none.
    able = F.coalesce(F.arrays_overlap(F.split(F.translate("plain", "\n", " "), " "), F.array(*map(F.lit, wanted))), F.lit(False)) if known else F.lit(False)
    matches = F.when(able, F.filter(F.transform(_units(F.col("plain")), best), lambda m: m["dice"] >= threshold)).otherwise(none) if known else none
    names = F.array(*(F.lit(name) for name, *_ in known)) if known else F.array().cast("array<string>")
    # Evaluated once for each row: the matches are made elements of an array, which Catalyst doesn't copy into what follows.
    top = F.array_max("matches")
    return units.select("doc_id", F.explode(F.array(matches)).alias("matches")).select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.get(names, -top["k"]).alias("license"),
        F.round(top["dice"], 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.get(names, -m["k"])))), ",").alias("licenses"),
    )
