"""Op 2, license scans: Dice coefficient over word bigrams against templates.

A text's pieces are its paragraphs (lines joined), the sentences of these, and
its lines, so that a header is found in one line, wrapped over several, or
inside a longer paragraph. Pieces are normalised to words of lower-case letters
and digits; equal pieces of a text count once. The number of a piece's distinct
bigrams prunes the templates: the sizes that a template admits are written out
as rows, so the size bound is an equi-join against a table of fixed size.

Before texts are cut, those that cannot hold any piece are passed over: a piece
that reaches the threshold has a known part of its template's bigrams, so the
text contains at least one of a few words or word pairs that every such part
must touch (``anchors``). This changes no result.

Only DataFrame expressions.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.75
#: Sentences by which licences are declared, and the paragraphs of their headers and texts.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "You may not use this file except in compliance with the License.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Words and pairs that tell a licence from its neighbours. A piece is compared with templates only that have the same of them as it has.
TELLING = (
    "affero", "lesser", "library general", "noncommercial", "sharealike", "noderivatives", "by nc", "by sa", "by nd", "nc sa", "nc nd",
    "version 1", "version 2", "version 3", "version 4", "2 1", "bsd 2", "bsd 3", "v 1", "v 2", "not licensed", "not released", "not covered", "not available", "not distributed", "not under",
)
#: Names that count only where a text has no other one: they stand in the headers of other licences too.
WEAK_NAMES = ("proprietary",)


def tagged(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """The templates with the line that names each in a machine-readable header."""
    out = {}
    for name, sentences in templates.items():
        tags = [] if name in WEAK_NAMES else [name] + [f"{name}-{more}" for more in ("only", "or-later") if "GPL-" in name]
        out[name] = [*sentences, *(f"SPDX-License-Identifier: {tag}" for tag in tags)]
    return out


TEMPLATES = tagged(TEMPLATES)


def load_templates(path: str) -> dict[str, list[str]]:
    """A catalogue from a JSON file, {licence: [sentence or paragraph]}; it may have any number of them."""
    with open(path, encoding="utf-8") as f:
        return tagged(json.load(f))


#: Lines without a letter or digit part paragraphs; sentences end before white space.
PARAGRAPH, SENTENCE = r"\n[^A-Za-z0-9]*\n", r"[.!?]+[ \t\r\n]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that a single word needs to be an anchor; shorter ones are in too many texts.
LONG_WORD = 7


def bigrams(sentence: str) -> list[str]:
    """A sentence's distinct word bigrams, in order; a single word stands for itself."""
    words = re.findall(r"[a-z0-9]+", sentence.translate(str.maketrans(UPPER, LOWER)))
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return list(dict.fromkeys(pairs))


def telling(sentence: str) -> list[str]:
    """The TELLING words and pairs that a sentence has, in their order."""
    words = " ".join(re.findall(r"[a-z0-9]+", sentence.translate(str.maketrans(UPPER, LOWER))))
    return [x for x in TELLING if f" {x} " in f" {words} "]


def least_common(own: int, threshold: float) -> int:
    """The fewest of a template's bigrams that a piece must have: 2 c / (own + size) >= threshold, where size >= c."""
    return max(1, math.ceil(own * threshold / (2 - threshold) - 1e-9))


def template_rows(templates: dict[str, list[str]], threshold: float) -> list[tuple[int, str, list[tuple[str, list[str], int]]]]:
    """(size, what tells, templates that admit these as (license, bigrams, their number)): 2 min / (a + b) >= threshold bounds the sizes."""
    rows: dict[tuple[int, str], list] = {}
    for name, sentences in templates.items():
        for sentence in sentences:
            own = bigrams(sentence)
            for size in range(least_common(len(own), threshold), math.floor(len(own) * (2 - threshold) / threshold + 1e-9) + 1):
                rows.setdefault((size, ",".join(telling(sentence))), []).append((name, own, len(own)))
    return [(size, told, known) for (size, told), known in sorted(rows.items())]


def anchors(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Long words and word pairs of which any piece that reaches the threshold has at least one.

    A piece lacks at most own - least_common bigrams of its template, so it is
    enough if more than those hold an anchor. Greedily, those that help most
    templates most; pairs of short words come last.
    """
    need = []
    for sentences in templates.values():
        for sentence in sentences:
            own = bigrams(sentence)
            need.append([set(own), len(own) - least_common(len(own), threshold) + 1])
    chosen: list[str] = []
    while any(left > 0 for _, left in need):
        gains: dict[str, int] = {}
        for own, left in need:
            if left > 0:
                each: dict[str, int] = {}
                for pair in own:
                    for anchor in {pair, *(w for w in pair.split() if len(w) >= LONG_WORD)}:
                        each[anchor] = each.get(anchor, 0) + 1
                for anchor, n in each.items():
                    gains[anchor] = gains.get(anchor, 0) + min(n, left)
        best = max(gains, key=lambda a: (any(len(w) >= LONG_WORD for w in a.split()), gains[a], len(a), a))
        chosen.append(best)
        for x in need:
            hit = {p for p in x[0] if p == best or best in p.split()}
            x[0], x[1] = x[0] - hit, x[1] - len(hit)
    return chosen


def _plain(text: Column) -> Column:
    """Words of lower-case letters and digits, with a blank on either side of each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "), F.lit(" "))


def _pairs(words: Column) -> Column:
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    both = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), rest, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, both).otherwise(words))


def anchored(words: list[str]) -> str:
    """A pattern that finds any of the words and pairs, whatever stands between the words of a pair."""
    between = "[^A-Za-z0-9]+"
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words):
        by_letter.setdefault(w[0], []).append(w[1:].replace(" ", between))
    heads = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return f"(?i)(?<![A-Za-z0-9])(?:{heads})(?![A-Za-z0-9])"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The licences found in whole texts: doc_id, license, dice (of its best piece), n_pieces.

    ``docs`` has doc_id and text; other columns may have any name and aren't
    used. Null or empty texts find nothing; texts and pieces of any length are
    compared whole; an empty table gives an empty result. Rows of one doc_id
    are taken together, repeated rows counting each; a null id is an id like any
    other. A piece counts for the licence whose template it is most like, for
    each of them in a tie. Templates whose telling words (TELLING) the piece
    doesn't have, or that lack one that it has, aren't compared with it, so a
    licence isn't taken for its neighbour; WEAK_NAMES are left out where the
    documents of an id have another licence. The work is linear in the text.
    """
    # At most as many rows as the templates' sizes admit, whatever the input.
    sizes = F.broadcast(docs.sparkSession.createDataFrame(template_rows(templates, threshold), "size int, told string, known array<struct<license:string,own:array<string>,n_own:int>>"))
    marks = anchored(anchors(templates, threshold))
    likely = docs.select("doc_id", "text").where(F.col("text").rlike(marks))
    paragraphs = F.split("text", PARAGRAPH)
    cut = F.concat(F.split("text", "\n"), paragraphs, F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE))))
    # Step by step inside the row: each lambda's argument is worked out once.
    pieces = F.array_distinct(F.transform(F.filter(cut, lambda p: p.rlike(marks)), lambda p: F.trim(_plain(p))))
    told = F.array_join(F.filter(F.array(*[F.lit(x) for x in TELLING]), lambda x: F.concat(F.lit(" "), F.col("piece"), F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" ")))), ",")
    each = likely.select("doc_id", F.explode(pieces).alias("piece"))
    sized = each.select("doc_id", told.alias("told"), _pairs(F.split("piece", " ")).alias("pairs")).withColumn("size", F.size("pairs"))
    dice = lambda k: 2.0 * F.size(F.array_intersect(F.col("pairs"), k["own"])) / (F.col("size") + k["n_own"])
    scored = sized.join(sizes, ["size", "told"]).select("doc_id", F.transform("known", lambda k: F.struct(dice(k).alias("dice"), k["license"].alias("license"))).alias("scored"))
    best = scored.withColumn("best", F.array_max("scored")["dice"]).where(F.col("best") >= threshold)
    names = F.array_distinct(F.transform(F.filter("scored", lambda s: s["dice"] == F.col("best")), lambda s: s["license"]))
    hits = best.select("doc_id", "best", F.explode(names).alias("license"))
    found = hits.groupBy("doc_id", "license").agg(F.round(F.max("best"), 6).alias("dice"), F.count("*").alias("n_pieces"))
    # As many rows of an id as there are licences, at most.
    by_id = found.groupBy("doc_id").agg(F.collect_list(F.struct("license", "dice", "n_pieces")).alias("all"))
    strong = F.filter("all", lambda x: ~x["license"].isin(*WEAK_NAMES))
    return by_id.select("doc_id", F.inline(F.when(F.size(strong) > 0, strong).otherwise(F.col("all"))))
