import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.functions import lit

from moorage.llm import decontaminate, license_scan, pii, toxicity

DOCS = "doc_id long, text string, item_id string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], DOCS)


ODD = [(None, "no id here"), (None, None), (1, ""), (2, None), (3, "é" * 40_000)]


def slow_base(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_are_the_patterns():
    rng = random.Random(6)
    bits = ["a@b.c", "@", "x@y", "a.b%@c-d.e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (255) 555-8013", "+1", " ", ".", "é", "-", "7", "+", "\n", "a@b..c@d.e"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        assert pii.base_spans(text) == slow_base(text), text


def test_pii_scan(spark):
    near = "Contact Zorblax at zed@corp.example now please"
    rows = ODD + [(10 + i, f"{near} filler{chr(97 + i)} words") for i in range(4)] + [(50 + i, f"common words please now at {i} contact") for i in range(60)]
    rows += [(10, f"{near} filler{chr(97)} words")]
    got = pii.scan(docs(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    text_of = dict(rows)
    for r in got:
        base = slow_base(text_of.get(r.doc_id)) if r.doc_id is not None else []
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.n_email == sum(k == 0 for _, k, _ in base)
        terms = re.findall(r"term:(\d+):(\d+)", r.spans)
        if r.doc_id is not None and 10 <= r.doc_id < 20:
            assert [text_of[r.doc_id][int(a) : int(b)] for a, b in terms] == ["Zorblax"]
        else:
            assert not terms
    clean = {r.doc_id: r for r in pii.sanitise(docs(spark, rows)).collect()}
    assert clean[11].text == "Contact  at [EMAIL] now please fillerb words" and clean[11].row == "x" and clean[55].text == text_of[55] and clean[2].text is None
    by_join = {(r.doc_id, r.text) for r in pii.sanitise(docs(spark, rows), part=0).collect()}
    assert by_join == {(r.doc_id, r.text) for r in pii.sanitise(docs(spark, rows)).collect()}
    assert pii.scan(docs(spark, [])).count() == 0


def test_masks_find_two_substitutions_anywhere():
    n = decontaminate.NEED
    for changed in itertools.combinations(range(n), 2):
        assert any(not {p + o for o in m} & set(changed) for m in decontaminate.MASKS for p in range(n - m[-1]))


def slow_overlap(words, item):
    best = 0
    for shift in range(-len(item), len(words)):
        lo, hi = max(0, shift), min(len(words), shift + len(item))
        equal = np.array([words[k] == item[k - shift] for k in range(lo, hi)], dtype=bool)
        if len(equal):
            best = max(best, decontaminate.best_stretch(equal)[0])
    return bool(item) and best >= min(decontaminate.NEED, len(item))


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 20, 12, 5, 3, 2, 0, 1])] + [(8, None), (0, None)]
    items.append(items[0])
    rows = list(ODD)
    for k in range(60):
        own, item = [word() for _ in range(rng.randint(0, 60))], (items[(0, 1, 2, 3, 4, 5, 7)[k % 7]][1]).split()
        kind = k % 4
        if kind == 1:
            item = [w if rng.random() > 0.12 else word() for w in item]
        if kind == 2:
            item = item[: len(item) // 2]
        rows.append((100 + k, " ".join(own[:20] + (item if kind < 3 else []) + own[20:]).upper() + "."))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for part in (10**6, 60):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs(spark, rows), bench, part).collect()}
        want = {(d, i) for d, t in rows for i, x in items if x is not None and slow_overlap(decontaminate.words_of(t), decontaminate.words_of(x))}
        assert got == want
    kept = {r.doc_id for r in decontaminate.drop_overlapping(docs(spark, rows), bench).collect()}
    found = {r.doc_id for r in decontaminate.find_overlaps(docs(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - found
    assert decontaminate.find_overlaps(docs(spark, []), bench).count() == 0
    assert decontaminate.find_overlaps(docs(spark, rows), bench.limit(0)).count() == 0


def slow_licences(rows):
    """(doc_id, license) -> (dice, pieces): every distinct piece of a text against every template with the same telling words."""

    def pairs(text):
        return set(license_scan.bigrams(text))

    def marks(text):
        words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))
        return {x for n in (1, 2) for i in range(len(words)) for x in [" ".join(words[i : i + n])] if x in license_scan.TELLING}

    known = [(name, pairs(s), marks(s)) for name, sentences in license_scan.TEMPLATES.items() for s in sentences]
    best, count = {}, Counter()
    for d, text in rows:
        paragraphs = re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+", text or "")
        cut = (text or "").split("\n") + paragraphs + [s for p in paragraphs for s in re.split(r"[.!?]+[ \t\r\n]+", p)]
        for piece in {" ".join(re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in p))) for p in cut} - {""}:
            own = pairs(piece)
            scores = {}
            for name, other, told in known:
                if told != marks(piece):
                    continue
                scores[name] = max(scores.get(name, 0), 2 * len(own & other) / (len(own) + len(other)))
            top = max(scores.values(), default=0)
            for name in scores if top >= license_scan.THRESHOLD else ():
                if scores[name] == top:
                    best[d, name] = max(best.get((d, name), 0), round(top, 6))
                    count[d, name] += 1
    strong = {d for d, name in best if name not in license_scan.WEAK_NAMES}
    return {k: (best[k], count[k]) for k in best if k[1] not in license_scan.WEAK_NAMES or k[0] not in strong}


def test_licences(spark):
    grant, header, gpl = license_scan.TEMPLATES["MIT"][3], license_scan.TEMPLATES["Apache-2.0"][4], license_scan.TEMPLATES["GPL-3.0"][2]
    wrapped = lambda t: "\n".join("# " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    rows = ODD + [
        (10, "Intro.\nReleased under the MIT License.\nText"), (11, "Text. This work is licensed under the GNU General Public License, version 3. More"), (12, "all RIGHTS reserved!"), (13, "rights"), (14, "Licensed under the Apache License, Version 2.0, mostly."), (10, "Released under the  MIT license"),
        (20, "Released under the MIT License " * 40), (21, "code code\n\nReleased under\nthe MIT License. More code"), (22, f"Copyright 2020\n#\n{wrapped(grant)}\n#\n{wrapped(license_scan.TEMPLATES['MIT'][4])}\n"), (23, wrapped(header)), (24, gpl), (25, gpl.replace("version 3", "version 2")), (26, f"{'word ' * 3000}. {gpl} {'word ' * 3000}"),
        (27, " ".join(license_scan.TEMPLATES["BSD"])), (28, grant.upper() + "\n\n" + grant), (None, "Licensed under CC BY-NC 4.0."), (29, "İ Licensed under CC BY 4.0. K"),
    ]
    rng = random.Random(4)
    for k in range(60):  # templates with words changed, around the threshold
        words = rng.choice([s for x in license_scan.TEMPLATES.values() for s in x]).split()
        rows.append((100 + k, " ".join(w if rng.random() > 0.15 else rng.choice(["x", "any", ""]) for w in words)))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, pairs string, size int")
    got = {(r.doc_id, r.license): (r.dice, r.n_pieces) for r in license_scan.scan(df).collect()}
    assert got == slow_licences(rows)
    found = {d: {name for e, name in got if e == d} for d, _ in rows}
    assert found[20] == found[21] == found[22] == {"MIT"} and found[23] == {"Apache-2.0"} and found[24] == found[26] == {"GPL-3.0"} and found[25] == {"GPL-2.0"} and "BSD" in found[27]
    assert not found[13] and got[22, "MIT"][1] == 2 and got[10, "MIT"][1] == 3  # the line twice, and its paragraph
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_licences_are_not_taken_for_their_neighbours(spark, tmp_path):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    bsd = license_scan.TEMPLATES["BSD"]
    cases = [
        (gnu.format("Affero ", 3), {"AGPL-3.0"}), (gnu.format("Lesser ", 3), {"LGPL-3.0"}), (gnu.format("Lesser ", "2.1").replace("program", "library").replace(":", ";"), {"LGPL-2.1"}), (gnu.format("", 3), {"GPL-3.0"}), (gnu.format("", 2), {"GPL-2.0"}),
        ("Licensed under the GNU Affero General Public License, version 3.", {"AGPL-3.0"}), ("Licensed under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1"}), ("Licensed under the GNU General Public License, version 1.", set()),
        ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}), ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}), ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}), ("Licensed under CC BY-ND 4.0.", {"CC-BY-ND-4.0"}), ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"CC-BY-NC-SA-4.0"}),
        ("Not licensed under the MIT License.", set()), ("Licensed under the MIT License.", {"MIT"}), ("Released under the BSD 2-Clause License.", {"BSD-2-Clause"}), ("Released under the BSD 3-Clause License.", {"BSD-3-Clause"}),
        ("Copyright (c) 2020, Someone. All rights reserved.\n\n" + "\n\n".join(bsd), {"BSD"}), ("Copyright 2020. All rights reserved.", {"proprietary"}),
        ("# SPDX-License-Identifier: MIT", {"MIT"}), ("// SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}), ("SPDX-License-Identifier: LGPL-3.0-or-later", {"LGPL-3.0"}), ("SPDX-License-Identifier: AGPL-3.0-or-later", {"AGPL-3.0"}), ("SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}), ("SPDX-License-Identifier: None", set()),
    ]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    got = {}
    for r in license_scan.scan(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert [(t, got.get(i, set())) for i, (t, _) in enumerate(cases)] == cases
    path = tmp_path / "own.json"
    path.write_text('{"House-1.0": ["You may share this text with your neighbours if you name its source."]}')
    own = license_scan.load_templates(str(path))
    rows = [(1, "Note.\nYou may share this text with your neighbours if you name the source."), (2, "SPDX-License-Identifier: House-1.0"), (3, "Licensed under the MIT License.")]
    assert {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), own).collect()} == {(1, "House-1.0"), (2, "House-1.0")}


def test_long_runs_of_marks_end_no_worker(spark):
    rows = [(i, f"before\n{mark * 1_000_000}\nReleased under the MIT License.") for i, mark in enumerate(["\n", " \n", ".", "-", "|", " ", "\t", "#", "a", "1", "가", "é"])]
    got = {r.doc_id for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(len(rows)))


def test_fold():
    assert toxicity.fold("1D10T! Ídïот") == " idiot  idiot "
    assert toxicity.fold(None) == "  "


def slow_hits(text, lexicon, exceptions):
    """Every pattern at every place of the text's words, without places inside exception phrases."""
    plain = " ".join(["", *toxicity.fold(text).split(), ""])
    inside = {i for x in exceptions for i in range(len(plain)) if plain.startswith(f" {x} ", i) for i in range(i, i + len(x) + 1)}
    total = sum(w for p, w in lexicon for i in range(len(plain)) if plain.startswith(p, i) and i not in inside)
    return total / (1 + math.log(1 + len(plain.split()) / toxicity.LENGTH))


def test_matcher_is_the_plain_search():
    rng = random.Random(2)
    bits = ["trash", "TR4SH", "can", "trashy", "ash", "tr", "as", ".", ", ", "scum", "é", "skimmer", "sсum", "bin"]
    lexicon = [(" tras", 3.0), (" ash ", 1.5), (" scum ", 2.0), (" scu", 0.5), (" bin", 1.0)]
    for exceptions in (toxicity.EXCEPTIONS, (), ("trash can", "can trash", "ash tr")):
        m = toxicity.Matcher(lexicon, exceptions)
        for _ in range(400):
            text = " ".join(rng.choices(bits, k=rng.randint(0, 12)))
            assert m.hits(toxicity.fold(text)) == pytest.approx(slow_hits(text, lexicon, exceptions)), text


def test_exception_phrases_and_length():
    m = toxicity.Matcher([(" tras", 3.0)])
    assert m.hits(toxicity.fold("a trash, can")) == 0.0
    sums = [m.hits(toxicity.fold("trash " + "word " * n)) for n in (0, 10, 100, 900, 1100, 20_000, 200_000)]
    assert all(a > b > 0 for a, b in zip(sums, sums[1:]))


def test_exceptions_are_learned(spark):
    rng = random.Random(5)
    filler = ["".join(rng.choices("acefgmnoprt", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        words, toxic = rng.choices(filler, k=25), int(i % 3 == 0)
        at = rng.randrange(20)
        if toxic:
            words[at] = "blorg"
        elif i % 9 == 1:
            words[at : at + 2] = ["blorg", "flower"]
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), known)
    assert "blorg flower" in model["exceptions"] and set(toxicity.EXCEPTIONS) <= set(model["exceptions"])
    told = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, rows), model).collect()}
    assert all(told[i] == t for i, t in labels)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(12)
    plain = ["".join(rng.choices("abcdeflmnoprstu", k=rng.randint(2, 7))) for _ in range(300)]
    bad = ["blorgous", "wexxify", "zutterly"]
    rows, labels = list(ODD), [(1, 0), (None, 1), (999999, 1), (2, None)]
    for i in range(1000, 1600):
        words, toxic = rng.choices(plain, k=40), int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad).upper()
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    df = docs(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    told = dict(labels)
    a, b = model["curve"]
    text_of = dict(rows)
    for r in toxicity.score(df, model).collect():  # the curve over the plain search, refitted by another way
        if r.doc_id is not None:
            assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * slow_hits(text_of[r.doc_id], model["lexicon"], model["exceptions"])))))
    x = np.array([slow_hits(text_of[d], model["lexicon"], model["exceptions"]) for d, _ in labels if d is not None and d >= 1000 and zlib.crc32(str(d).encode()) % 4 != 2 and d in text_of])
    y = np.array([t for d, t in labels if d is not None and d >= 1000 and zlib.crc32(str(d).encode()) % 4 != 2 and d in text_of])
    loss = lambda a, b: -(y * (a + b * x) - np.log1p(np.exp(a + b * x))).sum() + 0.5e-3 * (len(y) + 1) * b * b
    assert all(loss(a, b) <= loss(a + da, b + db) + 0.05 for da in (-0.2, 0, 0.2) for db in (-0.2, 0, 0.2))
    clash = toxicity.score(df.withColumn("score", lit("mine")).withColumn("predicted", lit(9)), model, prefix="tox_").first()
    assert clash.score == "mine" and clash.predicted == 9 and 0 <= clash.tox_score <= 1
    for r in toxicity.score(df, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id >= 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            assert r.predicted == told[r.doc_id]
    assert toxicity.fit(df, known.limit(0))["lexicon"] == []
    assert toxicity.score(docs(spark, []), model).count() == 0
