import re

from moorage.llm import pii


def test_terms_of_rare_entities_are_judged_in_whole_documents(spark):
    far = " ".join(f"plain{chr(97 + k % 26)} common words of all" for k in range(30))
    twice = f"Dear Quuxley, {far} write to q@corp.example soon. {far} Yours, quuxley"
    once = f"Vantrop said: {far} {'x' * 900} call 10.1.2.3 about it; {far} Vantrop"
    rows = [(1, twice), (2, twice + " again"), (3, once)] + [(10 + k, f"{far} write call about soon again dear yours said it {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in pii.scan(df).collect()}
    cut = lambda d: [dict(rows)[d][int(a) : int(b)].lower() for a, b in re.findall(r"term:(\d+):(\d+)", got[d])]
    assert cut(1) == ["quuxley", "quuxley"] and cut(2) == ["quuxley", "quuxley"]
    assert cut(3) == ["vantrop", "x" * 900, "vantrop"]
    assert not cut(10)
    for part in (100_000, 0):
        clean = {r.doc_id: r.text for r in pii.sanitise(df, part=part).collect()}
        assert not re.search("quuxley|q@corp", clean[1], re.I) and not re.search("vantrop|10.1.2.3", clean[3], re.I)
        assert clean[10] == dict(rows)[10] and far in clean[1]


def plain_terms(rows):
    """(row number, term) -> whether it is removed, by counting."""
    n = len(rows)
    terms, held = [], []
    for _, text in rows:
        spans = pii.base_spans(text)
        held.append({pii.entity(text, k, a, b) for a, k, b in spans})
        terms.append({t for t, _, _ in pii.terms_outside(text or "", spans)})
    df, e, j = {}, {}, {}
    for (_, text), names in zip(rows, held):
        for t in {t.lower() for t in pii._TERM.findall(text or "")}:
            df[t] = df.get(t, 0) + 1
        for name in names:
            e[name] = e.get(name, 0) + 1
    for own, names in zip(terms, held):
        for name in names:
            for t in own:
                j[name, t] = j.get((name, t), 0) + 1
    out = {}
    for i, (own, names) in enumerate(zip(terms, held)):
        for name in names:
            for t in own:
                x, y = df[t], e[name]
                bond = ((j[name, t] + y / n) / (x + 1) * (j[name, t] + x / n) / (y + 1)) ** 0.5
                if bond >= pii.GENERALISE and y < n:
                    out[i, t] = out.get((i, t), False) or bond >= pii.REMOVE
    return out


def test_terms_equal_plain_counts(spark):
    import random

    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    entities = [f"user{i}@mail.example" for i in range(30)] + [f"10.0.0.{i}" for i in range(10)]
    rows = []
    for i in range(150):
        said = rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randint(0, 40))
        for name in rng.choices(range(40), [3] * 10 + [1] * 30, k=rng.choice((0, 0, 0, 1, 3))):
            said += [entities[name]] + [f"owner{chr(97 + name % 26)}{chr(97 + name // 26)}"] * (rng.random() < 0.95)
        rng.shuffle(said)
        rows.append((i, " ".join(said)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 150, 4)] + [(900, None), (None, "call 10.0.0.3 wordonce"), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_terms(rows)
    assert len(set(want.values())) == 2
    told = {r.doc_id: r.spans for r in pii.scan(df).collect()}
    for i, (d, text) in enumerate(rows):
        got = {text[int(a) : int(b)].lower() for a, b in re.findall(r"term:(\d+):(\d+)", told[d])}
        assert got == {t for (k, t) in want if k == i}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean == {r.doc_id: r.text for r in pii.sanitise(df, part=0).collect()}
    for i, (d, text) in enumerate(rows):
        assert clean[d] == pii.sanitise_text(text, {t: x for (k, t), x in want.items() if k == i})


def test_common_prose_stays(spark):
    prose = "the river runs past the old mill and the garden wall in autumn light"
    rows = [(i, f"{prose} part {'abcdefgh'[i % 8] * 3}") for i in range(400)]
    rows[7] = (7, f"{prose} write to one@only.example today Zanthor")
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[7] == f"{prose} [NAME] to [EMAIL] [TERM] [NAME]".replace("[NAME] to", "[TERM] to")


def test_long_runs_and_many_entities_take_linear_time(spark):
    import time

    began = time.time()
    digits = "7" * 10_000_000
    assert pii.base_spans(digits) == [] and pii.base_spans("1." * 1_000_000) and pii.base_spans("1.2.3." + digits) == []
    assert pii.base_spans("+1" + "-" * 3_000_000) == [] and pii.base_spans("a" * 3_000_000 + "@" * 1000) == []
    assert time.time() - began < 30
    many = " ".join(f"user{i}@mail{i}.example word{chr(97 + i % 26)}{i}x" for i in range(20_000))
    rows = [(1, many), (2, "user5@mail5.example other"), (3, "nothing here")]
    began = time.time()
    got = {r.doc_id: (r.n_email, r.spans.count("term:")) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (20_000, 20_000) and got[2][0] == 1
    assert time.time() - began < 120
