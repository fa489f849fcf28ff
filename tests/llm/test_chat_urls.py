import hashlib
import json
import random
import re

from moorage.llm import chat, url_rules


def test_layouts_are_mapped_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "completion": "yo"},
        {"instruction": "hi", "input": "", "output": "yo"},
        {"instruction": "hi", "input": "there", "output": "yo"},
        {"question": "hi", "answer": "yo"},
        {"something": 1},
    ]
    rows = spark.createDataFrame([(i, json.dumps(r), "clash") for i, r in enumerate(records)] + [(90, None, ""), (91, "{", "")], "id int, record string, layout string")
    out = {r.id: r for r in chat.canonical_turns(rows).collect()}
    plain = [("user", "hi"), ("assistant", "yo")]
    for i in (0, 1, 2, 3, 5):
        assert [tuple(t) for t in out[i].turns] == plain, i
    assert [tuple(t) for t in out[4].turns] == [("user", "hi\n\nthere"), ("assistant", "yo")]
    assert out[3].layout == out[4].layout == "instruction_input_output"
    assert all(out[i].layout is None and out[i].turns is None for i in (6, 90, 91)) and len(out) == 9


def test_records_of_many_shapes_through_one_call(spark):
    """Further fields, nested ones, quotes and colons inside texts, escapes, numbers, an empty list, and the records of a table of turns."""
    tricky = 'say "a": \\ "b", {"role": "x"}\n'
    shapes = [
        ({"id": 3, "source": {"role": "a", "deep": [1, {"b": None}]}, "messages": [{"role": "user", "content": tricky, "name": "n"}, {"role": "assistant", "content": "yo"}]}, "messages", [("user", tricky), ("assistant", "yo")]),
        ({"messages": []}, "messages", []),
        ({"messages": [], "prompt": "p", "response": "r"}, "messages", []),
        ({"meta": {"x": 1}, "prompt": "p", "response": "r: \"q\""}, "prompt_response", [("user", "p"), ("assistant", "r: \"q\"")]),
        ({"system": "s", "prompt": "p", "response": "r", "n": 1.5}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": "c" * 3_000_000}, "prompt_completion", [("user", "p"), ("assistant", "c" * 3_000_000)]),
        ({"other": {"prompt": "p", "completion": "c"}}, None, None),
        ({"messages": {"role": "user", "content": "c"}}, None, None),
        ({"messages": ["role", "content"]}, None, None),
        ("messages", None, None),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r), 1, 2) for i, (r, _, _) in enumerate(shapes)], "id int, record string, skeleton int, lines int")
    table = spark.createDataFrame([(90, 0, "user", tricky, 0, 0), (90, 1, None, None, 0, 0)], "conv_id int, turn int, role string, text string, skeleton int, lines int")
    made = chat.records_of_turns(table).select(chat.F.col("conv_id").alias("id"), "record", chat.F.lit(1).alias("skeleton"), chat.F.lit(2).alias("lines"))
    told = chat.format_turns(chat.canonical_turns(rows.unionByName(made)))
    out = {r.id: r for r in told.collect()}
    for i, (_, layout, turns) in enumerate(shapes):
        assert out[i].layout == layout and (out[i].turns if turns is None else [tuple(t) for t in out[i].turns]) == turns, i
        assert (out[i].formatted is None) == (turns is None)
    assert [tuple(t) for t in out[90].turns] == [("user", tricky), ("", "")] and out[90].layout == "turns"
    assert all((r.skeleton, r.lines) == (1, 2) for r in out.values())
    assert set(chat.canonical_turns(rows, prefix="my_").columns) == {*rows.columns, "my_fingerprint", "my_layout", "my_turns"}
    back = chat.digest_formatted(told.where("formatted IS NOT NULL"), "id").collect()
    assert {r.id: r.n_turns for r in back} == {i: len(t) for i, (_, _, t) in enumerate(shapes) if t is not None} | {90: 2}


def test_formatted_reads_back(spark):
    rng = random.Random(1)
    bits = ["\\", "#", "### ", "</turn>", "\n", "<", "a", "é", "𝄞", ": ", "\\\\", "### Assistant: ", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "a:b#", None]), "".join(rng.choices(bits, k=rng.randint(0, 12))) if rng.random() < 0.9 else None, "x") for c in [*range(40), None] for t in range(rng.randint(1, 6))]
    rows += [(7, 1, "assistant", "same", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_turns(chat.canonical_turns(chat.records_of_turns(df)))
    got = {r.conv_id: r for r in chat.digest_formatted(made).collect()}
    assert set(got) == {*range(40), None}
    for r in made.collect():
        lines = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id)
        loss = "".join(x for _, role, x in lines if role == "assistant")
        assert got[r.conv_id].n_turns == len(lines)
        assert got[r.conv_id].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in lines).encode()).hexdigest()
        assert (got[r.conv_id].loss_chars, got[r.conv_id].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[r.conv_id].formatted_chars == len(r.formatted)
    assert chat.format_turns(chat.canonical_turns(chat.records_of_turns(df.limit(0)))).count() == 0


def slow(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    won = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, won and won[0] + won[1], won[2] if won else "allow"


def test_urls(spark):
    rng = random.Random(2)
    urls = [None, "", "example.com/en/", "http://", "https://Example.COM/en/x?y#z", "a://www.example.com/en/", "http://x.net/es", "http://x.net/es/", "http://notexample.com/en/1", "http://com", "http://com/", "x://y://example.com/en/", "http://example.com:80/en/", "http://a.net#/es/", "http://a.net?/es/", "http://" + "l." * 3000 + "com/" + "s/" * 3000]
    hosts, paths = ["com", "example.com", "www.example.com", "net", "a.net", "org", "b.org"], ["/", "/en/", "/es/", "/en/x", "/e", "", "/en/xy/z"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(paths)}" for _ in range(200)]
    other = [(rng.choice(hosts), rng.choice(paths) or "/", rng.choice(["allow", "block"])) for _ in range(25)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    for rules in (url_rules.RULES, other):
        for part in (10_000, 30):
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, rules, part_chars=part).collect()}
            assert got == {i: slow(u, rules) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(df.limit(0)).count() == 0
