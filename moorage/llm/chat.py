"""Op 5, chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's fingerprint is the hash of its nested field paths, without values
and scalar types. A registry of declarative mappings is keyed by fingerprint;
records of known layouts, whatever their shape, become an array of (role, text)
turns. A record with further fields has a fingerprint of its own; it gets the
mapping whose paths it holds. The turns are then written in one template whose
control strings are escaped inside texts, so that a formatted conversation
reads back exactly, and a loss mask marks the assistant's texts.

Tables with one row a turn are made records first (``records_of_turns``) and go
the same way.

Only DataFrame expressions: field paths come from ``schema_of_variant`` of the
record without its texts, so that a record of any size has a fingerprint.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh

#: Template. In an escaped text each backslash, # and < follows a backslash of its own, so neither string can occur in one.
HEAD, HEAD_END, TURN_END = "### ", ": ", "\n</turn>\n"

#: Declarative mappings. Form: the nested field paths as schema_of_variant prints them, without scalar types.
#: ``list``: field of the list, field of the role, field of the text, role names to replace.
#: ``fields``: for each turn its role and the fields whose texts are joined by a blank line; a turn without text is left out.
#: Of the mappings whose paths a record of another form holds, the first counts.
LAYOUTS: dict[str, dict] = {
    "messages": {"form": "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "list": ("messages", "role", "content", {})},
    "from_value": {"form": "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "list": ("conversations", "from", "value", {"human": "user", "gpt": "assistant"})},
    "turns": {"form": "OBJECT<turns: ARRAY<OBJECT<role, text>>>", "list": ("turns", "role", "text", {})},
    "system_prompt_response": {"form": "OBJECT<prompt, response, system>", "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt_completion": {"form": "OBJECT<completion, prompt>", "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"form": "OBJECT<prompt, response>", "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction_input_output": {"form": "OBJECT<input, instruction, output>", "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction_output": {"form": "OBJECT<instruction, output>", "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "question_answer": {"form": "OBJECT<answer, question>", "fields": [("user", ["question"]), ("assistant", ["answer"])]},
}
SCALARS = r": (?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+,\d+\))"
#: A string; group 1 is its inside if it is a key.
STRING = r'"(?:((?:[^"\\]++|\\.)*+)"(?=\s*+:)|(?:[^"\\]++|\\.)*+")'


def digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()[:16]


def skeleton(record: Column) -> Column:
    """A JSON record as variant, its texts emptied: they have no paths, and variants have a largest size; null where it isn't JSON."""
    return F.try_parse_json(F.regexp_replace(record, STRING, '"$1"'))


def fingerprint(bones: Column) -> Column:
    """Hash of a skeleton's nested field paths."""
    return F.substring(F.sha2(F.regexp_replace(F.schema_of_variant(bones), SCALARS, ""), 256), 1, 16)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _mapped(record: Column, layout: dict) -> Column:
    """The turns of a JSON record of this layout."""
    if "list" in layout:
        items, role, text, names = layout["list"]
        parsed = F.from_json(record, f"`{items}` array<struct<`{role}`:string,`{text}`:string>>")[items]

        def turn(m: Column) -> Column:
            said = _text(m[role])
            for old, new in names.items():
                said = F.when(m[role] == old, F.lit(new)).otherwise(said)
            return F.struct(said.alias("role"), _text(m[text]).alias("text"))

        return F.transform(parsed, turn)
    keys = [k for _, fields in layout["fields"] for k in fields]
    parsed = F.from_json(record, ", ".join(f"`{k}` string" for k in keys))
    turns = []
    for role, fields in layout["fields"]:
        given = F.filter(F.array(*[parsed[k] for k in fields]), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0)
        turns.append(F.struct(F.lit(role).alias("role"), F.array_join(given, "\n\n").alias("text")))
    return F.filter(F.array(*turns), lambda t: F.length(t["text"]) > 0)


def _holds(bones: Column, layout: dict) -> Column:
    """Whether a skeleton has the paths of a mapping, and maybe more. An empty list may be one of anything."""
    if "list" not in layout:
        keys = F.map_keys(F.try_variant_get(bones, "$", "map<string,variant>"))
        return F.size(F.array_except(F.array(*[F.lit(k) for _, fields in layout["fields"] for k in fields]), keys)) == 0
    items, role, text, _ = layout["list"]
    elements = F.try_variant_get(bones, f"$.{items}", "array<map<string,variant>>")
    keys = F.flatten(F.transform(elements, F.map_keys))
    return (F.size(elements) == 0) | (F.array_contains(keys, role) & F.array_contains(keys, text))


def canonical_turns(records: DataFrame, record: str = "record", layouts: dict[str, dict] = LAYOUTS, prefix: str = "") -> DataFrame:
    """``records`` with fingerprint, layout and turns, from a column of JSON texts of any size.

    A record of a known fingerprint has its mapping; one with further fields
    the first mapping whose paths it holds. A record of an unknown layout, null,
    or not JSON keeps its row, with null layout and turns; an empty list gives
    no turns. Null roles and texts become empty. Repeated rows stay; an empty
    table gives an empty result. Columns of the outputs' names are replaced;
    ``prefix`` gives the outputs other names.
    """
    bones = fresh(records, "skeleton")[0]
    mark, chosen, turns_name = f"{prefix}fingerprint", f"{prefix}layout", f"{prefix}turns"
    by_paths = F.lit(None).cast("string")
    for name, spec in reversed(layouts.items()):
        by_paths = F.when(_holds(F.col(bones), spec), F.lit(name)).otherwise(by_paths)
    exact = F.lit(None).cast("string")
    for name, spec in layouts.items():
        exact = F.when(F.col(mark) == digest(spec["form"]), F.lit(name)).otherwise(exact)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, spec in layouts.items():
        turns = F.when(F.col(chosen) == name, _mapped(F.col(record), spec)).otherwise(turns)
    seen = records.withColumn(bones, skeleton(F.col(record))).withColumn(mark, fingerprint(F.col(bones)))
    return seen.withColumn(chosen, F.coalesce(exact, by_paths)).withColumn(turns_name, turns).drop(bones)


def records_of_turns(rows: DataFrame) -> DataFrame:
    """conv_id, record: a table with one row a turn (conv_id, turn, role, text) as JSON records of the layout ``turns``.

    Rows of a conversation are ordered by turn (nulls first), then role and
    text; null roles and texts are empty; repeated rows count each. Rows without
    conv_id form one conversation with a null id. Other columns may have any
    name and aren't used. A conversation is one record, so it lies in one task.
    """
    line = F.struct("turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("turns"))
    return listed.select("conv_id", F.to_json(F.struct(F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))).alias("record"))


def escape(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{also}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conversations`` (with turns) with formatted and loss_spans; columns of these names are replaced, all others stay.

    loss_spans are [start, end) in code points of ``formatted``, one for each
    turn of the role assistant. No turns give an empty string; null turns null.
    Texts of any length are written whole.
    """
    held = fresh(conversations, "lines")[0]
    lines = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(HEAD), escape(t["role"], ":"), F.lit(HEAD_END)).alias("head"), escape(t["text"]).alias("body")))
    written = conversations.withColumn(held, lines)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(TURN_END)).cast("long").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return written.withColumns({
        "formatted": F.array_join(F.transform(held, lambda x: F.concat(x["head"], x["body"], F.lit(TURN_END))), ""),
        "loss_spans": F.aggregate(held, start, step, lambda acc: acc["spans"]),
    }).drop(held)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"\n</turn>\n", -1), lambda x: F.length(x) > 0)
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(pieces, lambda x: F.struct(unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest_formatted(formatted: DataFrame, key: str = "conv_id", also: tuple[str, ...] = ()) -> DataFrame:
    """What the formatted strings hold, read back from them, and columns of ``also``."""
    back = formatted.select(key, *also, "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        *also,
    )
