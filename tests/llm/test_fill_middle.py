import hashlib
import re

import pytest
from pyspark.sql import functions as F

from moorage.llm import fill_middle

SCHEMA = "doc_id long, text string, body string, n_units string, CUTS int"


def drawn(doc_id):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def plain(doc_id, text, unit):
    text = text or ""
    units = re.findall(unit, text, re.S)
    n, (h1, h2, h3, h4) = len(units), drawn(doc_id)
    if not n or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, "a", "ab\ncd", "é😀ü\r\n x", "has <P> mark", "<", "<S", "x<M", "word " * 300, "😀a" * 900, "  lead and\ttail  ", "é" * 40, "y" * 257, "z" * 4096]


@pytest.mark.parametrize("unit", [".", r"\s*[^\s]+"])
def test_parts_equal_a_plain_version(spark, unit):
    rows = [(i * 100 + j, t) for i in range(8) for j, t in enumerate(TEXTS)] + [(None, "no id here"), (None, "nor here"), (5, "again"), (5, "again"), (5, "other text")]
    docs = spark.createDataFrame([(d, t, "x", "y", 3) for d, t in rows], SCHEMA)
    made = fill_middle.transform(docs, unit=unit)
    assert made.columns == [*docs.columns, "fim"]
    got = sorted(str((r.doc_id, r.text, *r.fim)) for r in made.collect())
    whole = "." if unit == "." else rf"(?:{unit}|.)"
    assert got == sorted(str((d, t, *plain(d, t, whole))) for d, t in rows)
    back = made.select("text", fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_every_unit_can_be_cut_at(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 3 else "ab"[i % 2] for i in range(700))
    rows = [(i, text, {"here": i}) for i in range(0, 701)]
    got = {r.k: r.cuts for r in fill_middle.cut_offsets(spark.createDataFrame(rows, "k long, text string, wanted map<string, long>"), ["k"]).collect()}
    assert got == {i: {"here": i} for i in range(1, 701)}


def test_long_texts_and_no_rows(spark):
    text = "long text " * 500_000
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    for r in fill_middle.transform(docs).select("doc_id", "fim.*").collect():
        assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == plain(r.doc_id, text, ".")
    assert fill_middle.transform(docs.limit(0)).collect() == []
