"""Op 8, quality rules: a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds the
measurements and one failure bit for each rule. Versioned policies are masks
over those bits, so a verdict, or what a rule alone rejects, is a bitwise
operation on the ledger and never reads a text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 8

#: Rules in the order of their bits: name and failing condition, as SQL over the measurements.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("many_digits", "100 * n_digits > 30 * word_chars"),
    ("few_letters", "100 * n_letters < 60 * word_chars"),
]
#: Policies by version: the rules that reject. ``base`` holds in all of them.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "few_letters"],
    "v2": ["few_words", "repeated_words", "symbols", "few_letters", "long_words", "short_words", "duplicate_lines", "many_digits"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_letters"]
_LETTER = str.isalpha


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a whole text; null counts as empty."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            marked = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    marked[j : j + WINDOW] = marked[i : i + WINDOW] = b"\1" * WINDOW
            repeated = sum(marked)
    digits = sum(map(text.count, "0123456789"))
    plain = text.encode()
    # Letters: all of ASCII by counting what is left after deletion, the rest one by one.
    ascii_letters = len(plain) - len(plain.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    other = 0 if text.isascii() else sum(map(_LETTER, _NOT_ASCII.findall(text)))
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), digits, ascii_letters + other


_NOT_ASCII = re.compile(r"[^\x00-\x7f]")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, one bit for each of RULES.

    ``docs`` has doc_id and text; other columns aren't used. Null text counts as
    empty, which fails few_words alone. Repeated rows and null ids stay as they
    are; texts of any length are measured whole; an empty table gives an empty
    result.
    """
    ship(docs.sparkSession)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measure(t) for t in batch["text"]], columns=MEASURES, dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object) if len(batch) else [])
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(cond), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, cond) in enumerate(RULES)), F.lit(0).cast("long"))
    return rows.withColumn("failed", bits)


def mask(rules: list[str]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def verdict(policy: str, failed: str = "failed") -> Column:
    """True where a policy keeps the document."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that it alone rejects."""
    held = mask(POLICIES[policy])
    hit = rows.select(F.col("failed").bitwiseAND(F.lit(held).cast("long")).alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if held >> i & 1])
    each = hit.select("hit", "n", F.explode(names).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"),
    )


def store(docs: DataFrame, path: str) -> DataFrame:
    """The ledger written to ``path`` and read back: texts are measured once, whatever policies are tried on it later."""
    ledger(docs).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def trials(rows: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """policy, rule, fails, alone for all of the policies, from the bits of one stored ledger; an empty ledger has no rows."""
    out = None
    for name in sorted(POLICIES) if policies is None else policies:
        own = ablations(rows, name).withColumn("policy", F.lit(name)).select("policy", "rule", "fails", "alone")
        out = own if out is None else out.unionByName(own)
    return out
