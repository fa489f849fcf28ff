"""Hangul syllables and typing errors (N11-N15), as Column expressions.

The weighted edit distance is a dynamic program by ``aggregate``, row by row,
so pairs are compared in the JVM. ``distance`` is the same in plain Python, for
the letter trie and the tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, keyboard and confusions that results depend on.
CHO = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
JUNG = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
JONG = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
KEY_ROWS = ["ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔ", "ㅁㄴㅇㄹㅎㅗㅓㅏㅣ", "ㅋㅌㅊㅍㅠㅜㅡ"]
KEY_COLUMNS = "ㅂㅁ ㅈㄴ ㄷㅇ ㄱㄹ ㅅㅎ ㅛㅗ ㅕㅓ ㅑㅏ ㅐㅣ ㅁㅋ ㄴㅌ ㅇㅊ ㄹㅍ ㅗㅠ ㅓㅜ ㅏㅡ".split()
SHIFTED = "ㄱㄲ ㄷㄸ ㅂㅃ ㅅㅆ ㅈㅉ ㅐㅒ ㅔㅖ ㅑㅒ ㅕㅖ".split()
CONFUSED = "ㅐㅔ ㅒㅖ ㅚㅙ ㅚㅞ ㅙㅞ ㅢㅣ ㅢㅔ ㅕㅓ ㅑㅏ".split()
FIRST = 0xAC00
CONFUSED_COST, NEXT_KEY_COST = 0.25, 0.4

NEIGHBOURS = {frozenset(p) for p in [row[i : i + 2] for row in KEY_ROWS for i in range(len(row) - 1)] + KEY_COLUMNS + SHIFTED}
CONFUSIONS = {frozenset(p) for p in CONFUSED}
LETTERS = sorted(set(CHO + JUNG) | set(JONG) - {""})


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_hangul(char: Column) -> Column:
    return char.rlike("^[가-힣]$")


def _index(char: Column) -> Column:
    return F.ascii(char) - FIRST


def _at(values: list[str], i: Column) -> Column:
    return F.get(_literal(values), i.cast("int"))


def decompose(text: Column) -> Column:
    """Syllables as their letters; other characters as they are."""
    i = _index
    letters = F.transform(
        F.split(text, ""),
        lambda c: F.when(is_hangul(c), F.concat(_at(list(CHO), F.floor(i(c) / 588)), _at(list(JUNG), F.floor(F.pmod(i(c), F.lit(588)) / 28)), _at(JONG, F.pmod(i(c), F.lit(28))))).otherwise(c),
    )
    return F.array_join(letters, "")


def syllable(cho: Column, jung: Column, jong: Column) -> Column:
    """The syllable of three positions in the letter lists; null if one is null."""
    code = (cho * 21 + jung) * 28 + jong + FIRST
    # UTF-8 of a code point from U+AC00 on: three bytes.
    high, mid, low = F.floor(code / 4096) + 224, F.pmod(F.floor(code / 64), F.lit(64)) + 128, F.pmod(code, F.lit(64)) + 128
    return F.decode(F.unhex(F.concat(F.hex(high.cast("long")), F.hex(mid.cast("long")), F.hex(low.cast("long")))), "UTF-8")


def compose(cho: Column, jung: Column, jong: Column) -> Column:
    """The syllable of three letters (the last may be empty); null if one isn't a letter of its place."""

    def where(values: list[str], letter: Column) -> Column:
        at = F.array_position(_literal(values), letter)
        return F.when(at > 0, at - 1)

    return syllable(where(list(CHO), cho), where(list(JUNG), jung), where(JONG, jong))


def jamo_cost(a: str, b: str) -> float:
    """What it costs to take one letter for another."""
    if a == b:
        return 0.0
    pair = frozenset((a, b))
    return CONFUSED_COST if pair in CONFUSIONS else NEXT_KEY_COST if pair in NEIGHBOURS else 1.0


_CHEAP = {(a, b): jamo_cost(a, b) for a in LETTERS for b in LETTERS if a != b and jamo_cost(a, b) < 1}


def letters_of(text: str) -> str:
    out = []
    for c in text:
        i = ord(c) - FIRST
        out.append(CHO[i // 588] + JUNG[i % 588 // 28] + JONG[i % 28] if 0 <= i < 11172 else c)
    return "".join(out)


def distance(x: str, y: str, cap: float) -> float:
    """Weighted edit distance of two letter sequences, cap + 1 once it must exceed cap."""
    if x == y:
        return 0.0
    if abs(len(x) - len(y)) > cap:
        return cap + 1
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            swap = diagonal if a == b else diagonal + _CHEAP.get((a, b), 1.0)
            diagonal = row[j]
            row[j] = min(row[j] + 1, row[j - 1] + 1, swap)
        if min(row) > cap:
            return cap + 1
    return float(row[-1])


def pair_similarity(a: str, b: str) -> float:
    x, y = letters_of(a), letters_of(b)
    longest = max(len(x), len(y))
    return max(0.0, 1 - distance(x, y, longest) / longest) if longest else 1.0


def _classes() -> tuple[str, str]:
    """Letters that may be confused, and the first letter of the class that each belongs to."""
    groups: list[set[str]] = []
    for pair in map(set, CONFUSED):
        met = [g for g in groups if g & pair]
        groups = [g for g in groups if not g & pair] + [pair.union(*met)]
    pairs = [(c, min(g)) for g in groups for c in sorted(g) if c != min(g)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_CONFUSED_FROM, _CONFUSED_TO = _classes()


def letter_classes(text: Column) -> Column:
    """The letters of a text, those that may be confused as one."""
    return F.translate(decompose(text), _CONFUSED_FROM, _CONFUSED_TO)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether texts of these letter classes can be as similar as the threshold: each step between classes costs NEXT_KEY_COST at least. JVM-side, and never wrong."""
    return F.levenshtein(a, b) * NEXT_KEY_COST <= F.greatest(F.length(a), F.length(b)) * F.lit(1 - threshold) + 1e-9


def cheap_pairs() -> dict[tuple[str, str], float]:
    """Pairs of letters that cost less than 1 to take for each other."""
    return _CHEAP


def _pairs_of(cost: float) -> str:
    """The pairs of that cost as one text, blanks between them."""
    return " ".join(a + b for (a, b), c in sorted(_CHEAP.items()) if c == cost)


def _swap_cost(a: Column, b: Column) -> Column:
    pair = F.concat(a, b)
    return F.when(a == b, 0.0).when(F.lit(_pairs_of(CONFUSED_COST)).contains(pair), CONFUSED_COST).when(F.lit(_pairs_of(NEXT_KEY_COST)).contains(pair), NEXT_KEY_COST).otherwise(1.0)


def _last_row(x: Column, y: Column, cap: Column) -> Column:
    """row, over of two arrays of letters: the last row of distances, and whether one row was above the cap altogether."""
    places = F.when(F.size(y) > 0, F.sequence(F.lit(1), F.size(y))).otherwise(F.array().cast("array<int>"))

    def next_row(acc: Column, letter: Column) -> Column:
        above = acc["row"]

        def cell(row: Column, j: Column) -> Column:
            swap = F.element_at(above, j) + _swap_cost(letter, F.element_at(y, j))
            return F.concat(row, F.array(F.least(F.element_at(above, j + 1) + 1, F.element_at(row, -1) + 1, swap)))

        return F.aggregate(places, F.array(F.element_at(above, 1) + 1), cell, lambda row: F.struct(row.alias("row"), (acc["over"] | (F.array_min(row) > cap)).alias("over")))

    first = F.transform(F.concat(F.array(F.lit(0)), places), lambda i: i.cast("double"))
    return F.aggregate(x, F.struct(first.alias("row"), F.lit(False).alias("over")), next_row)


def _letters(text: Column) -> Column:
    return F.filter(F.split(decompose(text), ""), lambda c: c != "")


def _distance(a: Column, b: Column, x: Column, y: Column, cap: Column) -> Column:
    """``distance`` of two texts whose letters are x and y."""
    # Of an array of one, so that the rows are worked out once for both of their parts.
    told = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"), cap.cast("double").alias("cap"))), lambda p: F.struct(p["cap"].alias("cap"), _last_row(p["x"], p["y"], p["cap"]).alias("r"), F.abs(F.size(p["x"]) - F.size(p["y"])).alias("gap")))
    value = F.transform(told, lambda t: F.when((t["gap"] > t["cap"]) | t["r"]["over"], t["cap"] + 1).otherwise(F.element_at(t["r"]["row"], -1)))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 0.0).otherwise(F.element_at(value, 1))


def weighted_distance(a: Column, b: Column, cap: float = 6) -> Column:
    """The distance of two texts' letters, cap + 1 once it must exceed the cap; null if one is null."""
    return _distance(a, b, _letters(a), _letters(b), F.lit(cap))


def similarity(a: Column, b: Column) -> Column:
    """1 less the distance for each letter of the longer text; 1 for two empty ones, null if one is null."""
    x, y = _letters(a), _letters(b)
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - _distance(a, b, x, y, longest) / longest))


def _replacements() -> dict[str, list[list[str]]]:
    """What each vowel may be mistaken for, in the order of the confusions; each initial's neighbouring initials, sorted."""
    vowels = [[(set(p) - {v}).pop() for p in CONFUSED if v in p] for v in JUNG]
    initials = [sorted(o for o in CHO if frozenset((c, o)) in NEIGHBOURS and c != o) for c in CHO]
    return {"vowels": [[str(JUNG.index(o)) for o in row] for row in vowels], "initials": [[str(CHO.index(o)) for o in row] for row in initials]}


_REPLACE = _replacements()


def typo_variants(word: Column, limit: int = 6) -> Column:
    """Likely typing errors of a word, in the order of its syllables: confused vowels, a dropped final, neighbouring initials.

    Syllables are taken until three times ``limit`` are found; of the distinct
    ones the first ``limit`` stay.
    """
    vowels = F.array(*[_literal(row).cast("array<int>") if row else F.array().cast("array<int>") for row in _REPLACE["vowels"]])
    initials = F.array(*[_literal(row).cast("array<int>") if row else F.array().cast("array<int>") for row in _REPLACE["initials"]])

    def errors(char: Column, at: Column) -> Column:
        i = _index(char)
        cho, jung, jong = F.floor(i / 588).cast("int"), F.floor(F.pmod(i, F.lit(588)) / 28).cast("int"), F.pmod(i, F.lit(28)).cast("int")
        by_vowel = F.transform(F.get(vowels, jung), lambda v: syllable(cho, v, jong))
        by_final = F.when(jong > 0, F.array(syllable(cho, jung, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        by_key = F.transform(F.get(initials, cho), lambda c: syllable(c, jung, jong))
        made = F.concat(by_vowel, by_final, by_key)
        return F.when(is_hangul(char), F.transform(made, lambda s: F.concat(F.substring(word, F.lit(1), at), s, F.substring(word, at + 2, F.length(word))))).otherwise(F.array().cast("array<string>"))

    each = F.transform(F.split(word, ""), errors)
    empty = F.array().cast("array<string>")
    taken = F.aggregate(each, empty, lambda acc, more: F.when(F.size(acc) >= limit * 3, acc).otherwise(F.concat(acc, more)))
    return F.slice(F.array_distinct(F.filter(taken, lambda v: v != word)), 1, limit)
