"""Op 4, toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps case, accents, lookalike letters of other scripts and digits that
stand for letters to plain letters, and everything else to blanks. The lexicon
is learned: word beginnings and whole words whose share of toxic documents is
too high for chance, weighted by their log odds. Exception phrases are given,
and learned too: word pairs around an entry whose toxic share is far below the
word's own. A text's hits, without those inside exception phrases, are summed,
divided by a length that grows smoothly with the logarithm of the words, and
mapped to a probability by a logistic curve.

Labels are learned from a bounded sample of the training rows (``BOUND``), whose
classes count in the curve as often as they occur among all training rows; each
document is then scored whole, alike at every size of the input.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .workers import give_back

#: The most labelled rows that are learned from: toxic ones and others.
BOUND = (3_000, 9_000)
#: The most entries of the lexicon.
ENTRIES = 5_000
#: Counts that a worker gathers before it passes them on.
KEPT_FEATURES = 200_000
#: Lengths of the word beginnings that are tried.
STEMS = (4, 5, 6, 8)
THRESHOLD = 0.3
#: A sum of hits is divided by 1 + log(1 + words / LENGTH), at every length.
LENGTH = 1_000
#: The most exception phrases that are learned, and the fewest documents of one.
PHRASES, PHRASE_DOCS = 1_000, 5

#: Letters of other scripts and digits by the letter they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
#: Given exceptions, by parameter: harmless phrases around words that may be in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser rule", "scum skimmer")


class _Fold(dict):
    """A table for str.translate that fills itself."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            if not unicodedata.combining(c):
                c = LOOKALIKES.get(c, c)
                out += c if c.isalpha() else " "
        if unicodedata.category(chr(code)) in ("Mn", "Cf"):  # accents and invisible characters vanish
            out = ""
        self[code] = out
        return out


_FOLD = _Fold()
_ASCII = bytes(ord(_FOLD[i]) for i in range(128)) + bytes(range(128, 256))


def fold(text: str | None) -> str:
    """The folded text with a blank at both ends; null counts as empty."""
    text = text or ""
    body = text.encode().translate(_ASCII).decode() if text.isascii() else text.translate(_FOLD)
    return f" {body} "


def features(words: set[str]) -> Iterator[str]:
    """Beginnings (a blank, then letters) and whole words (with a blank after)."""
    for w in words:
        n = len(w)
        if n >= 3:
            yield f" {w} "
        for k in STEMS:
            if n >= k:
                yield f" {w[:k]}"


def training_rows(labels: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: crc32 of the id's text mod 4 isn't 2."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    return kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(labels: DataFrame, bound: tuple[int, int]) -> DataFrame:
    """At most ``bound`` rows of each class, by hash of the id."""
    rows = training_rows(labels)
    classes = [rows.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in zip((F.col("toxic") == 1, F.col("toxic") != 1), bound)]
    return classes[0].unionByName(classes[1])


def class_weights(labels: DataFrame, bound: tuple[int, int]) -> tuple[float, float]:
    """For how many training rows a row of the sample stands: a toxic one, another one."""
    toxic, other = training_rows(labels).agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    return toxic / max(1, min(toxic, bound[0])), other / max(1, min(other, bound[1]))


def counted_features(rows: DataFrame) -> DataFrame:
    """feature, documents with it, toxic ones among them; rows: text, toxic. Counts are summed before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out() -> pd.DataFrame:
            return pd.DataFrame([(k, a, b) for k, (a, b) in held.items()], columns=["feature", "n", "t"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for f in features(set(fold(text).split())):
                    at = held[f]
                    at[0] += 1
                    at[1] += toxic
                if len(held) > KEPT_FEATURES:
                    yield out()
                    held.clear()
        yield out()
        held.clear()
        give_back()

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(count, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES) -> list[tuple[str, float]]:
    """Patterns with weights, from labelled texts.

    A feature enters if the log likelihood ratio of its toxic share exceeds what
    chance gives the best of as many features of its length, and if no entered
    pattern covers it.
    """
    n, t = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not t or t == n:
        return []
    base = t / n
    counts = counted_features(rows).where("t >= 2")
    share = F.col("t") / F.col("n")
    gain = 2 * (F.col("t") * F.log(share / base) + F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    scored = counts.where(share > base).withColumns({"gain": gain, "kind": F.when(F.col("feature").endswith(" "), F.lit(0)).otherwise(F.length("feature") - 1)}).persist()
    tried = {r[0]: r[1] for r in scored.groupBy("kind").count().collect()}
    enough = F.lit(math.inf)
    for kind, many in tried.items():
        enough = F.when(F.col("kind") == kind, F.lit(2 * math.log(many) + 4)).otherwise(enough)
    best = scored.where(F.col("gain") >= enough).orderBy(F.desc("gain"), F.length("feature"), "feature").limit(entries).collect()
    scored.unpersist()
    lexicon: dict[str, float] = {}
    for r in best:
        stems = [r.feature[: k + 1] for k in STEMS if len(r.feature) > k]
        weight = math.log((r.t + 0.5) / (t + 1)) - math.log((r.n - r.t + 0.5) / (n - t + 1))
        if weight >= 1.5 and not any(s in lexicon for s in stems) and not any(p.startswith(r.feature) for p in lexicon):
            lexicon[r.feature] = weight
    return sorted(lexicon.items())


def _listed(word: str, lexicon: set[str]) -> bool:
    return f" {word} " in lexicon or any(f" {word[:k]}" in lexicon for k in STEMS if len(word) >= k)


def learn_exceptions(rows: DataFrame, lexicon: list[tuple[str, float]], most: int = PHRASES) -> list[str]:
    """Harmless phrases, from labelled texts: pairs of an entry's word and a neighbour.

    A pair enters if its toxic share is at most that of all texts, and so far
    below the word's own that the log likelihood ratio exceeds what chance gives
    the best of as many pairs.
    """
    n, t = rows.agg(F.count("*"), F.sum("toxic")).first()
    held = {p for p, _ in lexicon}

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = fold(text).split()
                seen = {(w, p) for i, w in enumerate(words) if _listed(w, held) for p in (None, " ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])) if p is None or " " in p}
                out += [(w, p, toxic) for w, p in seen]
            yield pd.DataFrame(out, columns=["word", "phrase", "toxic"])

    counts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(pairs, "word string, phrase string, toxic int").groupBy("word", "phrase").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    own = counts.where("phrase IS NULL").select("word", (F.col("t") / F.col("n")).alias("share"))
    tried = counts.where(F.col("phrase").isNotNull() & (F.col("n") >= PHRASE_DOCS))
    found = tried.join(own, "word").where((F.col("t") / F.col("n") <= t / n) & (F.col("share") > t / n))
    part = lambda k, q: F.when(k > 0, k * F.log(k / F.col("n") / q)).otherwise(0.0)
    gain = 2 * (part(F.col("t"), F.col("share")) + F.when(F.col("share") < 1, part(F.col("n") - F.col("t"), 1 - F.col("share"))).otherwise(math.inf))
    best = found.where(gain >= 2 * math.log(max(1, tried.count())) + 4).groupBy("phrase").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "phrase").limit(most)
    return sorted(r.phrase for r in best.collect())


class Matcher:
    """The automata over patterns and exception phrases; hits that begin inside a phrase are left out."""

    def __init__(self, lexicon: list[tuple[str, float]], exceptions: Sequence[str] = EXCEPTIONS):
        import ahocorasick

        self.patterns, self.phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
        for pattern, weight in lexicon:
            self.patterns.add_word(pattern, (len(pattern), weight))
        for phrase in exceptions:
            self.phrases.add_word(f" {phrase} ", len(phrase) + 1)
        self.empty, self.plain = not lexicon, not exceptions
        self.patterns.make_automaton()
        self.phrases.make_automaton()

    def hits(self, folded: str) -> float:
        """Sum of the weights of all hits, normalised by the number of words."""
        if self.empty or next(self.patterns.iter(folded), None) is None:
            return 0.0
        words = folded.split()
        text = " ".join(["", *words, ""])
        found = [(end - size + 1, weight) for end, (size, weight) in self.patterns.iter(text)]
        if not self.plain and (spans := [(end - size, end) for end, size in self.phrases.iter(text)]):
            found = [(at, w) for at, w in found if not any(a <= at < b for a, b in spans)]
        return sum(w for _, w in found) / (1 + math.log1p(len(words) / LENGTH))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small penalty on the slope; a row counts ``weight`` times."""
    penalty = ridge * weight.sum()
    a = b = 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(weight * (y - p)).sum(), (weight * (y - p) * x).sum() - penalty * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + penalty]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], max(0.0, b + step[1])
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, bound: tuple[int, int] = BOUND, exceptions: Sequence[str] = EXCEPTIONS) -> dict:
    """A model: lexicon, exceptions (given and learned), intercept and slope.

    Uses doc_id and text, doc_id and toxic. Rows of null id or label are left
    out; of repeated labels the toxic one counts, repeated documents count each;
    null texts are empty. Without labels of both classes, or on empty tables,
    the model scores everything near 0.
    """
    ship(docs.sparkSession)
    chosen = sample(labels, bound)
    # At most sum(bound) rows of id and label.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").persist()
    try:
        lexicon = learn_lexicon(rows)
        if not lexicon:
            return {"lexicon": [], "exceptions": list(exceptions), "curve": (-20.0, 0.0)}
        phrases = sorted({*exceptions, *learn_exceptions(rows, lexicon)})
        seen = rows.select(_scored(lexicon, phrases)("text").alias("x"), "toxic").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    finally:
        rows.unpersist()
    x, y, n = (np.array([float(r[k]) for r in seen]) for k in range(3))
    toxic, other = class_weights(labels, bound)
    return {"lexicon": lexicon, "exceptions": phrases, "curve": logistic(x, y, n * np.where(y == 1, toxic, other))}


def _scored(lexicon: list[tuple[str, float]], exceptions: Sequence[str]):
    """A UDF of the normalised sum; the lexicon has at most ENTRIES entries and travels with it."""
    kept: list[Matcher] = []

    def hits(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Matcher(lexicon, exceptions))
        return pd.Series([kept[0].hits(fold(t)) for t in texts], dtype="float64")

    return F.pandas_udf(hits, "double")


def probability(model: dict, text: str = "text") -> Column:
    """The score of a column of texts."""
    a, b = model["curve"]
    x = _scored(model["lexicon"], model["exceptions"])(text)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * x)))


def score(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where score >= 0.3).

    Columns of these names are replaced; ``prefix`` gives the outputs other
    names. Null and empty texts have no hits and get the curve's lowest value;
    texts of any length are scored whole. Rows are scored one by one: repeated
    rows alike, null ids too; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    out = docs.withColumn(f"{prefix}score", probability(model))
    return out.withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= THRESHOLD).cast("int"))
