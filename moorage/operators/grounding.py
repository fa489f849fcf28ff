"""Grounding: quotes, numbers and terms against an indexed source.

A source group (one document or several, joined) is kept as tables: folded
text, n-grams with positions, numbers, tokens. Quotes are few and grams many,
so grams are first counted per pair of quote and group, without positions; only
pairs that can reach the wanted score get their positions.

The densest window of a quote is found without a DISTINCT window: each hit of
gram number i at position p makes i present in all windows that end in
[p, p + width]; with the overlap to i's next hit cut off, the best window is
where most intervals overlap, a running sum over their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import GRAM, fold, grams, normalize_number

GROUNDED, WEAK = 0.85, 0.55
#: Quotes of so many grams are contained in a source or not; those of more are scored.
CONTAINED = 2
#: Bytes of quotes' grams that are sent to the workers.
SENT_BYTES = 48_000_000
#: The smallest numeric values of a source that derived numbers are sought among, unless all are asked for.
VALUES = 200
#: Positions of a block; cells of quotes and blocks that are held at once; codes up to which numbers are looked up in a table.
BLOCK, CELLS, TABLE = 16, 2_000_000, 4_000_000
#: Share of the grams that a score needs, which are left out as a quote's commonest when windows are bounded.
COMMON = 0.5
#: A place behind every text.
FAR = 1 << 60


def folded_sources(docs: DataFrame, key: str, text: str = "text", order: str | None = None, normal: bool = False) -> DataFrame:
    """key, raw, folded: the texts of a group in order, joined by line feeds."""
    if order is None:
        one = docs.select(key, F.coalesce(text, F.lit("")).alias("raw"))
    else:
        lines = F.sort_array(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
        one = docs.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("raw"))
    return one.withColumn("folded", fold(F.col("raw"), normal))


def quote_table(quotes: DataFrame, quote: str, text: str, normal: bool = False) -> DataFrame:
    """quote, folded_quote, length, n_grams, width; the text's own grams are taken from it."""
    folded = quotes.select(F.col(quote).alias("quote"), fold(F.col(text), normal).alias("folded_quote"))
    length = F.length("folded_quote")
    return folded.select("quote", "folded_quote", length.alias("length"), F.when(length >= GRAM, length - GRAM + 1).otherwise(F.when(length > 0, 1).otherwise(0)).alias("n_grams"), (F.floor(length * 18 / 10).cast("long") + 40).alias("width"))


def verdict(score: Column, where: Column) -> Column:
    return F.when(where == "no content", "weak").when(score >= GROUNDED, "grounded").when(score >= WEAK, "weak").otherwise("ungrounded")


def densest(pos: np.ndarray, i: np.ndarray, width: int) -> int:
    """The most distinct gram numbers i whose hits at pos lie within one window: the depth of their active intervals."""
    order = np.lexsort((pos, i))
    p, k = pos[order], i[order]
    ends = p + width + 1
    same = k[1:] == k[:-1]
    ends[:-1][same] = np.minimum(ends[:-1][same], p[1:][same])
    starts, ends = np.sort(p), np.sort(ends)
    return int((np.searchsorted(starts, starts, "right") - np.searchsorted(ends, starts, "right")).max())


class _Numbers:
    """Known codes by number, from 1 in order; others are 0. A table while codes are small, else bisection."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.table = None

    def __len__(self) -> int:
        return len(self.codes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        last = int(self.codes[-1])
        if last < TABLE:
            if self.table is None:
                self.table = np.zeros(last + 2, dtype=np.int32)
                self.table[self.codes] = np.arange(1, len(self.codes) + 1)
            return self.table[np.minimum(x, last + 1)]
        at = np.minimum(np.searchsorted(self.codes, x), len(self.codes) - 1)
        return np.where(self.codes[at] == x, at + 1, 0)


class _Postings:
    """Of each gram the quotes that have it, as often as they do."""

    def __init__(self, own: list[np.ndarray], grams: int):
        held = np.concatenate(own)
        self.quotes = np.repeat(np.arange(len(own)), [len(x) for x in own])[np.argsort(held, kind="stable")]
        self.sizes = np.bincount(held, minlength=grams)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def of(self, grams: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Stretches of the list (begin, end), with the quotes of each gram there and how many each has."""
        ends, begin = np.cumsum(self.sizes[grams]), 0
        while begin < len(grams):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n = self.sizes[grams[begin:end]]
            before = np.cumsum(n) - n
            yield begin, end, self.quotes[np.arange(int(n.sum())) + np.repeat(self.begins[grams[begin:end]] - before, n)], n
            begin = end


class QuoteGrams:
    """Folded quotes of at least one gram, by the numbers of their grams: letters, pairs of them and pairs of pairs are numbered, exactly."""

    def __init__(self, quotes: list[tuple[str, int]], least: float):
        """``quotes``: folded text and window width; ``least``: the score that is sought."""
        self.least = least
        self.texts, self.widths = [q for q, _ in quotes], np.array([w for _, w in quotes], dtype=np.int64)
        codes = [self._codes(q) for q in self.texts]
        self.letters = _Numbers(np.concatenate(codes))
        two = [self._two(c) for c in codes]
        self.pairs = _Numbers(np.concatenate(two))
        four = [self._four(t) for t in two]
        self.known = _Numbers(np.concatenate(four))
        #: Of each quote its grams' numbers (from 0) in order.
        self.own = [self.known(f).astype(np.int64) - 1 for f in four]
        self.n_grams = np.array([len(x) for x in self.own], dtype=np.int64)
        self.all = _Postings(self.own, len(self.known))
        # A window that reaches the score has so many of a quote's rarer grams even if it has all of its commonest.
        rarer = [x[np.argsort(self.all.sizes[x], kind="stable")][: len(x) - int(COMMON * least * len(x))] for x in self.own]
        self.rarer = _Postings(rarer, len(self.known))
        self.needed = np.maximum(least * self.n_grams - self.n_grams + [len(x) for x in rarer], 1)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)

    def _two(self, codes: np.ndarray) -> np.ndarray:
        x = self.letters(codes)
        return x[:-1].astype(np.int64) * (len(self.letters) + 1) + x[1:]

    def _four(self, two: np.ndarray) -> np.ndarray:
        x = self.pairs(two)
        return x[:-2].astype(np.int64) * (len(self.pairs) + 1) + x[2:]

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in a folded text where a known gram begins, and the grams."""
        if len(text) < GRAM:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        grams = self.known(self._four(self._two(self._codes(text))))
        at = np.flatnonzero(grams)
        return at, grams[at].astype(np.int64) - 1

    def best(self, text: str) -> list[tuple[int, int]]:
        """(quote's number, grams in its densest window) of the quotes that reach the score in a folded text.

        All of the text bounds a score first, then how many of a quote's rarer
        grams are in any window that ends in a block, for all quotes at once; only the
        hits around blocks that can reach the score are looked at one by one.
        """
        at, grams = self.hits(text)
        if not len(at):
            return []
        counts = np.zeros(len(self.texts), dtype=np.int64)
        for _, _, quotes, _ in self.all.of(np.unique(grams)):
            counts += np.bincount(quotes, minlength=len(counts))
        may = np.flatnonzero((counts > 0) & (counts >= self.least * self.n_grams))
        short = self.n_grams[may] <= CONTAINED
        out = [(int(q), int(self.n_grams[q])) for q in may[short] if self.texts[q] in text]
        may = may[~short]
        if not len(may):
            return sorted(out)
        # Where a gram is met again before it has left any window, it neither leaves nor enters one there.
        rarer = self.rarer.sizes[grams] > 0
        p, g = at[rarer], grams[rarer]
        order = np.argsort(g.astype(np.uint16) if len(self.known) < 65_536 else g, kind="stable")
        p, g = p[order], g[order]
        again = np.append(np.where(g[1:] == g[:-1], p[1:], FAR), FAR)[: len(p)]
        leaves = again - p > int(self.widths[may].min()) + 1
        enters = np.append(True, leaves[:-1])[: len(p)]
        events = p[enters], g[enters], p[leaves], g[leaves], again[leaves]
        blocks = int(at[-1]) // BLOCK + 1
        for first in range(0, len(may), group := max(1, CELLS // blocks)):
            out += self._densest(at, grams, events, blocks, may[first : first + group])
        return sorted(out)

    def _densest(self, at: np.ndarray, grams: np.ndarray, events: tuple, blocks: int, asked: np.ndarray) -> list[tuple[int, int]]:
        # A row for each quote asked for, and one for the others; what enters counts from its block's begin, what leaves until its block's end.
        row = np.full(len(self.texts), len(asked))
        row[asked] = np.arange(len(asked))
        columns = blocks + 2
        begin_of, ends = row * columns, self.widths + 1
        cells = np.zeros((len(asked) + 1) * columns, dtype=np.int64)
        into, into_grams, out_of, out_grams, again = events
        for begin, end, quotes, n in self.rarer.of(into_grams):
            cells += np.bincount(begin_of[quotes] + np.repeat(into[begin:end] // BLOCK, n), minlength=len(cells))
        for begin, end, quotes, n in self.rarer.of(out_grams):
            left = np.minimum(ends[quotes] + np.repeat(out_of[begin:end], n), np.repeat(again[begin:end], n))
            cells -= np.bincount(begin_of[quotes] + np.minimum(left // BLOCK, blocks) + 1, minlength=len(cells))
        depth = np.cumsum(cells.reshape(-1, columns)[:-1, :blocks], axis=1)
        reach = depth >= self.needed[asked][:, None]
        out = []
        for k in np.flatnonzero(reach.any(axis=1)).tolist():
            q = int(asked[k])
            # Hits in these blocks and within a window before them.
            hot = np.flatnonzero(reach[k])
            steps = np.bincount(np.maximum(hot - int(self.widths[q]) // BLOCK - 1, 0), minlength=blocks + 1)
            steps -= np.bincount(hot + 1, minlength=blocks + 1)
            near = (np.cumsum(steps) > 0)[at // BLOCK]
            p, g = at[near], grams[near]
            order = np.argsort(self.own[q], kind="stable")
            own = self.own[q][order]
            size = np.bincount(own, minlength=len(self.known))
            n = size[g]
            low = (np.cumsum(size) - size)[g]
            i = order[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            best = densest(np.repeat(p, n), i, int(self.widths[q]))
            if best >= self.least * self.n_grams[q]:
                out.append((q, best))
        return out


def _scorer(held: Broadcast):
    """For each folded text the numbers of the quotes that reach the score there, with their densest window."""

    def score(folded: pd.Series) -> pd.Series:
        return pd.Series([[{"n": q, "best": best} for q, best in held.value.best(text)] for text in folded], dtype="object")

    return F.pandas_udf(score, "array<struct<n:int,best:int>>")


def _sent(spark: SparkSession, rows: list, least: float) -> tuple[Broadcast | None, list]:
    """The quotes (quote, folded_quote, n_grams, width) as they are sent to the workers; the quotes by number."""
    once = list({r.quote: r for r in reversed(rows)}.values())[::-1]
    held = spark.sparkContext.broadcast(QuoteGrams([(r.folded_quote, r.width) for r in once], least)) if once else None
    return held, [(i, r.quote, r.n_grams) for i, r in enumerate(once)]


def _scored(best: DataFrame, key: str, least: float) -> DataFrame:
    score = F.col("best") / F.col("n_grams")
    where = F.when(F.col("n_grams") <= CONTAINED, "contained").when(score >= GROUNDED, "local").when(score >= WEAK, "partial").otherwise("scattered")
    return best.select(key, "quote", score.alias("score"), where.alias("where")).where(F.col("score") >= least)


def best_windows(hits: DataFrame, key: str) -> DataFrame:
    """key, quote, n_grams, best: the most distinct grams of a quote within one window of its width; ``hits``: key, quote, n_grams, width, i, pos."""
    after = F.lead("pos").over(Window.partitionBy(key, "quote", "i").orderBy("pos"))
    spans = hits.select(key, "quote", "n_grams", "pos", F.least(F.col("pos") + F.col("width") + 1, after).alias("end"))
    ends = spans.select(key, "quote", "n_grams", F.explode(F.array(F.struct(F.col("pos").cast("long").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").cast("long").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = ends.groupBy(key, "quote", "n_grams", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    depth = F.sum("step").over(Window.partitionBy(key, "quote").orderBy("at"))
    return steps.withColumn("depth", depth).groupBy(key, "quote", "n_grams").agg(F.max("depth").alias("best"))


def score_quotes(sources: DataFrame, quotes: DataFrame, key: str, pairs: DataFrame | None = None, least: float = 0.0, most_bytes: int = SENT_BYTES) -> DataFrame:
    """key, quote, score, where: how densely a quote's grams lie in a source.

    A quote of one or two grams has score 1 where the source contains it, else
    0; a shorter one has no content and score 0. ``pairs`` (key, quote) limits
    what is compared to given pairs, all of which come out. Pairs below
    ``least`` are left out; without pairs, so are those without a hit.
    ``sources``: folded_sources, ``quotes``: quote_table, both cached by the
    caller if dear. Quotes go to the workers while what is sent, about 100 bytes
    a gram, is at most ``most_bytes``; beyond, their grams are joined.
    """
    full = quotes.where(F.col("length") >= GRAM)
    own = full.select("quote", "n_grams", "width", F.posexplode(grams(F.col("folded_quote"))).alias("i", "gram"))
    if pairs is None and (full.agg(F.sum("n_grams")).first()[0] or 0) <= most_bytes // 100:
        held, names = _sent(sources.sparkSession, full.select("quote", "folded_quote", "n_grams", "width").collect(), least)
        if held is None:
            return _scored(full.select(F.lit(None).cast(sources.schema[key].dataType).alias(key), "quote", "n_grams", F.lit(0).alias("best")).limit(0), key, least)
        named = sources.sparkSession.createDataFrame(names, own.select(F.lit(0).alias("_n"), "quote", "n_grams").schema)
        found = sources.select(key, F.explode(_scorer(held)("folded")).alias("_f")).select(key, F.col("_f.n").alias("_n"), F.col("_f.best").alias("best"))
        return _scored(found.join(F.broadcast(named), "_n"), key, least)
    # How many of the quote's grams the source has anywhere bounds the score.
    many = own.groupBy("quote", "n_grams", "gram").agg(F.count("*").alias("times"))
    each = sources.select(key, F.explode(F.array_distinct(grams(F.col("folded")))).alias("gram"))
    linked = each.join(many, "gram") if pairs is None else each.join(pairs, key).join(many, ["quote", "gram"])
    bound = linked.groupBy(key, "quote", "n_grams").agg(F.sum("times").alias("most")).where(F.col("most") >= F.when(F.col("n_grams") <= CONTAINED, F.col("n_grams")).otherwise(least * F.col("n_grams")))
    long = bound.where(F.col("n_grams") > CONTAINED)
    placed = sources.join(long.select(key).distinct(), key, "left_semi").select(key, F.posexplode(grams(F.col("folded"))).alias("pos", "gram"))
    hits = placed.join(long.select(key, "quote"), key).join(own, ["quote", "gram"])
    best = best_windows(hits, key)
    # Short quotes whose grams the source has: whether they stand there in a row.
    short = bound.where(F.col("n_grams") <= CONTAINED).select(key, "quote", "n_grams").join(quotes.select("quote", "folded_quote"), "quote").join(sources.select(key, "folded"), key)
    inside = short.where(F.col("folded").contains(F.col("folded_quote"))).select(key, "quote", "n_grams", F.col("n_grams").cast("long").alias("best"))
    out = _scored(best.unionByName(inside), key, least)
    if pairs is None:
        return out
    rest = pairs.join(out, [key, "quote"], "left").join(quotes.select("quote", "length", "n_grams"), "quote")
    none = F.when(F.col("length") < GRAM, "no content").when(F.col("n_grams") <= CONTAINED, "absent").otherwise("no hit")
    return rest.select(key, "quote", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("where", none).alias("where"))


def verify_quotes(scores: DataFrame) -> DataFrame:
    """``scores`` with the score rounded to three places and the verdict on the unrounded one."""
    return scores.withColumn("verdict", verdict(F.col("score"), F.col("where"))).withColumn("score", F.round("score", 3))


def source_values(numbers: DataFrame, key: str, most: int | None = VALUES) -> DataFrame:
    """key, vals: the smallest ``most`` distinct numeric values of a source (None: all), in order; ``numbers`` has key and num."""
    value = numbers.select(key, F.col("num").try_cast("double").alias("v")).where("v IS NOT NULL").distinct()
    if most is not None:
        value = value.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("v"))).where(F.col("nth") <= most)
    return value.groupBy(key).agg(F.sort_array(F.collect_list("v")).alias("vals"))


#: Pairs of values that are checked at once.
PAIRS = 1_000_000


def gives(v: float, vals: np.ndarray) -> bool:
    """Whether two of the values a < b (in order, none negative) give v as difference, sum, share or growth.

    For each a the b that can are one stretch of the values, found by bisection
    with a little to spare; what lies there is checked by the rule itself, so the
    work is n log n unless many pairs come close.
    """
    if len(vals) < 2 or not np.isfinite(v):
        return False
    eps = max(0.05, abs(v) * 1e-6)
    a, spare = vals[:-1], 1e-9 * (1 + abs(v) + vals[-1])
    own = np.arange(len(a))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        # |100 b / a - v| < 0.05 and |100 (b - a) / a - v| < 0.05; of a / b the other way round.
        share_low = np.where(v + 0.05 > 0, 100 * a / max(v + 0.05, 1e-300), np.inf)
        share_high = 100 * a / (v - 0.05) if v > 0.05 else np.full(len(a), np.inf)
        stretches = [
            (a + v - eps, a + v + eps, lambda x, y: np.abs(np.abs(x - y) - v) < eps),
            (v - a - eps, v - a + eps, lambda x, y: np.abs(x + y - v) < eps),
            (share_low, share_high, lambda x, y: (y != 0) & (np.abs(x / y * 100 - v) < 0.05)),
            (a * (v - 0.05) / 100, a * (v + 0.05) / 100, lambda x, y: (x != 0) & (np.abs(y / x * 100 - v) < 0.05)),
            (a * (1 + (v - 0.05) / 100), a * (1 + (v + 0.05) / 100), lambda x, y: (x != 0) & (np.abs((y - x) / x * 100 - v) < 0.05)),
        ]
        for low, high, rule in stretches:
            first = np.maximum(np.searchsorted(vals, low - spare - 1e-9 * np.abs(low), "left"), own + 1)
            last = np.searchsorted(vals, high + spare + 1e-9 * np.abs(high), "right")
            sizes = np.maximum(last - first, 0)
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(a):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                n = sizes[begin:end]
                if total := int(n.sum()):
                    x = np.repeat(own[begin:end], n)
                    y = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[begin:end], n)
                    if rule(vals[x], vals[y]).any():
                        return True
                begin = end
    return False


def _kinds(asked: pd.Series, vals: pd.Series) -> pd.Series:
    out = []
    for claims, held in zip(asked, vals):
        own = np.asarray(held if held is not None else [], dtype=np.float64)
        near = lambda v, own=own: bool(len(own)) and bool(np.abs(own - v).min() < 1e-9)
        out.append([{"v": float(v), "kind": "literal" if near(v) else "derived" if gives(float(v), own) else "unknown"} for v in claims])
    return pd.Series(out, dtype="object")


def classify_numbers(claims: DataFrame, numbers: DataFrame, key: str, raw: str = "raw", most: int | None = VALUES) -> DataFrame:
    """``claims`` (key, raw, ...) with kind: literal, derived or unknown.

    A number is literal if the source has it, as text or as a value; derived if
    two of the source's values a < b give it as difference, sum, share or
    growth. Pairs are sought among the ``most`` smallest values, or all (None).
    A source's values meet all of its claims at once, in one row.
    """
    asked = claims.withColumn("_n", normalize_number(F.col(raw))).withColumn("_v", F.col("_n").try_cast("double"))
    exact = numbers.select(key, F.col("num").alias("_n"), F.lit(True).alias("_literal")).distinct()
    gathered = asked.where("_v IS NOT NULL").groupBy(key).agg(F.collect_set("_v").alias("_asked")).join(source_values(numbers, key, most), key, "left")
    kinds = gathered.select(key, F.explode(F.pandas_udf(_kinds, "array<struct<v:double,kind:string>>")("_asked", "vals")).alias("_k")).select(key, F.col("_k.v").alias("_v"), F.col("_k.kind").alias("_kind"))
    seen = asked.join(exact, [key, "_n"], "left").join(kinds, [key, "_v"], "left")
    kind = F.when(F.col("_literal"), "literal").otherwise(F.coalesce("_kind", F.lit("unknown")))
    return seen.withColumn("kind", kind).select(*claims.columns, "kind")
