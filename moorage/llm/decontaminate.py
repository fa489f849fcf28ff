"""Op 9, benchmark decontamination by spaced seeds.

A seed is a fixed mask of word positions; positions outside the mask are
ignored, so a substituted word there does no harm. The masks' hashes of all
benchmark items are joined with those of the documents, and each hit is
verified over its whole diagonal: some NEED words of the item in a row, or the
whole of a shorter item, must stand there with at most a quarter of them
substituted, wherever the substituted ones are.

The masks find every such passage: those of MASKS any three substitutions in
NEED words, those of short_masks a quarter of a shorter item (checked for all
placements in the tests).

A benchmark whose seeds fit into a worker is sent there, in parts if need be.
A larger one is joined by a shuffle (``joined_overlaps``): hashes of documents
with hashes of the benchmark's distinct windows of NEED words. Items that have a
phrase in common have its windows in common, so a phrase of many items costs a
document one candidate a place, and items come in where a window is verified.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, forget, fresh, ship

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 5, 7, 8, 9), (0, 1, 2, 6, 8))
#: Words in a row that an overlap must span, or all of an item with fewer words.
NEED = 12
#: Characters of benchmark text that are broadcast at once; a larger benchmark is taken in parts, each of them against all documents.
PART_CHARS = 8_000_000
#: Parts of a benchmark from which on hashes are joined: each part is a pass over the documents, the join moves some rows a word, once.
JOIN_PARTS = 10
_WORDS = re.compile(r"[^\W_]+")
_BITS = 20


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation; null has none."""
    return _WORDS.findall(text.lower()) if text else []


class Part(NamedTuple):
    """Seeds of a part of the benchmark."""

    ids: dict[str, int]
    item_ids: list[int]
    items: list[np.ndarray]
    #: By mask: its positions, sorted hashes, and for each of them the item and the position there.
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]
    table: np.ndarray


def _factors(n: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)


def hashes(ids: np.ndarray, mask: tuple[int, ...], factors: np.ndarray) -> np.ndarray:
    """The mask's hash at each place; 0 where a masked word is none of the benchmark's."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, known = np.full(n, np.uint64(len(mask))), np.ones(n, dtype=bool)
    for k, at in enumerate(mask):
        part = ids[at : at + n]
        known &= part > 0
        total = total + part * factors[k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.where(known, total | np.uint64(1), np.uint64(0))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n < NEED words: of its parts, two more than may be substituted, any two that are left equal."""
    may = n // 4
    if not may:
        return [tuple(range(n))]
    ends = [n * k // (may + 2) for k in range(may + 3)]
    parts = [tuple(range(a, b)) for a, b in zip(ends, ends[1:])]
    return [a + b for a, b in itertools.combinations(parts, 2)]


def build(rows: list[tuple[int, str]]) -> Part:
    ids: dict[str, int] = {}
    item_ids, items = [], []
    for item_id, text in rows:
        words = words_of(text)
        if words:
            item_ids.append(item_id)
            items.append(np.array([ids.setdefault(w, len(ids) + 1) for w in words], dtype=np.uint64))
    # Masks and, for each, the items sought by it: at every place of those of NEED words or more, at one place of a shorter one.
    sought: dict[tuple[int, ...], list[tuple[int, int | None]]] = {m: [(i, None) for i, x in enumerate(items) if len(x) >= NEED] for m in MASKS}
    for i, x in enumerate(items):
        for m in short_masks(len(x)) if len(x) < NEED else ():
            sought.setdefault(tuple(k - m[0] for k in m), []).append((i, m[0]))
    factors = _factors(max(map(len, sought)))
    table, seeds = np.zeros(1 << _BITS, dtype=bool), []
    for mask, places in sought.items():
        found = [(h, i, q) for i, only in places for q, h in enumerate(hashes(items[i], mask, factors).tolist()) if only in (None, q)]
        found.sort()
        h = np.array([f[0] for f in found], dtype=np.uint64)
        table[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        seeds.append((mask, h, np.array([f[1] for f in found], dtype=np.int64), np.array([f[2] for f in found], dtype=np.int64)))
    return Part(ids, item_ids, items, seeds, table)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """The NEED words of a diagonal with the most equal ones: for how many words these suffice if a quarter may be substituted, begin, end."""
    sums = np.concatenate(([0], np.cumsum(equal)))
    held = sums[min(NEED, len(equal)) :] - sums[: max(1, len(sums) - NEED)]
    at = int(held.argmax())
    return int(held[at]) * 4 // 3, at, min(at + NEED, len(equal))


def passage(equal: np.ndarray) -> tuple[int, int, int]:
    """The stretch with the most equal words less 3 for each other one, with the best NEED words in it: equal words, begin, end."""
    _, a, b = best_stretch(equal)
    gain = np.concatenate(([0], np.cumsum(np.where(equal, 1, -3))))
    begin, end = int(gain[: a + 1].argmin()), b + int(gain[b:].argmax())
    inside = begin + np.flatnonzero(equal[begin:end])
    return len(inside), int(inside[0]), int(inside[-1]) + 1


def overlaps(text: str | None, part: Part) -> list[tuple[int, int, int, int, int]]:
    """(item, equal words, words of the item, first word, end) of each item that the text overlaps, at its best place."""
    words = words_of(text)
    if not words or not part.items:
        return []
    ids = np.fromiter((part.ids.get(w, 0) for w in words), dtype=np.uint64, count=len(words))
    factors, places = _factors(max(len(s[0]) for s in part.seeds)), set()
    for mask, known, item, at in part.seeds:
        h = hashes(ids, mask, factors)
        likely = np.flatnonzero(h)
        likely = likely[part.table[(h[likely] >> np.uint64(64 - _BITS)).astype(np.int64)]]
        if not len(likely) or not len(known):
            continue
        low, high = np.searchsorted(known, h[likely], "left"), np.searchsorted(known, h[likely], "right")
        for p, a, b in zip(likely.tolist(), low.tolist(), high.tolist()):
            places.update((int(item[k]), p - int(at[k])) for k in range(a, b))
    best: dict[int, tuple] = {}
    for i, shift in sorted(places):
        own = part.items[i]
        first, end = max(0, shift), min(len(ids), shift + len(own))
        same = ids[first:end] == own[first - shift : end - shift]
        if best_stretch(same)[0] >= min(NEED, len(own)):
            equal, a, b = passage(same)
            if equal > best.get(i, (0,))[0]:
                best[i] = (equal, first + a, first + b)
    return [(part.item_ids[i], e, len(part.items[i]), a, b) for i, (e, a, b) in best.items()]


def benchmark_parts(benchmark: DataFrame, part_chars: int = PART_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in parts of bounded size; one part at a time is on the driver."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // part_chars))
    for k in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()]


def _seeker(held: Broadcast):
    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = held.value
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"]) for x in overlaps(t, part)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "equal_words", "item_words", "first_word", "end_word"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return seek


SCHEMA = "doc_id long, item_id long, equal_words long, item_words long, first_word long, end_word long"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One row for each document and item that overlap, at the best place.

    Uses doc_id and text, item_id and text; other columns may have any name.
    Null or empty texts on either side overlap nothing; an item of any number
    of words is sought, one of up to three as it stands; repeated documents give
    a row each, repeated items one in all; null ids stay null; of equally good
    places of an item the first counts. A text of any length is searched whole.
    An empty table on either side gives an empty result.
    """
    ship(docs.sparkSession)
    if (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) > part_chars * JOIN_PARTS:
        return joined_overlaps(docs, benchmark)
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for part in benchmark_parts(benchmark, part_chars):
        found = rows.mapInPandas(_seeker(spark.sparkContext.broadcast(build(part))), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 for w in words), dtype=np.uint64, count=len(words))


def shapes(sizes: list[int]) -> list[tuple[int, ...]]:
    """The masks that windows of these numbers of words need, each from its first word on."""
    short = [tuple(k - m[0] for k in m) for n in sorted(set(sizes)) if n < NEED for m in short_masks(n)]
    return list(dict.fromkeys([*(MASKS if NEED in sizes else ()), *short]))


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each item its windows of NEED words, or all of a shorter one: win (a hash of its words), words, item, text, at."""
    for batch in batches:
        out = []
        for item_id, text in zip(batch["item_id"], batch["text"]):
            words = _word_hashes(words_of(text))
            n = min(NEED, len(words))
            for at in range(len(words) - n + 1 if n else 0):
                own = words[at : at + n]
                out.append((xxhash.xxh64_intdigest(own.tobytes()) - 2**63, own.view(np.int64).tolist(), item_id, text, at))
        yield pd.DataFrame(out, columns=["win", "words", "item_id", "text", "at"]).astype({"item_id": "Int64"})


def _window_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each window its hashes under the masks that are sought in it, and where they are: h, win, at."""
    for batch in batches:
        out = []
        for win, words in zip(batch["win"], batch["words"]):
            ids = np.asarray(words, dtype=np.int64).view(np.uint64)
            masks = MASKS if len(ids) == NEED else short_masks(len(ids))
            for m in masks:
                own, first = tuple(k - m[0] for k in m), m[0]
                factors = _factors(NEED)
                for at, h in enumerate(hashes(ids, own, factors).tolist()):
                    if len(ids) == NEED or at == first:
                        out.append((h - 2**63, win, at))
        yield pd.DataFrame(out, columns=["h", "win", "at"]).drop_duplicates()


def _place_seeds(masks: list[tuple[int, ...]]):
    """Of each text its hashes under all masks: h, row, place."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(NEED)
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                ids = _word_hashes(words_of(text))
                for m in masks:
                    h = (hashes(ids, m, factors) - np.uint64(2**63)).view(np.int64)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), row, dtype=np.int64)), pa.array(np.arange(len(h), dtype=np.int64))], names=["h", "row", "place"])

    return seeds


def _verified(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Windows that a text has with at most a quarter of their words substituted: row, win, place. A place may lie before the text or reach beyond it."""
    out = []
    for row, text in zip(texts["row"], texts["text"]):
        ids = _word_hashes(words_of(text))
        for win, place, words in zip(found["win"], found["place"], found["words"]):
            own = np.asarray(words, dtype=np.int64).view(np.uint64)
            first, end = max(0, place), min(len(ids), place + len(own))
            if end > first and int((ids[first:end] == own[first - place : end - place]).sum()) * 4 >= 3 * len(own):
                out.append((row, win, place))
    return pd.DataFrame(out, columns=["row", "win", "place"])


def _best_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row, text, item_id, item, shifts in zip(batch["row"], batch["text"], batch["item_id"], batch["item"], batch["shifts"]):
            ids, own = _word_hashes(words_of(text)), _word_hashes(words_of(item))
            best = None
            for shift in sorted(set(shifts)):
                first, end = max(0, shift), min(len(ids), shift + len(own))
                same = ids[first:end] == own[first - shift : end - shift]
                if best_stretch(same)[0] >= min(NEED, len(own)):
                    equal, a, b = passage(same)
                    if best is None or equal > best[0]:
                        best = (equal, first + a, first + b)
            if best:
                rows.append((row, item_id, best[0], len(own), best[1], best[2]))
        yield pd.DataFrame(rows, columns=["row", "item_id", "equal_words", "item_words", "first_word", "end_word"]).astype({"item_id": "Int64"})


def joined_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find_overlaps by a join of hashes, whatever the benchmark's size; texts of more than one row are sought once."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").where("text IS NOT NULL")
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    texts = cut_lineage(rows.groupBy("row").agg(F.first("text").alias("text")))
    placed = cut_lineage(items.mapInPandas(_windows, "win long, words array<long>, item_id long, text string, at long"))
    windows = cut_lineage(placed.groupBy("win").agg(F.first("words").alias("words")))
    sizes = [r.n for r in windows.select(F.size("words").alias("n")).distinct().collect()]  # at most NEED
    seeds = cut_lineage(windows.mapInPandas(_window_seeds, "h long, win long, at long"))
    places = texts.mapInArrow(_place_seeds(shapes(sizes)), "h long, row long, place long")
    # What one list of each side holds is met once: a seed of several windows, at several places.
    known = seeds.select("h").distinct()
    hit = cut_lineage(places.join(known, "h", "left_semi"))
    candidates = hit.join(seeds, "h").select("row", "win", (F.col("place") - F.col("at")).alias("place")).distinct().join(windows, "win")
    met = texts.join(candidates.select("row").distinct(), "row", "left_semi")
    held = cut_lineage(met.groupBy("row").cogroup(candidates.groupBy("row")).applyInPandas(_verified, "row long, win long, place long"))
    # Only now the items come in: all of these overlap.
    each = held.join(placed.select("win", "item_id", F.col("text").alias("item"), "at"), "win")
    pairs = each.groupBy("row", "item_id", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    best = pairs.join(texts, "row").mapInPandas(_best_places, "row long, item_id long, equal_words long, item_words long, first_word long, end_word long")
    # An item's id may stand on several texts: as many rows as overlap.
    out = cut_lineage(rows.select("doc_id", "row").join(best, "row").select("doc_id", "item_id", "equal_words", "item_words", "first_word", "end_word"))
    forget(texts, placed, windows, seeds, hit, held)
    return out


def _tester(held: Broadcast):
    def clean(texts: pd.Series) -> pd.Series:
        part = held.value
        return pd.Series([not overlaps(t, part) for t in texts], dtype="bool")

    return clean


def drop_overlapping(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` without the documents that overlap an item (see find_overlaps); all columns stay, whatever their names.

    Null and empty texts stay, as do all rows if the benchmark is empty;
    repeated rows stay or go alike.
    """
    ship(docs.sparkSession)
    if (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) > part_chars * JOIN_PARTS:
        (key,) = fresh(docs, "text_hash")
        gone = joined_overlaps(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
        return docs.withColumn(key, F.xxhash64("text")).join(gone, key, "left_anti").select(docs.columns)
    spark = docs.sparkSession
    for part in benchmark_parts(benchmark, part_chars):
        docs = docs.where(F.pandas_udf(_tester(spark.sparkContext.broadcast(build(part))), "boolean")("text"))
    return docs
