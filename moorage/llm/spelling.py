"""Op 11, spelling variants: symmetric-delete join of a corpus's words.

Every word emits itself and its distinct single deletions as keys; words that
share a key are at most two edits apart, and those exactly one apart are near.
Forms (a much more frequent near word) are then followed to their roots by
pointer doubling, one join a round.

The keys are polynomial hashes, so a word's deletions cost as many numbers as it
has letters, not as many copies of it; whatever two words share by chance is
dropped when their distance is verified. Words sharing a key are its single
insertions at most, so a key's list is bounded by its length times the letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, forget, ship

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
#: Code points and occurrences that a word has at least.
LEAST_CHARS, LEAST_TIMES = 6, 5
#: How many times as frequent a form is.
FACTOR = 5
#: One run of a document in so many loses a letter, by a hash of document and run.
ODD = 199
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def damaged(doc_id: Column, word: Column, odd: int = ODD) -> Column:
    """The word, for one in ``odd`` without one letter: slips of the keyboard that a hash of document and word decides. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % odd == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, odd: int | None = ODD, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n: the words of whole texts and how often they are there; counts are summed before the shuffle."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    # A damaged run has one letter less at most.
    long = runs.where(F.length("run") >= least_chars)
    words = long.select((damaged(F.col("doc_id"), F.col("run"), odd) if odd else F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, key): for each word its own hash and those of its distinct single deletions.

    The hash of a sequence is the sum of its letters' values times powers of an
    odd base, modulo 2^64, so that of a deletion is the sum before the place and
    the sum behind it, one power lower.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - starts[owner]
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(sizes.max(initial=0)), _BASE))), dtype=np.uint64)
    value = _mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[place]
    upto = np.concatenate(([np.uint64(0)], np.cumsum(value, dtype=np.uint64)))
    before = upto[:-1] - upto[starts][owner]
    behind = upto[starts + sizes][owner] - upto[1:]
    # Of a run of equal letters each deletion gives the same: the first one counts.
    first = (place == 0) | (codes != np.concatenate((codes[:1], codes[:-1])))
    whole = upto[starts + sizes] - upto[starts]
    keys = np.concatenate((whole, (before + behind * _BACK)[first]))
    return np.concatenate((np.arange(len(words)), owner[first])), keys.view(np.int64)


#: Letters of words that are turned to keys at once (one word at least).
AT_ONCE = 1_000_000


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch["word"]).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            part = batch.slice(start, end - start)
            owner, keys = deletion_keys(part["word"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys), part["id"].take(pa.array(owner))], names=["key", "id"])
            start = end


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (a < b): all pairs of words (column word, each once) that differ by exactly one inserted, deleted or replaced code point."""
    ship(words.sparkSession)
    # Keys travel with a hash of their word, so a long word is not written once for each of its letters.
    keys = cut_lineage(words.select("word", F.xxhash64("word").alias("id")).mapInArrow(_emit, "key long, id long"))
    shared = keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    lists = cut_lineage(keys.join(shared, "key"))
    pairs = lists.select("key", F.col("id").alias("i")).join(lists.select("key", F.col("id").alias("j")), "key").where("i < j").select("i", "j").distinct()
    text = words.select(F.xxhash64("word").alias("id"), "word")
    met = pairs.join(text.select(F.col("id").alias("i"), F.col("word").alias("x")), "i").join(text.select(F.col("id").alias("j"), F.col("word").alias("y")), "j")
    # Lengths first; the distance stops counting at two.
    near = met.where(F.abs(F.length("x") - F.length("y")) <= 1).where(F.levenshtein("x", "y", 1) == 1)
    out = cut_lineage(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    forget(keys, lists)
    return out


def with_forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n (of equals the first in code-point order) where it is ``factor`` times as frequent."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    told = words.join(best, "word", "left").withColumn("far", -F.col("best.m") >= factor * F.col("n"))
    return told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("far"), F.col("best.other")).alias("form"), F.when(F.col("far"), -F.col("best.m")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form and more) with root: where following forms ends; the word itself if it has none.

    Each round joins every pointer with what it points to, so chains halve;
    forms grow more frequent by a factor each step, so there are no circles.
    ``forms`` is cut from its lineage.
    """
    at = cut_lineage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(at)
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
        at._moorage_path = moved._moorage_path
    out = forms.join(at, "word", "left")
    return out.withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, odd: int | None = ODD, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (doc_id, text).

    A null text has no words; a null id counts as empty where runs are damaged
    (``odd``; None: none are). Repeated rows count each. Of equally frequent
    near words the first in code-point order is the form. Texts and runs of any
    length count whole; other columns may have any name and aren't used; an
    empty table gives an empty result.
    """
    words = cut_lineage(word_counts(docs, odd, least_chars, least_times))
    pairs = near_pairs(words)
    forms = cut_lineage(with_forms(words, pairs, factor))
    forget(words, pairs)
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
