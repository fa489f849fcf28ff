"""Op 6, packing by minimum bin slack over the multiset of remaining lengths.

Documents become token ids plus an end id and are cut into full windows and one
remainder. Remainders of one length are interchangeable, so the plan is made on
their counts, at most capacity - 1 numbers: for each window the longest length
left is set, a bitset subset-sum dynamic program over the counts finds the
fill closest to capacity, and backtracking gives how many of each length it
takes; the pattern is repeated as often as the counts allow. Pieces then find
their window by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship
from .workers import give_back

CAPACITY = 2048
END = 1
#: Bytes of words, and of parts of words, that a worker keeps with their ids.
KEPT_BYTES = 160_000_000
#: The rules that WordTokenizer knows, as a tokenizer file states them, and how they cut a lower-case word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words that normalisation only lower-cases: ASCII and precomposed Latin letters, without the special tokens' mark.
_PLAIN = regex.compile(r"(?:(?!<\|)[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e])+")


#: Letters only, of the same kind, with at most one mark behind them: at most two parts.
_LETTERS_ONLY = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([.,;:!?]?)")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a visible character: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


_LETTERS = _byte_letters()


class WordTokenizer:
    """Ids of a tokenizer that drops white space, word by word, with the ids of seen words kept.

    The vocabulary's rules never look across white space, so the ids of a text
    are those of its words in order. Cuts are made at the space, tab, line feed
    and carriage return only, a part of what the tokenizer drops. Plain words
    are cut further into the vocabulary's parts, which recur far more often;
    any other word goes to the tokenizer as it stands. For files of these rules
    only (see ``knows``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.spent = 0

    @staticmethod
    def knows(path: str) -> bool:
        """Whether a tokenizer file states the rules that are followed here, and no added token but special ones in <| |>."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        marked = all(t["special"] and re.fullmatch(r"<\|\w+\|>", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in told["added_tokens"])
        same = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _PRE_TOKENIZER and not any(told.get(k) for k in ("truncation", "padding", "post_processor"))
        return same and marked and model["type"] == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("byte_fallback"))

    def forget(self) -> None:
        """Drops the kept words; another partition's rare words are other ones."""
        self.words.clear()
        self.parts.clear()
        self.spent = 0

    def _keep(self, held: dict[str, bytes], word: str, ids: bytes) -> bytes:
        self.spent += 2 * len(word) + len(ids) + 190
        if self.spent > KEPT_BYTES:
            self.forget()
        held[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
            found = [t.id for t in self.model.tokenize(shown)]
            ids = self._keep(self.parts, part, struct.pack(f"<{len(found)}I", *found))
        return ids

    def _word(self, word: str) -> bytes:
        if m := _LETTERS_ONLY.fullmatch(word):
            letters, mark = m.groups()
            ids = self._part(letters.lower())
            return self._keep(self.words, word, ids + self._part(mark) if mark else ids)
        if _PLAIN.fullmatch(word):
            return self._keep(self.words, word, b"".join(map(self._part, _PARTS.findall(word.lower()))))
        return self._keep(self.words, word, np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes())

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        get, new = self.words.get, self._word
        return b"".join([ids if (ids := get(w)) is not None else new(w) for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")])


class PieceTokenizer:
    """Ids of any other tokenizer: a file of ``tokenizers`` (.json) or of ``sentencepiece`` (.model), each text whole."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.encode = SentencePieceProcessor(model_file=path).encode
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        """Keeps nothing."""

    def __call__(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()


_loaded: dict[str, WordTokenizer | PieceTokenizer] = {}


def loaded(path: str) -> WordTokenizer | PieceTokenizer:
    """This worker's tokenizer; workers outlive tasks."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path) if path.endswith(".json") and WordTokenizer.knows(path) else PieceTokenizer(path)
    return _loaded[path]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: full windows, then the remainder, with the partition it came from and its rank there among pieces of its length."""

    ship(docs.sparkSession)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, ranks = loaded(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    n = len(piece) // 4
                    rows.append((doc_id, start, n, zlib.crc32(piece), total, part, ranks[n]))
                    ranks[n] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])
            yield out.astype({"doc_id": "Int64"})
        encode.forget()
        give_back()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset out of ``counts`` whose sum is closest to ``room`` from below: bitset subset-sum, backtracked."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:  # a bounded count as powers of two
            k = min(take, left)
            layers.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left -= k
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, k in reversed(layers):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each length) with the number of windows filled so."""
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = fill({n: c for n, c in left.items() if c > 0}, capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        plan.append((used, times))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a window, first sequence, offset): where the pieces of a length go by rank."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in plan:
        offset = 0
        for n in sorted(used, reverse=True):
            first = given.get(n, 0)
            given[n] = first + used[n] * times
            rows.append((n, first, given[n], used[n], sequence, offset))
            offset += n * used[n]
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text; other columns are not used) and where they lie.

    Null or empty text gives a piece with the end id alone; a null doc_id stays
    null; repeated rows are packed each; an empty table gives an empty result.
    Texts of any length are encoded whole.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut_pieces(docs, tokenizer, capacity))
    # One row for each partition and length, summed before the shuffle; the totals are at most ``capacity`` numbers.
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("held"))
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    rows = slots(plan_windows(counts, capacity))
    before = held.select("part", "length", (F.sum("held").over(Window.partitionBy("length").orderBy("part")) - F.col("held")).alias("before"))
    places = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, first long, end long, each long, sequence long, at long")
    places = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "end", "each", "sequence", "at"))).alias("places"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    # Bounded by the plan: at most a few thousand rows whatever the input.
    found = ranked.join(F.broadcast(places), "length").withColumn("p", F.filter("places", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["end"]))[0])
    nth = F.col("rank") - F.col("p.first")
    within = F.pmod(nth, F.col("p.each"))
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p.sequence") + ((nth - within) / F.col("p.each")).cast("long")).alias("sequence_id"),
        (F.col("p.at") + within * F.col("length")).cast("long").alias("offset"),
    )
