"""Op 3, personal data: patterns, then information-theoretic sanitisation.

Patterns find protected entities. All terms of the documents that hold an
entity are then judged by what the whole corpus says of them: how likely a
document with the term holds the entity, and one with the entity the term, each
drawn towards the general frequency by ``PRIOR`` documents. Their geometric mean
is what term and entity tell of each other: its logarithm is the information
that is left of one once the other is known, whatever the corpus's size. A term
that leaves little is removed, one that leaves some is generalised, wherever it
occurs in these documents; both are spans of kind ``term``.

Entities that stand in the same documents have the same counts with every term,
so they are one group: a list of thousands of addresses in one document is
counted once. Only terms that can reach the threshold meet the groups, and each
text gets its terms once, whatever entities they reveal.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, forget, fresh, ship
from .workers import give_back

KINDS = ("email", "ip", "card", "phone")
#: Documents' worth of doubt: term and entity count as if each also stood in so many documents that hold the other as often as any.
PRIOR = 1.0
#: Values of ``bond`` from which a term is generalised, and removed. A term and an entity of one and the same document have 1/2, of two 2/3, of three 3/4; if one stands in a further document, about 0.41, 0.58, 0.67.
GENERALISE, REMOVE = 0.5, 0.7
#: Terms that a worker counts before it passes them on; counts are summed once more before the shuffle.
KEPT_TERMS = 50_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Numbers with single dots between them: it cannot fail once begun, so a run of digits is read once.
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Words, names, numbers and keys: letters and digits in a row.
_TERM = re.compile(r"[^\W_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: a match holds exactly one."""
    spans, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((begin, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return spans


def _ips(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: four numbers at a time of each chain of numbers."""
    spans = []
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x) <= 3 or len(x.lstrip("0")) <= 3 for x in four) and all(int(x.lstrip("0") or 0) <= 255 for x in four):
                spans.append((at, end))
            at = end + 1
    return spans


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of every entity, in order; code points, end exclusive."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in _ips(text)] if "." in text else []
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entity(text: str, kind: int, start: int, end: int) -> str:
    value = text[start:end].lower()
    return f"{KINDS[kind]}:{value if kind < 2 else _NOT_DIGIT.sub('', value)}"


def terms_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every term that touches no entity, in the whole text."""
    covered = bytearray(len(text))
    for a, _, b in spans:
        covered[a:b] = b"\1" * (b - a)
    for m in _TERM.finditer(text):
        if not any(covered[m.start() : m.end()]):
            yield m[0].lower(), m.start(), m.end()


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            names = sorted({entity(text, k, a, b) for a, k, b in base_spans(text)})
            rows.append((doc_id, text if names else None, names))
        yield pd.DataFrame(rows, columns=["doc_id", "text", "entities"]).astype({"doc_id": "Int64"})
    give_back()


def find_entities(docs: DataFrame) -> DataFrame:
    """doc_id, digest, text and entities of each row, the digest and the text only where there is an entity; cut from the lineage."""
    ship(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_find, "doc_id long, text string, entities array<string>")
    return cut_lineage(found.select("doc_id", F.sha2("text", 256).alias("digest"), "text", "entities"))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df: Counter[str] = Counter()

    def out() -> pd.DataFrame:
        rows = pd.DataFrame({"term": list(df), "n": list(df.values())})
        df.clear()
        return rows.astype({"term": object, "n": "int64"})

    for batch in batches:
        for text in batch["text"]:
            if text:
                df.update({t.lower() for t in set(_TERM.findall(text))})
                if len(df) > KEPT_TERMS:
                    yield out()
    yield out()
    give_back()


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for digest, text in zip(batch["digest"], batch["text"]):
            terms = list({t for t, _, _ in terms_outside(text, base_spans(text))})
            yield pd.DataFrame({"digest": [digest] * len(terms), "term": terms})
    give_back()


def bond(j: Column, t: Column, e: Column, n: int, prior: float = PRIOR) -> Column:
    """What term and entity tell of each other: of ``n`` documents ``e`` hold the entity, ``t`` the term and ``j`` both. It grows with j."""
    return F.sqrt((j + prior * e / n) / (t + prior) * (j + prior * t / n) / (e + prior))


def disclosing(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR) -> DataFrame:
    """digest, term, remove: for each text with an entity the terms that reveal one, and whether they are to be removed; from the whole corpus, cut from the lineage."""
    n = max(1, found.count())
    # Equal texts once, with their number.
    texts = cut_lineage(found.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("w"), F.first("entities").alias("entities"), F.first("text").alias("text")))
    held = texts.select("digest", "w", F.explode("entities").alias("entity"))
    # What texts hold an entity, as hashes of the set: entities of one set are one group.
    hashed = held.withColumns({"x": F.xxhash64("digest"), "y": F.xxhash64(F.lit(1), "digest")})
    sets = hashed.groupBy("entity").agg(F.sum("w").alias("e"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("k"))
    groups = cut_lineage(held.join(sets.select("entity", "e", F.xxhash64("x", "y", "k").alias("grp")).where(F.col("e") < n), "entity").select("digest", "w", "grp", "e").distinct())
    # The term needs to stand in few documents: ``bond`` at its largest, j being the smaller of e and t.
    may = lambda: bond(F.least("e", "t"), F.col("t"), F.col("e"), n, prior) >= generalise
    widest = groups.groupBy("digest").agg(F.max("e").alias("e"))
    df = docs.select("text").mapInPandas(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("t"))
    # (e + prior) / (t + prior) >= generalise squared, whatever else.
    rare = df.where(F.col("t") <= ((groups.agg(F.max("e")).first()[0] or 0) + prior) / generalise**2)
    terms = texts.select("digest", "text").mapInPandas(_terms, "digest string, term string")
    likely = cut_lineage(terms.join(rare, "term").join(widest, "digest").where(F.col("t") <= (F.col("e") + prior) / generalise**2).select("digest", "term", "t"))
    pairs = likely.join(groups, "digest").where(may())
    both = pairs.groupBy("grp", "term").agg(F.sum("w").alias("j"), F.max("t").alias("t"), F.max("e").alias("e"))
    p = bond(F.col("j"), F.col("t"), F.col("e"), n, prior)
    judged = cut_lineage(both.withColumn("p", p).where(F.col("p") >= generalise).select("grp", "term", (F.col("p") >= remove).alias("remove")))
    # A term that reveals two entities is removed if it is for either.
    out = cut_lineage(likely.select("digest", "term").join(groups.select("digest", "grp"), "digest").join(judged, ["grp", "term"]).groupBy("digest", "term").agg(F.max("remove").alias("remove")))
    forget(texts, groups, likely, judged)
    return out


def term_spans(text: str, spans: list[tuple[int, int, int]], reveal: dict[str, bool]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is to be removed) of every occurrence of a revealing term."""
    return [(a, b, reveal[t]) for t, a, b in terms_outside(text, spans) if t in reveal] if reveal else []


def _reveals(own) -> dict[str, bool]:
    return {r["term"]: r["remove"] for r in own} if own is not None else {}


def _digest(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for text, own in zip(rows["text"], rows["own"]):
        spans = base_spans(text)
        base = written(spans)
        extra = [(a, len(KINDS), b) for a, b, _ in term_spans(text, spans, _reveals(own))] if spans else []
        names = (*KINDS, "term")
        every = ",".join(f"{names[y]}:{x}:{z}" for x, y, z in sorted(spans + extra))
        kinds = [y for _, y, _ in spans]
        out.append((*(kinds.count(i) for i in range(4)), hashlib.sha256(base.encode()).hexdigest(), every))
    return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = _digest(batch)
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
        yield out
    give_back()


def _by_text(reveal: DataFrame) -> DataFrame:
    """digest, own: a text's revealing terms, no more than it has terms."""
    return reveal.groupBy("digest").agg(F.collect_list(F.struct("term", "remove")).alias("own"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs`` (doc_id, text).

    Null text counts as empty and finds nothing; null ids stay; repeated rows
    are found each (and count each in the corpus statistics); texts of any
    length are searched whole; other columns may have any name and aren't used;
    an empty table gives an empty result.
    """
    found = find_entities(docs)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    own = _by_text(disclosing(docs, found))
    held = found.where("digest IS NOT NULL").join(own, "digest", "left").select("doc_id", "text", "own")
    rest = found.where("digest IS NULL").select("doc_id", "text", F.lit(None).cast("array<struct<term:string,remove:boolean>>").alias("own"))
    return held.unionByName(rest).mapInPandas(_digests, schema)


def generalised(term: str) -> str:
    """What is left of a term that is generalised: its class."""
    return "[ID]" if _DIGIT.search(term) else "[NAME]" if term[:1].isupper() else "[TERM]"


def sanitise_text(text: str | None, reveal: dict[str, bool]) -> str | None:
    """The text with entities replaced by their kind, and revealing terms generalised to their class or removed; null stays null."""
    spans = base_spans(text)
    if not spans:
        return text
    cuts, end = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in spans], -1
    cuts += [(a, b, "" if remove else generalised(text[a:b])) for a, b, remove in term_spans(text, spans, reveal)]
    out, at = [], 0
    for a, b, mark in sorted(cuts):
        if a >= end:  # of overlapping entities the first says what stands there; the rest is covered by it
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, part: int = 100_000) -> DataFrame:
    """``docs`` with sanitised texts; all rows stay, and all other columns, whatever their names.

    Null and empty texts stay as they are; repeated rows come out alike, and
    count each in the corpus statistics; texts of any length are cleaned whole;
    of overlapping entities the first one's mark stands for all; a term that
    discloses two entities is removed if it is for either. An empty table gives
    an empty result. The texts' revealing terms are sent to the workers up to
    ``part`` of them; if there are more, texts with a digit or an @ (others hold
    no entity) are joined with theirs.
    """
    found = find_entities(docs)
    reveal = disclosing(docs, found)
    forget(found)
    pairs = reveal.limit(part + 1).collect()
    if len(pairs) <= part:
        known: dict[str, dict[str, bool]] = {}
        for r in pairs:
            known.setdefault(r.digest, {})[r.term] = r.remove
        return docs.withColumn("text", F.pandas_udf(_cleaner(known), "string")("text"))
    key, own = fresh(docs, "text_digest", "reveal")
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    each = _by_text(reveal).select(F.col("digest").alias(key), F.col("own").alias(own))
    held = docs.where(may).withColumn(key, F.sha2("text", 256)).join(each, key, "left")
    return held.withColumn("text", F.pandas_udf(_clean_each, "string")("text", own)).select(docs.columns).unionByName(docs.where(~may))


def _cleaner(known: dict[str, dict[str, bool]]):
    def one(text: str | None) -> str | None:
        return sanitise_text(text, known.get(hashlib.sha256(text.encode()).hexdigest(), {})) if text and base_spans(text) else text

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="object")

    return clean


def _clean_each(texts: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([sanitise_text(t, _reveals(x)) for t, x in zip(texts, own)], dtype="object")
