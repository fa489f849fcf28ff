"""Op 7, near-duplicates: bottom-k sketches from one hash function.

A document is the set of its hashed five-word shingles; its sketch is the
``SKETCH`` smallest hashes. Documents of equal sets form a class. Inverted
lists of the ``INDEX`` smallest values generate the overlaps between classes;
the union's sketch estimates the Jaccard similarity and drops what lies far
below; the full sets verify the rest. Links are confirmed on full sets only.

No list is ever expanded into its pairs unless it is short and its members are
still unconnected:

* A class takes part with its rarest values only. Two sets of similarity 0.75
  share at least ``SHARED`` of their index values (but for odds under 1e-6), so
  they share one of the rarest ``INDEX - SHARED + 1``. Values that nobody else
  has use up these places, so common passages draw in no documents that consist
  of other things for the most part.
* In each list every class is compared with one leader; some rounds with other
  leaders connect what belongs together at a cost of one row per member.
* Then only pairs of different components are of interest. Lists within one
  component are dropped. Where all but SHORT members of a list are in one
  component, the others meet all members.
* What is left are lists of much that is common to many. Their members get
  lists of the full sets, of each the rarest quarter of its shingles, with the
  place of each: sets of similarity 0.75 share one of these (exact, no odds),
  and of such a pair the smaller set has at most a seventh of its shingles
  before the shared one (it is a ``core`` there). Lists of one component, or
  without a core, go. The members of the others that hang together form zones;
  those outside a zone's largest component are compared with all of the zone on
  full sets, block by block of like size, and pass on one link for two
  components. Each member of the largest component is read once for each block
  of the others, so rows grow with the others in it, not with the zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, forget, fresh, ship
from .workers import give_back

WORDS = 5
#: Similarity in hundredths.
LIKE = 75
SKETCH = 64
#: Of 64 union values, how many must be shared: at similarity 0.75, fewer have odds of 1e-7.
CLOSE = 28
INDEX, SHARED = 32, 11
#: Leader rounds, and the leaders that a class is compared with in each: those it shares most lists with.
ROUNDS, LEADERS = 2, 2
#: Members of a list outside its largest component that meet all members at once.
SHORT = 16
#: Members of a block, and the shingles of their sets; a larger set is a block of its own.
BLOCK, BLOCK_SHINGLES = 2_000, 1_000_000
#: Words whose hashes a worker keeps for a partition, and characters of text that are taken at once (one text at least).
KEPT_WORDS, SLICE_CHARS = 150_000, 4_000_000
#: Bits of the filter that keeps most texts from being looked at again: some sixteen for each wanted text, at most so many (4 MB).
MOST_BITS = 2**25

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > KEPT_WORDS:
                self.clear()
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """The distinct shingles as sorted signed hashes. With fewer than five words the whole sequence is one; without words, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    if n < WORDS:
        total = np.array([n], dtype=np.uint64) + (w * _M[:n]).sum(keepdims=True)
    else:
        m = n - WORDS + 1
        total = w[:m] * _M[0]
        for k in range(1, WORDS):
            total += w[k : k + m] * _M[k]
    x = np.sort(_mixed(total).view(np.int64))
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _list_array(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64), type=pa.int64()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, a few hundred or SLICE_CHARS of text at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            end = min(start + 512, max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, "right"))))
            yield batch.slice(start, end - start)
            start = end


def _named(sets: list[np.ndarray]) -> list[pa.Array]:
    """n, low, high: the sizes of sets and two hashes of each."""
    low = [int(x.view(np.uint64).sum()) & (2**64 - 1) for x in sets]
    high = [int(np.bitwise_xor.reduce(_mixed(x.view(np.uint64) + np.uint64(1)))) if len(x) else 0 for x in sets]
    return [pa.array([len(x) for x in sets], type=pa.int64()), pa.array(np.array(low, dtype=np.uint64).view(np.int64)), pa.array(np.array(high, dtype=np.uint64).view(np.int64))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for part in _slices(batches):
        sets = [shingle_set(t.as_py(), hashes) for t in part["text"]]
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["tx"], *_named(sets), _list_array([x[:SKETCH] for x in sets])], names=["doc_id", "tx", "n", "low", "high", "sketch"])
    hashes.clear()
    give_back()


def sketch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tx (hash of the text), n (size of the set), cls (hash of the set, null for an empty one) and sketch, for each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tx"), "text")
    made = rows.mapInArrow(_sketches, "doc_id long, tx long, n long, low long, high long, sketch array<long>")
    return made.select("doc_id", "tx", "n", F.when(F.col("n") > 0, F.xxhash64("low", "high", "n")).alias("cls"), "sketch")


def marked(keys: DataFrame) -> np.ndarray:
    """A filter of ``keys`` (key long): the bit of each one's remainder is set, in words of 64. What comes to the driver is at most the filter itself."""
    bits = min(MOST_BITS, max(1024, 1 << (16 * keys.count()).bit_length()))
    place = keys.select(F.pmod("key", F.lit(bits)).alias("at"))
    words = place.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("set")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _sets(marks: np.ndarray):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for part in _slices(batches):
            at = part["key"].to_numpy().view(np.uint64) & np.uint64(64 * len(marks) - 1)
            first: dict[int, int] = {}
            for i in np.flatnonzero(marks[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).tolist():
                first.setdefault(part["key"][i].as_py(), i)
            sets = [shingle_set(part["text"][i].as_py(), hashes) for i in first.values()]
            yield pa.RecordBatch.from_arrays([*_named(sets), _list_array(sets)], names=["n", "low", "high", "shingles"])
        hashes.clear()
        give_back()

    return sets_of


def class_sets(docs: DataFrame, known: DataFrame) -> DataFrame:
    """cls, shingles: the full set of each class of ``known`` (cls, first: hash and id of one text), cut from the lineage.

    Texts stay where they are read and aren't shuffled: workers look at those that
    pass a filter of the wanted ones' hashes and name their sets as at first;
    sets of the few others that pass it too have names that aren't known.
    """
    marks = marked(known.select(F.xxhash64("first.tx", "first.doc_id").alias("key")))
    texts = docs.select(F.xxhash64(F.xxhash64("text"), F.col("doc_id").cast("long")).alias("key"), "text")
    made = texts.mapInArrow(_sets(marks), "n long, low long, high long, shingles array<long>").select(F.xxhash64("low", "high", "n").alias("cls"), "shingles")
    return cut_lineage(made.groupBy("cls").agg(F.first("shingles").alias("shingles")).join(known.select("cls"), "cls", "left_semi"))


def index_rows(classes: DataFrame) -> DataFrame:
    """v, cls: the inverted lists, of each class its rarest index values that others have too."""
    values = classes.select("cls", F.least("n", F.lit(INDEX)).alias("size"), F.explode(F.slice("sketch", 1, INDEX)).alias("v"))
    # Written, so that the join below has two exchanges and adaptive execution can split a hot value.
    shared = cut_lineage(values.groupBy("v").agg(F.count("*").alias("often")).where("often > 1"))
    own = values.join(shared, "v").groupBy("cls", "size").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("own"))
    needed = F.ceil(F.col("size") * F.lit(SHARED / INDEX)).cast("int")
    places = F.col("size").cast("int") - needed + 1 - (F.col("size").cast("int") - F.size("own"))
    return own.select("cls", F.explode(F.slice("own", F.lit(1), F.greatest(places, F.lit(0)))).alias("x")).select(F.col("x.v").alias("v"), "cls")


def close(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Whether the union's sketch leaves similarity 0.75 possible; sizes are checked first."""
    sizes = (100 * F.least(na, nb) >= LIKE * F.greatest(na, nb))
    both = F.array_intersect(a, b)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    # The union's k smallest values are all known: each set's k smallest are.
    in_both = F.when(F.size(both) == 0, 0).otherwise(F.size(F.array_intersect(union, both)))
    return sizes & (in_both * SKETCH >= CLOSE * F.size(union))


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links: 100 * intersection >= 75 * union of the full sets."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(close(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")
    full = near.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("fa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("fb")), "b")
    common = full.withColumn("common", F.size(F.array_intersect("fa", "fb")))
    return common.where(100 * F.col("common") >= LIKE * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """cls, comp: the components after more edges, each named by its smallest label so far.

    Every round hooks a label below the smallest label next to it and shortens
    the chains, until no edge joins two labels; rounds grow with the logarithm
    of a component's size. ``edges`` (a, b) and ``labels`` are cut from their lineage.
    """
    while True:
        ends = edges.join(labels.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b")
        cross = cut_lineage(ends.where("ca <> cb").select("ca", "cb").distinct())
        if cross.isEmpty():
            forget(cross)
            return labels
        both = cross.select(F.greatest("ca", "cb").alias("comp"), F.least("ca", "cb").alias("to"))
        hooks = both.groupBy("comp").agg(F.min("to").alias("to"))
        hooked = labels.join(hooks, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))
        # Three steps down the chain of hooks at once.
        for _ in range(3):
            step = hooks.select(F.col("comp").alias("at"), F.col("to").alias("down"))
            hooked = hooked.join(step, F.col("comp") == F.col("at"), "left").select("cls", F.coalesce("down", "comp").alias("comp"))
        before, labels = labels, cut_lineage(hooked)
        forget(before, cross)


def leader_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """Each member of a list with the list's leader, for the leaders that a class meets most often.

    In the first turn the leader is the member whose lists are longest taken
    together: of a group of near-duplicates the one that has most of what all
    have. In later turns it is a random one.
    """
    if turn == 0:
        central = lists.groupBy("cls").agg(F.sum("g").alias("_c"))
        ranked = lists.join(central, "cls").withColumn("h", -F.col("_c"))
    else:
        ranked = lists.withColumn("h", F.xxhash64("cls", "v", F.lit(turn)))
    leader = ranked.groupBy("v").agg(F.min(F.struct("h", F.col("cls").alias("leader"), F.col("comp").alias("lcomp"))).alias("m"))
    # Written, so that adaptive execution can split a long list in the join.
    met = lists.join(cut_lineage(leader.select("v", "m.leader", "m.lcomp")), "v").where("comp <> lcomp").groupBy("cls", "leader").agg(F.count("*").alias("times"))
    top = met.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "leader")), asc=False), 1, LEADERS).alias("top"))
    each = top.select("cls", F.explode("top.leader").alias("leader"))
    return each.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()


def largest(named: DataFrame) -> DataFrame:
    """v, main (the list's largest component), outside (members in others); named: v, comp and more. Counts are summed before the shuffle."""
    each = named.groupBy("v", "comp").agg(F.count("*").alias("held"))
    return each.groupBy("v").agg(F.max(F.struct("held", "comp")).alias("top"), F.sum("held").alias("all")).select("v", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.held")).alias("outside"))


def outsider_pairs(named: DataFrame) -> DataFrame:
    """Pairs of different components in lists with at most SHORT members outside the largest component (named: v, cls, comp, main, outside)."""
    few = named.where(F.col("outside") <= SHORT)
    out = few.where("comp <> main").select("v", F.col("cls").alias("b"), F.col("comp").alias("cb"))
    met = few.select("v", F.col("cls").alias("a"), F.col("comp").alias("ca")).join(out, "v").where("ca <> cb")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def full_lists(members: DataFrame, sets: DataFrame, like: int = LIKE) -> DataFrame:
    """v, cls, n, p: of each set the rarest shingles that other members have too, p being the place from the rarest: a quarter of all, or what ``like`` leaves.

    Shingles that no other member has are the rarest, so they use up places.
    Two sets share no shingle before the first shared one: they share at most
    n - p of either.
    """
    held = members.join(sets, "cls").select("cls", "n", F.explode("shingles").alias("v"))
    shared = cut_lineage(held.groupBy("v").agg(F.count("*").alias("often")).where("often > 1"))
    own = held.join(shared, "v").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("own"))
    alone = (F.col("n") - F.size("own")).cast("int")
    places = F.floor(F.col("n") * F.lit(100 - like) / F.lit(100)).cast("int") + 1
    each = own.select("cls", "n", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), F.greatest(places - alone, F.lit(0)))).alias("at", "x"))
    out = cut_lineage(each.select(F.col("x.v").alias("v"), "cls", "n", (F.col("alone") + F.col("at")).cast("long").alias("p")))
    forget(shared)
    return out


def zones(lists: DataFrame, labels: DataFrame, like: int = LIKE) -> DataFrame:
    """cls, n, comp, zone of the members of full lists that can hold links: those that hang together by such lists have one zone.

    Of a link the smaller set shares 2 * like parts in 100 + like at least, so it has at most the rest before the first shared shingle.
    """
    named = lists.join(labels, "cls")
    cores = named.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max((100 + like) * F.col("p") <= (100 - like) * F.col("n")).alias("core"), F.min("cls").alias("head"))
    still = cut_lineage(cores.where("core AND x <> y").select("v", "head"))
    left = cut_lineage(named.join(still, "v").select("cls", "n", "comp", "head").distinct())
    members = cut_lineage(left.select("cls", F.col("cls").alias("comp")).distinct())
    found = connected(left.select(F.col("cls").alias("a"), F.col("head").alias("b")), members)
    out = cut_lineage(left.select("cls", "n", "comp").distinct().join(found.select("cls", F.col("comp").alias("zone")), "cls"))
    forget(still, left, found)
    return out


def blocked(members: DataFrame, like: int = LIKE) -> DataFrame:
    """cls, n, comp, lo, hi: each member once for each pair of blocks that its block is in, from ``zones``.

    Blocks hold members of one zone whose sizes are within a factor of 4/3 (100 / ``like``), of
    the zone's largest component or of others. Sizes of links lie in the same or
    the next band, and of two blocks of the largest component nothing is sought.
    """
    main = members.groupBy("zone", "comp").agg(F.count("*").alias("held")).groupBy("zone").agg(F.max(F.struct("held", "comp")).alias("top")).select("zone", F.col("top.comp").alias("main"))
    banded = members.join(main, "zone").select("cls", "n", "comp", "zone", F.floor(F.log("n") / F.log(F.lit(100 / like))).cast("int").alias("band"), (F.col("comp") == F.col("main")).alias("inside"))
    sized = banded.groupBy("zone", "band", "inside").agg(F.count("*").alias("held"), F.sum("n").alias("shingles"))
    many = cut_lineage(sized.select("zone", "band", "inside", F.ceil(F.greatest(F.col("held") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")))
    block = lambda i: F.struct("band", "inside", i.alias("i"))
    own = banded.join(many, ["zone", "band", "inside"]).select("cls", "n", "comp", "zone", block(F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("own"))
    each = many.select("zone", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), block)).alias("b"))
    # One row for each pair of blocks: a few, squared, of each zone; blocks are bounded below by BLOCK or BLOCK_SHINGLES.
    pairs = each.join(each.withColumnRenamed("b", "c"), "zone").where("b <= c AND c.band - b.band <= 1 AND NOT (b.inside AND c.inside)")
    near = each.join(each.withColumnRenamed("b", "c"), "zone").where("c < b AND b.band - c.band <= 1 AND NOT (b.inside AND c.inside)")
    meets = cut_lineage(pairs.select("zone", F.col("b").alias("own"), F.struct("zone", "b").alias("lo"), F.struct("zone", F.col("c").alias("b")).alias("hi")).unionByName(near.select("zone", F.col("b").alias("own"), F.struct("zone", F.col("c").alias("b")).alias("lo"), F.struct("zone", "b").alias("hi"))))
    return own.join(meets, ["zone", "own"]).select("cls", "n", "comp", F.xxhash64("zone", "own").alias("block"), F.xxhash64("lo").alias("lo"), F.xxhash64("hi").alias("hi"), (F.struct("zone", F.col("own").alias("b")) == F.col("lo")).alias("left"), (F.col("lo") == F.col("hi")).alias("same"))


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks, one link for each two components that have any.

    Intersections are counted by going through the shingles that both blocks
    have; the count is a matrix of about BLOCK by BLOCK.
    """
    same = bool(rows["same"].iloc[0])
    one = rows if same else rows[rows["left"]]
    two = rows if same else rows[~rows["left"]]
    if not len(one) or not len(two):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")

    def postings(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, owners = np.concatenate([*part["shingles"]]), np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part["shingles"]])
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        return values[starts], np.append(starts, len(values)), owners

    (va, sa, oa), (vb, sb, ob) = (x := postings(one)), x if same else postings(two)
    common = np.zeros((len(one), len(two)), dtype=np.int32)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if same:  # a shingle that one member alone has counts for nothing
        often = np.diff(sa)[ia] > 1
        ia, ib = ia[often], ib[often]
    for i, j in zip(ia.tolist(), ib.tolist()):
        common[np.ix_(oa[sa[i] : sa[i + 1]], ob[sb[j] : sb[j + 1]])] += 1
    na, nb = one["n"].to_numpy()[:, None], two["n"].to_numpy()[None, :]
    ca, cb = one["comp"].to_numpy(), two["comp"].to_numpy()
    ok = (100 * common.astype(np.int64) >= LIKE * (na + nb - common)) & (ca[:, None] != cb[None, :])
    i, j = np.nonzero(ok)
    found = pd.DataFrame({"a": one["cls"].to_numpy()[i], "b": two["cls"].to_numpy()[j], "x": np.minimum(ca[i], cb[j]), "y": np.maximum(ca[i], cb[j])})
    return found.drop_duplicates(["x", "y"])[["a", "b"]].astype("int64")


def full_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, of ``members`` (cls, n), whatever they share; cut from the lineage."""
    lists = full_lists(members, sets)
    held = zones(lists, labels)
    forget(lists)
    rows = blocked(held).join(sets, "cls")
    out = cut_lineage(rows.groupBy("lo", "hi").applyInPandas(_links, "a long, b long"))
    forget(held)
    return out


def components(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """cls, comp, component_id for every class of equal sets, cut from the lineage; ``rows``: sketch_rows of ``docs``, cut likewise.

    comp names the component and is never null; component_id is its smallest doc_id, null where all are.
    """
    first = F.min(F.struct("tx", "doc_id")).alias("first")
    classes = cut_lineage(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("smallest"), first))
    every = cut_lineage(index_rows(classes))
    live = cut_lineage(every.groupBy("v").agg(F.count("*").alias("g")).where("g > 1"))
    lists = cut_lineage(every.join(live, "v"))
    members = lists.select("cls").distinct()
    known = cut_lineage(classes.join(members, "cls").select("cls", "n", "sketch", "first"))
    # Full sets of the classes that have a list in common with another one, from one text each.
    sets = class_sets(docs, known)
    forget(every, live)
    labels = cut_lineage(known.select("cls", F.col("cls").alias("comp")))
    for turn in range(ROUNDS):
        named = open_lists(lists, labels)
        new = cut_lineage(confirmed(leader_pairs(named, turn), known, sets))
        labels = connected(new, labels)
        forget(named, new)
    named = open_lists(lists, labels)
    forget(lists)
    placed = cut_lineage(named.join(cut_lineage(largest(named)), "v"))
    new = cut_lineage(confirmed(outsider_pairs(placed), known, sets))
    labels = connected(new, labels)
    hot = placed.where(F.col("outside") > SHORT).select("cls").distinct()
    if not hot.isEmpty():
        links = full_links(known.join(hot, "cls").select("cls", "n"), labels, sets)
        labels = connected(links, labels)
        forget(links)
    named_classes = classes.select("cls", "smallest").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    ids = named_classes.groupBy("comp").agg(F.min("smallest").alias("component_id"))
    out = cut_lineage(named_classes.join(ids, "comp").select("cls", "comp", "component_id"))
    forget(classes, known, sets, labels, named, placed, new)
    return out


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists (v, cls, g, comp) that hold more than one component."""
    named = lists.join(labels, "cls")
    still = cut_lineage(named.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("v"))
    out = cut_lineage(named.join(still, "v"))
    forget(still)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns may have any name and aren't used).

    Null and blank texts have empty sets, link with nothing and are kept under
    their own id. Repeated rows and equal texts are one component; ties have no
    bearing on the result. Where all ids of a component are null its id is null,
    and its rows count as kept. Texts of any length count whole. An empty table
    gives an empty result.
    """
    rows = cut_lineage(sketch_rows(docs))
    named = rows.select("doc_id", "n", "cls").join(components(docs, rows), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id; all columns stay, whatever their names.

    Rows with an empty set (null or blank text) all stay. Of a group's rows that
    share the smallest id the one with the smallest text hash stays, one of
    these if that text is repeated; where all ids are null any id will do. Texts
    of any length count whole. An empty table gives an empty result.
    """
    rows = cut_lineage(sketch_rows(docs))
    named = rows.where("cls IS NOT NULL").select("doc_id", "tx", "cls").join(components(docs, rows), "cls")
    least = named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp", "component_id").agg(F.min("tx").alias("tx"))
    # Two groups may want the same row only if id and text are equal, and then they are one group. Rows with this id and text are counted.
    kid, ktx, again, tx, hit = fresh(docs, "kept_id", "kept_tx", "again", "text_hash", "hit")
    copies = rows.where("cls IS NOT NULL").groupBy("doc_id", "tx").agg((F.count("*") > 1).alias(again)).where(again)
    stay = least.select(F.col("component_id").alias(kid), F.col("tx").alias(ktx))
    stay = cut_lineage(stay.join(copies, stay[kid].eqNullSafe(copies["doc_id"]) & (stay[ktx] == copies["tx"]), "left").select(kid, ktx, F.coalesce(again, F.lit(False)).alias(again)))
    keyed = docs.withColumn(tx, F.xxhash64("text"))
    empty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    held = keyed.where(~empty).join(stay, keyed["doc_id"].cast("long").eqNullSafe(stay[kid]) & (keyed[tx] == stay[ktx]))
    out = held.where(~F.col(again)).select(docs.columns).unionByName(keyed.where(empty).select(docs.columns))
    if not stay.where(again).isEmpty():
        # Of repeated rows one each, taken before the shuffle and once more after it.
        one = held.where(again).groupBy(kid, ktx).agg(F.first(F.struct(*docs.columns)).alias(hit))
        out = out.unionByName(one.select(f"{hit}.*"))
    forget(rows)
    return out
