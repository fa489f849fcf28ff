"""Op 12, n-gram Jaccard join: prefix trees of globally ordered shingle sets.

Sets that are joined in one task get one order of all their shingles, the most
frequent first, and stand in a trie by it: sets that are alike have long paths
in common. A set is joined by going down the trie with the overlap so far, which
is counted once for all sets below an edge; a subtree is left where the overlap
and what remains of either side cannot reach the wanted similarity, or where all
that is below hangs together with the probing set already.

What is joined where follows from exact bounds, so no link is lost:

* In the order of the hashes, two sets that link share ``more(n)`` of their first
  ``head(n)`` shingles (prefix filter). Of these heads, in the order of how often
  they occur, the rarest ones but ``more(n) - 1`` must hold a common one. Shingles
  that nobody else has use up these places, so documents that have but some
  passages in common with others don't meet. Classes of equal sets count once.
* Lists of classes by such a shingle are not expanded. First every class is
  joined with the leader that it meets most often, in tries of a leader's
  classes; what links becomes one component, and lists of one component go. Where
  more than SHORT members of a list are still outside its largest component,
  further leaders follow.
* What is left gets lists of full sets and zones (see near_dedup), whose members
  outside the largest component meet the zone block by block, trie by trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, forget, give_back_disk, ship
from .near_dedup import SHORT, _list_array, _named, _slices, _WordHashes, blocked, class_sets, connected, full_lists, largest, open_lists, shingle_set, zones
from .workers import give_back

#: Similarity in hundredths.
LIKE = 80
#: Leader rounds, and the leaders that a class is joined with in each.
ROUNDS, LEADERS = 3, 1
#: Sets and shingles that are joined in one task, on average.
SETS, SHINGLES = 2_000, 1_000_000


def least(n: int) -> int:
    """How many shingles a set of ``n`` shares with any that it links with."""
    return -(-LIKE * n // 100)


def head(n: int) -> int:
    """How many of a set's first shingles are looked at."""
    return n - least(n) + 1 + n // 10


def more(n: int) -> int:
    """How many of its head a set shares with the head of any that it links with: the smallest such set has least(n) shingles."""
    return 1 + least(n) // 10


def _column(f, n: Column) -> Column:
    """``head`` or ``more`` over a column."""
    low = F.ceil(LIKE * n / 100).cast("long")
    tenth = lambda x: F.floor(x / 10).cast("long")
    return n - low + 1 + tenth(n) if f is head else 1 + tenth(low)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for part in _slices(batches):
        sets = [shingle_set(t.as_py(), hashes) for t in part["text"]]
        columns = [part["doc_id"], part["tx"], *_named(sets), _list_array([x[: head(len(x))] for x in sets])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tx", "n", "low", "high", "head"])
    hashes.clear()
    give_back()


def head_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tx (hash of the text), n (size of the set), cls (hash of the set, null for an empty one), head: for each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tx"), "text")
    made = rows.mapInArrow(_heads, "doc_id long, tx long, n long, low long, high long, head array<long>")
    return made.select("doc_id", "tx", "n", F.when(F.col("n") > 0, F.xxhash64("low", "high", "n")).alias("cls"), "head")


def head_lists(classes: DataFrame) -> DataFrame:
    """v, cls, n, h: of each class (cls, n, head) the rarest shingles of its head, as many as must hold one in common with any class that it links with; lists of one class are left out. h: how many shingles of the head others have."""
    values = classes.select("cls", "n", F.explode("head").alias("v"))
    shared = cut_lineage(values.groupBy("v").agg(F.count("*").alias("often")).where("often > 1"))
    give_back_disk(classes.sparkSession)
    # Written, so that the values' shuffle is over before the classes' one begins.
    held = cut_lineage(values.join(shared, "v"))
    forget(shared)
    give_back_disk(classes.sparkSession)
    own = held.groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("own"))
    alone = _column(head, F.col("n")) - F.size("own")
    places = (_column(head, F.col("n")) - _column(more, F.col("n")) + 1 - alone).cast("int")
    rarest = F.explode(F.slice("own", F.lit(1), F.greatest(places, F.lit(0)))).alias("x")
    every = cut_lineage(own.select("cls", "n", F.size("own").alias("h"), rarest).select(F.col("x.v").alias("v"), "cls", "n", "h"))
    forget(held)
    give_back_disk(classes.sparkSession)
    live = cut_lineage(every.groupBy("v").agg(F.count("*").alias("g")).where("g > 1").select("v"))
    out = cut_lineage(every.join(live, "v"))
    forget(every, live)
    return out


class Trie:
    """Sets of ranks in ascending order, equal beginnings stored once.

    A node has an edge (a slice of a set that goes through it) and knows of the
    sets below: the most ranks that one has behind the edge, the smallest size
    of a whole set, and their component where it is one.
    """

    def __init__(self, ranks: list[np.ndarray], sizes: list[int], comps: list[int]):
        order = sorted(range(len(ranks)), key=lambda i: ranks[i].astype(">u4").tobytes())
        self.edge: list[np.ndarray] = [ranks[0][:0]] if ranks else []
        self.children: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        path, depths = [0], [0]  # the nodes down to the last set, and how many ranks lie up to each node's end
        last = np.zeros(0, dtype=np.int64)
        for i in order:
            own = ranks[i]
            m = min(len(last), len(own))
            differ = np.flatnonzero(last[:m] != own[:m])
            same = int(differ[0]) if len(differ) else m
            below = None
            while depths[-1] > same:
                below = path.pop()
                depths.pop()
            if below is not None and depths[-1] < same:
                # The common part ends within an edge: it is cut in two.
                cut, parent = same - depths[-1], path[-1]
                middle = self._node(self.edge[below][:cut])
                self.edge[below] = self.edge[below][cut:]
                self.children[parent][-1] = middle
                self.children[middle].append(below)
                path.append(middle)
                depths.append(same)
            if len(own) > depths[-1]:
                leaf = self._node(own[depths[-1] :])
                self.children[path[-1]].append(leaf)
                path.append(leaf)
                depths.append(len(own))
            self.ends[path[-1]].append(i)
            last = own
        self._summarise(sizes, comps)

    def _node(self, edge: np.ndarray) -> int:
        self.edge.append(edge)
        self.children.append([])
        self.ends.append([])
        return len(self.edge) - 1

    def _summarise(self, sizes: list[int], comps: list[int]) -> None:
        n = len(self.edge)
        self.rest, self.smallest, self.comp = [0] * n, [0] * n, [None] * n
        down, at = [], [0] if n else []
        while at:
            down.append(node := at.pop())
            at += self.children[node]
        for node in reversed(down):
            below = self.children[node]
            self.rest[node] = max((len(self.edge[c]) + self.rest[c] for c in below), default=0)
            self.smallest[node] = min([self.smallest[c] for c in below] + [sizes[i] for i in self.ends[node]])
            kinds = {self.comp[c] for c in below} | {comps[i] for i in self.ends[node]}
            self.comp[node] = kinds.pop() if len(kinds) == 1 else None

    def matches(self, own: np.ndarray, size: int, n_ranks: int, joined) -> Iterator[int]:
        """The stored sets that link with a set of ranks ``own`` and ``size`` shingles in all. ``joined(comp)``: whether a component needs no further link."""
        has = np.zeros(n_ranks, dtype=bool)
        has[own] = True
        stack = [(0, 0)] if self.edge else []
        while stack:
            node, overlap = stack.pop()
            if self.comp[node] is not None and joined(self.comp[node]):
                continue
            if len(edge := self.edge[node]):
                overlap += int(np.count_nonzero(has[edge]))
                left = len(own) - int(np.searchsorted(own, edge[-1], "right"))
            else:
                left = len(own)
            # overlap >= LIKE / (100 + LIKE) of both sizes together
            if (100 + LIKE) * (overlap + min(left, self.rest[node])) < LIKE * (size + self.smallest[node]) and not (self.ends[node] and (100 + LIKE) * overlap >= LIKE * (size + self.smallest[node])):
                continue
            for i in self.ends[node]:
                yield i, overlap
            stack += [(c, overlap) for c in self.children[node]]


def joined_sets(sets: list[np.ndarray], sizes: list[int], comps: list[int], probes: list[int], stored: list[int]) -> list[tuple[int, int]]:
    """Pairs (probe, stored) of numbers that link, as many as connect what such pairs connect; sets of one component aren't compared."""
    values, places, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # One order for all: the most frequent first. Shingles of one set overlap with nothing.
    rank = np.full(len(values), -1, dtype=np.int64)
    common = np.flatnonzero(times > 1)
    rank[common[np.argsort(-times[common], kind="stable")]] = np.arange(len(common))
    cuts = np.cumsum([len(x) for x in sets])[:-1]
    ranks = [np.sort(r[r >= 0]) for r in np.split(rank[places], cuts)]
    parent: dict[int, int] = {c: c for c in comps}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    trie = Trie([ranks[i] for i in stored], [sizes[i] for i in stored], [comps[i] for i in stored])
    out = []
    for p in probes:
        for k, overlap in trie.matches(ranks[p], sizes[p], len(common), lambda c, p=p: find(c) == find(comps[p])):
            s = stored[k]
            if (100 + LIKE) * overlap >= LIKE * (sizes[p] + sizes[s]) and find(comps[p]) != find(comps[s]):
                parent[find(comps[s])] = find(comps[p])
                out.append((p, s))
    return out


def _links_of(rows: pd.DataFrame, probes: np.ndarray, stored: np.ndarray) -> list[tuple[int, int]]:
    cls = rows["cls"].tolist()
    pairs = joined_sets(rows["shingles"].tolist(), rows["n"].tolist(), rows["comp"].tolist(), probes.tolist(), stored.tolist())
    return [(min(cls[a], cls[b]), max(cls[a], cls[b])) for a, b in pairs]


def _by_leader(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups of a leader and its classes, several in a task: the leader goes down the trie of its classes."""
    out = []
    for _, part in rows.groupby(["leader", "chunk"], sort=False):
        leads = part["leads"].to_numpy()
        if leads.any() and not leads.all():
            out += _links_of(part, np.flatnonzero(leads), np.flatnonzero(~leads))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _by_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Two blocks, or one with itself: the sets of the smaller one go down the trie of the other."""
    left = rows["left"].to_numpy()
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    if rows["same"].iloc[0]:
        one = two = np.arange(len(rows))
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    out = _links_of(rows, small, large) if len(small) else []
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def leaders(lists: DataFrame, turn: int) -> DataFrame:
    """cls, leader: the leaders of other components that each class meets in most lists, of a size that lets them link.

    A list is led by the class whose head others share most of, in later rounds
    by a random one. ``lists``: v, cls, n, h, comp.
    """
    ranked = lists.withColumn("h", F.xxhash64("cls", "v", F.lit(turn))) if turn else lists
    first = ranked.groupBy("v").agg(F.max(F.struct("h", F.col("cls").alias("leader"), F.col("comp").alias("lcomp"), F.col("n").alias("ln"))).alias("m"))
    # Written, so that adaptive execution can split a long list in the join.
    led = cut_lineage(first.select("v", "m.leader", "m.lcomp", "m.ln"))
    fits = 100 * F.least("n", "ln") >= LIKE * F.greatest("n", "ln")
    met = lists.join(led, "v").where((F.col("comp") != F.col("lcomp")) & fits).groupBy("cls", "leader").agg(F.count("*").alias("times"))
    top = met.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "leader")), asc=False), 1, LEADERS).alias("top"))
    return top.select("cls", F.explode("top.leader").alias("leader"))


def leader_links(pairs: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes and their leaders (cls, leader); known: cls, n, comp. Cut from the lineage."""
    pairs = cut_lineage(pairs)
    sized = pairs.join(known.select("cls", "n"), "cls").groupBy("leader").agg(F.count("*").alias("held"), F.sum("n").alias("shingles"))
    chunks = F.ceil(F.greatest(F.col("held") / SETS, F.col("shingles") / SHINGLES))
    many = cut_lineage(sized.select("leader", "held", "shingles", chunks.alias("chunks")))
    total = many.agg(F.sum(F.greatest(F.col("held") / SETS, F.col("shingles") / SHINGLES))).first()[0] or 0
    # Tasks hold as many small groups as make a full one; a large group has chunks of its own.
    tasks = F.lit(max(1, int(total * 4)))
    members = pairs.join(many.select("leader", "chunks"), "leader").select("leader", F.pmod(F.xxhash64("cls"), "chunks").alias("chunk"), "cls", F.lit(False).alias("leads"))
    heads = many.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("leader").alias("cls"), F.lit(True).alias("leads"))
    rows = members.unionByName(heads).join(known, "cls").join(sets, "cls")
    out = cut_lineage(rows.groupBy(F.pmod(F.xxhash64("leader", "chunk"), tasks).alias("task")).applyInPandas(_by_leader, "a long, b long"))
    forget(pairs, many)
    return out


def zone_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of ``members`` (cls, n), whatever they share, from tries of blocks of full sets; cut from the lineage."""
    lists = full_lists(members, sets, LIKE)
    give_back_disk(members.sparkSession)
    held = zones(lists, labels, LIKE)
    forget(lists)
    rows = blocked(held, LIKE).join(sets, "cls")
    out = cut_lineage(rows.groupBy("lo", "hi").applyInPandas(_by_block, "a long, b long"))
    forget(held)
    return out


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; other columns may have any name and aren't used).

    Null and blank texts have empty sets and link with nothing: their component
    is their own id. Repeated rows and equal texts are one component; ties have
    no bearing on the result. Where all ids of a component are null its id is
    null. Texts of any length count whole. An empty table gives an empty result.
    """
    made = cut_lineage(head_rows(docs))
    rows = cut_lineage(made.select("doc_id", "tx", "n", "cls"))
    first = F.min(F.struct("tx", "doc_id")).alias("first")
    classes = cut_lineage(made.where("cls IS NOT NULL").groupBy("cls").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.min("doc_id").alias("smallest"), first))
    forget(made)
    give_back_disk(docs.sparkSession)
    lists = head_lists(classes)
    # From here on without the heads.
    whole, classes = classes, cut_lineage(classes.drop("head"))
    forget(whole)
    give_back_disk(docs.sparkSession)
    members = lists.select("cls").distinct()
    known = cut_lineage(classes.select("cls", "n", "first").join(members, "cls"))
    sets = class_sets(docs, known)
    give_back_disk(docs.sparkSession)
    labels = cut_lineage(known.select("cls", F.col("cls").alias("comp")))
    for turn in range(ROUNDS):
        if turn == 0:
            named = lists.withColumn("comp", F.col("cls"))
        else:
            # Lists of one component stay so. Further leaders only where many are still outside a list's largest component.
            every = open_lists(lists, labels)
            forget(lists)
            lists = every.drop("comp")
            lists._moorage_path = every._moorage_path
            named = cut_lineage(every.join(largest(every).where(F.col("outside") > SHORT).select("v"), "v"))
            if named.isEmpty():
                forget(named)
                break
        links = leader_links(leaders(named, turn), known.select("cls", "n").join(labels, "cls"), sets)
        labels = connected(links, labels)
        forget(named, links)
    named = open_lists(lists, labels)
    left = cut_lineage(named.select("cls", "n").distinct())
    if not left.isEmpty():
        links = zone_links(left, labels, sets)
        labels = connected(links, labels)
        forget(links)
    every = classes.select("cls", "smallest").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    ids = every.groupBy("comp").agg(F.min("smallest").alias("component_id"))
    out = cut_lineage(every.join(ids, "comp").select("cls", "component_id"))
    forget(classes, lists, known, sets, labels, named, left)
    told = rows.join(out, "cls", "left")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
