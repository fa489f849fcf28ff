"""Op 10, URL filters: a broadcast trie over reversed host labels and path segments.

Each rule is a host, a path prefix and a verdict. Hosts go into the trie label
by label from the right, so a rule covers its host and all subdomains; below
the host's node hang the path's segments, the last of which is matched as a
prefix. Of the rules on a URL's way the longest (characters of host and path)
wins, at equal length the one with the longer host, then ``block``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh, ship

#: host, path prefix, verdict. Fixed values of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The trie is broadcast up to this many characters of rules, about 60 bytes each in a worker; a longer list is taken in parts of this size.
PART_CHARS = 3_000_000


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Nodes: {"hosts": {label: node}, "paths": path node}; path nodes: {"next": {segment: node}, "ends": {prefix of a segment: rule}}."""
    root: dict = {"hosts": {}}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node["hosts"].setdefault(label, {"hosts": {}})
        at = node.setdefault("paths", {"next": {}, "ends": {}})
        *whole, last = path.split("/")
        for segment in whole:
            at = at["next"].setdefault(segment, {"next": {}, "ends": {}})
        held, new = at["ends"].get(last), (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
        at["ends"][last] = max(held, new) if held else new
    return root


def longest(trie: dict, host: str, path: str) -> tuple | None:
    """The winning rule (length, host's length, blocks, text, verdict) for a URL's host and path."""
    best, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node["hosts"].get(label)
        if node is None:
            break
        at = node.get("paths")
        for segment in segments:
            if at is None:
                break
            for prefix, rule in at["ends"].items() if len(at["ends"]) <= len(segment) else ((segment[:k], at["ends"].get(segment[:k])) for k in range(len(segment) + 1)):
                if rule and segment.startswith(prefix) and (best is None or rule > best):
                    best = rule
            at = at["next"].get(segment)
    return best


def parts(rules: Sequence[tuple[str, str, str]], chars: int) -> Iterator[list[tuple[str, str, str]]]:
    part, held = [], 0
    for rule in rules:
        if part and held + len(rule[0]) + len(rule[1]) > chars:
            yield part
            part, held = [], 0
        part.append(rule)
        held += len(rule[0]) + len(rule[1])
    yield part


def matcher(trie: Broadcast) -> Callable:
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        tree = trie.value
        rows = [longest(tree, h, p) or (None,) * 5 for h, p in zip(hosts, paths)]
        return pd.DataFrame(rows, columns=["size", "host", "blocks", "rule", "verdict"])

    return match


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES), default: str = "allow", url: str = "url", part_chars: int = PART_CHARS, prefix: str = "") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Columns of these names are replaced, all others stay; ``prefix`` gives the
    outputs other names.

    A null URL, or one without ``://``, has an empty host and path. A URL that
    no rule fits gets ``default`` and a null rule. The host is taken as it
    stands up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased: a port
    belongs to it. URLs of any length are judged whole. Repeated rows are judged alike; an empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    ship(spark)
    won, new = fresh(pages, "won", "new")
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    out = pages.withColumns({f"{prefix}host": host, f"{prefix}path": path}).withColumn(won, F.lit(None).cast("struct<size:int,host:int,blocks:boolean,rule:string,verdict:string>"))
    for part in parts(rules, part_chars):
        match = F.pandas_udf(matcher(spark.sparkContext.broadcast(build_trie(part))), "size int, host int, blocks boolean, rule string, verdict string")
        out = out.withColumn(new, match(f"{prefix}host", f"{prefix}path")).withColumn(won, F.when(F.col(f"{new}.size").isNull(), F.col(won)).when(F.col(f"{won}.size").isNull(), F.col(new)).otherwise(F.greatest(won, new))).drop(new)
    return out.withColumns({f"{prefix}rule": F.col(f"{won}.rule"), f"{prefix}verdict": F.coalesce(f"{won}.verdict", F.lit(default))}).drop(won)
