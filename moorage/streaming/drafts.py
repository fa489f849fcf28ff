"""Drafts, patches and issues as they arrive (A16, A17, P03 on streams).

State is kept by draft and path (patches) or by draft and issue, so it is spread
over the cluster however many drafts there are; it goes when a draft has been
quiet for ``expiry``. Results don't hang on how rows are dealt to batches: of a
path the patch of the largest order counts, of equal issues the one of the
smallest, whenever they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PATCHES = "draft_id string, path string, ord long, value string"
ISSUES = "draft_id string, path string, type string, detail string, ord long, severity string"


def _newer(row: tuple, held: tuple) -> bool:
    """By order; of equal ones by value, null first, so that it doesn't matter which came first."""
    return (row[0], row[1] is not None, row[1] or "") > (held[0], held[1] is not None, held[1] or "")


def _patched(expiry_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: Any = state.get if state.exists else None
        before = held
        for batch in batches:
            for row in zip(batch["ord"].tolist(), [None if pd.isna(v) else v for v in batch["value"]]):
                if held is None or _newer(row, held):
                    held = row
        state.update(held)
        state.setTimeoutDuration(expiry_ms)
        if held != before:
            yield pd.DataFrame([(*key, *held)], columns=["draft_id", "path", "ord", "value"])

    return step


def patched_leaves(patches: DataFrame, expiry_ms: int = 86_400_000) -> DataFrame:
    """The leaves after the patches so far, as updates: draft_id, path, ord, value whenever a path gets another value.

    ``patches``: a stream of these columns, drafts' first values among them at
    order 0. A null value takes a leaf out and is passed on as such. A row older
    than what the state has changes nothing; after ``expiry_ms`` without rows a
    path's state is given up, and older rows would count again.
    """
    rows = patches.select("draft_id", "path", F.col("ord").cast("long").alias("ord"), "value")
    return rows.groupBy("draft_id", "path").applyInPandasWithState(_patched(expiry_ms), PATCHES, "ord long, value string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _first(expiry_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: Any = state.get if state.exists else None
        before = held
        for batch in batches:
            for row in zip(batch["ord"].tolist(), batch["severity"]):
                if held is None or row < held:
                    held = row
        state.update(held)
        state.setTimeoutDuration(expiry_ms)
        if held != before:
            yield pd.DataFrame([(*key, *held)], columns=["draft_id", "path", "type", "detail", "ord", "severity"])

    return step


def first_issues(issues: DataFrame, expiry_ms: int = 86_400_000) -> DataFrame:
    """Of equal issues (draft, path, type, detail) the first by order, as updates: a row whenever an earlier one comes."""
    rows = issues.select("draft_id", "path", "type", "detail", F.col("ord").cast("long").alias("ord"), "severity")
    return rows.groupBy("draft_id", "path", "type", "detail").applyInPandasWithState(_first(expiry_ms), ISSUES, "ord long, severity string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest(updates: DataFrame, keys: list[str], newest: bool) -> DataFrame:
    """A table of updates as it stands: of each key the row of the largest order (of patches) or the smallest (of issues); a written table may hold a batch twice after a restart."""
    rest = [c for c in updates.columns if c not in keys and c != "ord"]
    row = F.struct("ord", *rest)
    return updates.groupBy(*keys).agg((F.max(row) if newest else F.min(row)).alias("_r")).select(*keys, "_r.*")
