"""What the operators' Python workers have in common."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns this worker's free memory to the system: workers outlive their partitions, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
