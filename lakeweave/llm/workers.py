"""Run Arrow functions of this package on executors that may not have it installed.

Workers are used again by later stages. A worker keeps the caches (tokenizer states, tables) of one operator at a time:
when a task of another operator starts in it, the earlier one's caches are dropped and their memory is given back.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

_holder = [""]
_releases: dict[str, Callable[[], None]] = {}


def on_release(owner: str, release: Callable[[], None]) -> None:
    """Name what drops the caches of a module."""
    _releases[owner] = release


def _claim(owner: str) -> None:
    if _holder[0] == owner:
        return
    for name, release in _releases.items():
        if name != owner:
            release()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass
    _holder[0] = owner


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, owner: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema), with the code of `run` at hand on the workers."""
    ship(df.sparkSession)
    owner = owner or run.__module__

    def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _claim(owner)
        yield from run(batches)

    return df.mapInArrow(claimed, schema)
