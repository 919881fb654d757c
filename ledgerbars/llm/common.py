"""What the operators share: reading, batches and tables of Python workers. What is of use without texts is in operators/scale.py."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import buckets_for, components, cut, join_back, prefix_sum, release, same, shared_folder

#: The characters that separate words, as in ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of texts that go to a Python worker at a time; Spark's own 64 MB are held several times by the JVM and the worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, as texts differ in size a thousandfold; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give memory that Python has freed back to the system, where its library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Of a Python worker: the tables that one operator keeps there between tasks.
HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker for its next tasks; only the last name's is kept, so
    that the tables of operators that run one after the other do not add up."""
    if name not in HELD:
        HELD.clear()
        trim()
        HELD[name] = make()
        trim()
    return HELD[name]


def quoted(name: str) -> Column:
    """A column by its whole name, which may hold dots and backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


__all__ = ["SPACES", "WORD", "buckets_for", "components", "cut", "held", "join_back", "prefix_sum", "quoted", "release", "same", "shared_folder", "small_batches", "table", "trim"]
