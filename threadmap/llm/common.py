"""What the operators of this subpackage share: the shared folder, saved tables, text helpers."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import save, table  # noqa: F401
from ..sources.tables import shared_path as scratch  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_TABLE = str.maketrans(UPPER, LOWER)
#: White space that separates words: space and 0x09 to 0x0D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path within it."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path or path
    return fs.FileSystem.from_uri(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else.

    ``lower`` is the fast way where all characters are ASCII; other texts go through
    ``translate``, since ``lower`` would also change letters outside ASCII.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes, at most, that Spark hands to Python at once within ``small_batches``.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 22


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs that are run within this hand so many rows and bytes to Python at once, so that neither side holds more.

    For rows of texts or sets: of the usual 10,000 both sides hold tens of MB in each task.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, str(v))
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


#: crc32 of doc_id as decimal text, as in the contracts.
def crc_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Keys with over one in so many rows go to all tasks when they are joined; there can't be more of them.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows and what keyed has for their key; keyed has each key once, and in count how many of the rows have it.

    Null keys are equal. Both are read twice, so they should be saved. Keys that hold over one in HOT_KEYS
    of the rows are broadcast; all others meet by shuffle.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    named = keyed.select(*(F.col(c).alias(f"_{c}") for c in on), *(c for c in keyed.columns if c not in on))
    hot = F.col(count) * HOT_KEYS > total
    same = lambda: functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on))
    drop = [f"_{c}" for c in on]
    many = rows.join(F.broadcast(named.where(hot)), same())
    few = rows.join(F.broadcast(named.where(hot).select(*drop)), same(), "left_anti").join(named.where(~hot), same())
    return many.unionByName(few).drop(*drop)


def finite_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there, has a component at least, and holds nothing null, NaN or infinite."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(F.col(vector), odd), F.lit(True)))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
