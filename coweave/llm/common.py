"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty: Python then neither decodes
    nor fails on odd input, and ``bytes.lower`` / ``bytes.split`` act on A-Z
    and ASCII white space only."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def ids_and_texts(docs: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id bigint, body binary, *extra): only the columns an operator
    reads, so that further columns of any name never reach the tasks."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       text_bytes().alias("body"), *extra)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """``mapInArrow`` function that treats every batch alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return run


class BoundedCache(dict):
    """``cache[key]`` computes missing values with ``fill(key)``; emptied when
    ``limit`` entries are reached, so a task's memory stays bounded.  Callers
    look up many keys at C speed with ``map(cache.__getitem__, keys)``."""

    def __init__(self, fill: Callable, limit: int = 1_000_000):
        super().__init__()
        self.fill, self.limit = fill, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fill(key)
        return value


def with_package(fn: Callable) -> Callable:
    """Wrap ``fn(spark, ...)`` so that Python workers can import this package."""
    @functools.wraps(fn)
    def run(spark, *args):
        ship_package(spark)
        return fn(spark, *args)
    return run


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
