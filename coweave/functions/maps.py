"""Map and key-set functions, Column → Column (SURVEY §2: M1–M3, F3, X2, X3,
P10).  All are Spark higher-order functions, evaluated inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_union_min(a: Column, b: Column) -> Column:
    """M1: union of two maps; the smaller value on shared keys.

    ``least`` skips the null a missing side produces in ``map_zip_with``.
    """
    return F.map_zip_with(a, b, lambda k, x, y: F.least(x, y))


def map_minus_decrement(a: Column, b: Column) -> Column:
    """M2: entries of ``a`` whose key is not in ``b``, value − 1."""
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.transform_values(kept, lambda k, v: v - 1)


def map_merge_first_wins(a: Column, b: Column) -> Column:
    """M3 (maps): merge, ``a``'s value wins on shared keys."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))


def keys_with_value(m: Column, value) -> Column:
    """keys of the entries whose value equals ``value``."""
    return F.map_keys(F.map_filter(m, lambda k, v: v == F.lit(value)))


def key_union(a: Column, b: Column) -> Column:
    """Union of the key sets of two maps."""
    return F.array_union(F.map_keys(a), F.map_keys(b))


def key_except(a: Column, b: Column) -> Column:
    """Keys of ``a`` not in ``b``."""
    return F.array_except(F.map_keys(a), F.map_keys(b))


def ids_to_line(ids: Column, sep: str = " ") -> Column:
    """P10: an id collection (array, or a map's keys) → one delimited line."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), sep)
