"""Sorts, limits and top-k (SURVEY §2: T1–T3, T6, T7, A12; T4, T5 and J7 are
in ``ticks``).

Every top-k is either ``orderBy(...).limit(n)`` (planned as
TakeOrderedAndProject: each task keeps its own n best, one task merges
n × tasks rows) or ``row_number() <= n`` per group (planned with a partial
WindowGroupLimit *before* the shuffle, so a hot group ships at most n rows
per map task).  Ties are never left to chance (Q9): value, then label, then
id / arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _order(value: str, ascending: bool, tiebreak: list[str]) -> list[Column]:
    first = F.col(value).asc() if ascending else F.col(value).desc()
    return [first] + [F.col(c).asc() for c in tiebreak]


def sort_by_label(df: DataFrame, label: str = "name", id_col: str = "id") -> DataFrame:
    """Global ascending sort by label (UTF-8 byte order), id breaks ties.

    A range-partitioned distributed sort; nothing goes through one task.
    """
    return df.orderBy(F.col(label).asc(), F.col(id_col).asc())


def rank_by_value(df: DataFrame, value: str, label: str = "name",
                  id_col: str = "id") -> DataFrame:
    """Global descending sort by the measure, then label, then id."""
    return df.orderBy(*_order(value, False, [label, id_col]))


def with_place(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """Every row with its exact 1-based place (BIGINT) in ``order`` over the
    whole table; rows equal in ``order`` get different places.

    The rows are dealt by range, sorted and numbered within their partition,
    and written once, so that numbers and rows belong together whatever is
    recomputed later.  Rows are then counted per partition and what lies before
    a partition is added: the only window without a partition runs over one
    row per partition, never over the table.
    """
    row = "_row"
    while row in df.columns:
        row += "_"
    # (partition << 33) + row within it, in the order of the sorted partitions
    numbered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn(row, F.monotonically_increasing_id()))
    part = F.shiftright(row, 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    up_to = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = sizes.select("_part", (up_to - F.col("_n")).alias("_before"))
    placed = numbered.join(before, part == F.col("_part"))
    at = F.col("_before") + F.col(row).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], at.cast("bigint").alias(place))


def placed_by_label(df: DataFrame, label: str = "name", id_col: str = "id") -> DataFrame:
    """T1 with the place of every row."""
    return with_place(df, [F.col(label).asc(), F.col(id_col).asc()])


def placed_by_value(df: DataFrame, value: str, label: str = "name", id_col: str = "id") -> DataFrame:
    """T2 with the place of every row."""
    return with_place(df, _order(value, False, [label, id_col]))


def top_n(df: DataFrame, value: str, n: int = 20, label: str = "name",
          id_col: str = "id", ascending: bool = False,
          rank_col: str = "rank") -> DataFrame:
    """The n first rows by ``value`` with a 1-based ``rank`` INT column."""
    order = _order(value, ascending, [label, id_col])
    top = df.orderBy(*order).limit(n)
    # The window runs over at most n rows (the limit above), never the table.
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def sort_ascending_view(df: DataFrame, value: str, tiebreak: list[str]) -> DataFrame:
    """Ascending by the measure (the dashboard's order)."""
    return df.orderBy(*_order(value, True, tiebreak))


def head_slice(ranked: DataFrame, n: int, rank_col: str = "rank") -> DataFrame:
    """First n rows of a saved ranked result."""
    return ranked.where(F.col(rank_col) <= n)


def concat_lines(df: DataFrame, text: str, order: str, sep: str = "") -> DataFrame:
    """Join the (bounded) text rows into one value in ``order``.

    Only for small inputs such as a top-n list; whole-graph output is written
    line per row instead (``sources.gexf.write_gexf``).
    """
    sep_sql = sep.replace("'", "''")
    return df.agg(F.expr(f"listagg(`{text}`, '{sep_sql}') within group (order by `{order}`)")
                  .alias("text"))
