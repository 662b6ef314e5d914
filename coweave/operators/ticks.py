"""Tick analytics, batch form.

A tick is (seq, name, pct, period, index): ``seq`` is the arrival order.
Every aggregate here is either a built-in declarative aggregate (partial
aggregation before the shuffle) or, for the order-dependent pair fold, a
streamed two-step fold, so a (name, period) group holding a third of all rows
is never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_tick, tick_is_valid
from ..session import ship_package

TOP_STREAM = 10  # fixed: top-N per micro-batch in the reference


def parse_ticks(messages: DataFrame, value: str = "value", seq: str = "seq",
                drop_bad: bool = False) -> DataFrame:
    """P8 over a message table → (seq, name, stockUpAndDrop, currMonth, index)."""
    if drop_bad:
        messages = messages.where(tick_is_valid(F.col(value)))
    t = messages.select(F.col(seq).alias("seq"), parse_tick(F.col(value)).alias("t"))
    return t.select("seq", "t.*")


def keyed_values(ticks: DataFrame, value: Column | None = None, name: str = "name",
                 period: str = "currMonth") -> DataFrame:
    """Record → ((name, month), value); value defaults to 1 (a count)."""
    v = value if value is not None else F.lit(1)
    return ticks.select(F.col(name).alias("name"), F.col(period).alias("month"), v.alias("value"))


def tick_count(ticks: DataFrame, name: str = "name", period: str = "currMonth") -> DataFrame:
    """Rows per (name, month) → (name, month, total BIGINT)."""
    return ticks.groupBy(F.col(name).alias("name"), F.col(period).alias("month")) \
                .agg(F.count(F.lit(1)).alias("total"))


def trend_compound(ticks: DataFrame, name: str = "name", period: str = "currMonth",
                   pct: str = "stockUpAndDrop") -> DataFrame:
    """Growth factor Π(1 + p/100) per (name, month) as ``trend`` and the
    same as a percent, (Π − 1)·100, both unrounded.  ``product`` is a
    declarative aggregate (partial per map task)."""
    f = F.product(F.lit(1.0) + F.col(pct) / 100)
    return (ticks.groupBy(F.col(name).alias("name"), F.col(period).alias("month"))
            .agg(f.alias("trend"))
            .select("name", "month", "trend", ((F.col("trend") - 1) * 100).alias("trend_pct")))


# -- A9: the literal fold ------------------------------------------------------
#
# The reference folds a group with (l, r) -> (1 + l/100) * (1 + r/100).  Read
# from the first value on, a later value p applies the map x -> c·(1 + x/100)
# with c = 1 + p/100.  The maps of a run of values compose to one:
#
# * for a finite x and y = 1 + x/100, to A + B·y as long as all c are finite.
#   An infinite c leaves only the sign of what it is multiplied with, which is
#   A + B·y again, times ``tail``: the signs of it and of all that follow;
# * an infinite x stays infinite, its sign times ``sign``, that of all c.
#
# A sign of zero is not a number, as infinity times zero is.  A map is
# (A, B, sign, has an infinite c, tail); None is that of no value.

def _sign(v: float) -> float:
    return math.copysign(1.0, v) if v == v and v != 0 else math.nan


def _then(m: tuple | None, p: float) -> tuple:
    """The composed map ``m`` followed by the map of one more value."""
    c = 1.0 + p / 100
    s = _sign(c)
    a, b, sign, cut, tail = m or (0.0, c, 1.0, False, 1.0)
    if cut:
        return a, b, sign * s, True, tail * s
    if math.isinf(c):
        return (1.0 + a / 100, b / 100, sign * s, True, s) if m else (0.0, 1.0, s, True, s)
    return (c * (1.0 + a / 100), c * (b / 100), sign * s, False, 1.0) if m else (0.0, c, s, False, 1.0)


def _apply(m: tuple | None, x: float) -> float:
    if m is None or x != x:
        return x
    a, b, sign, cut, tail = m
    if math.isinf(x):
        return x * sign
    v = a + b * (1.0 + x / 100)
    return _sign(v) * math.inf * tail if cut else v


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, month, run, p) in order -> one row per run: its first value
    and the map of the others."""
    done: list[tuple] = []
    key = first = m = None

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()),
             *(pa.array(c, pa.float64()) for c in cols[3:7]), pa.array(cols[7], pa.bool_()),
             pa.array(cols[8], pa.float64())],
            names=["name", "month", "run", "first", "a", "b", "sign", "cut", "tail"])

    for batch in batches:
        for *k, p in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if key is not None:
                    done.append((*key, first, *(m or [None] * 5)))
                key, first, m = k, p, None
            else:
                m = _then(m, p)
        if len(done) > 10_000:
            yield flush()
    if key is not None:
        done.append((*key, first, *(m or [None] * 5)))
        yield flush()


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order -> (name, month, fold of the whole group)."""
    done: list[tuple] = []
    key, x = None, 0.0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())],
            names=["name", "month", "trend_fold"])

    for batch in batches:
        for name, month, _, first, *m in zip(*(c.to_pylist() for c in batch.columns)):
            if (name, month) != key:
                if key is not None:
                    done.append((*key, x))
                key, x = (name, month), first
            else:
                x = _apply(_then(None, first), x)
            x = _apply(None if m[0] is None else tuple(m), x)
        if len(done) > 10_000:
            yield flush()
    if key is not None:
        done.append((*key, x))
        yield flush()


def trend_pairfold(ticks: DataFrame, name: str = "name", period: str = "currMonth",
                   pct: str = "stockUpAndDrop", seq: str = "seq", run_rows: int = 4096) -> DataFrame:
    """The reference's literal fold per (name, month) in arrival order,
    unrounded; values that share a ``seq`` go by value.

    Every group is cut into runs of the seq range (``run_rows`` numbers each);
    a run is folded into its first value and one map, and a group's runs are
    then joined in order.  Both steps stream sorted rows and keep a few
    numbers, so a huge group is spread over many tasks first and never
    gathered.  The same formula serves every group; ``run_rows`` only changes
    rounding.  A null value counts as 0.
    """
    ship_package(ticks.sparkSession)
    rows = ticks.select(F.col(name).cast("string").alias("name"), F.col(period).cast("string").alias("month"),
                        F.floor(F.col(seq).cast("bigint") / F.lit(run_rows)).cast("bigint").alias("run"),
                        F.coalesce(F.col(pct).cast("double"), F.lit(0.0)).alias("p"),
                        F.col(seq).cast("bigint").alias("seq"))
    runs = (rows.repartition("name", "month", "run")
            .sortWithinPartitions("name", "month", "run", "seq", "p")
            .select("name", "month", "run", "p")
            .mapInArrow(_runs, "name string, month string, run bigint, first double, a double, "
                               "b double, sign double, cut boolean, tail double"))
    return (runs.repartition("name", "month").sortWithinPartitions("name", "month", "run")
            .mapInArrow(_join_runs, "name string, month string, trend_fold double"))


# -- top lists ----------------------------------------------------------------

def batch_top_counts(counts: DataFrame, n: int = TOP_STREAM,
                     per_period: bool = False) -> DataFrame:
    """T4: the n largest (name, month, total) of the batch; ties by name,
    month.  ``per_period=True`` gives the n largest of every month instead
    (what the reference's comment says; its code is batch-wide, Q6)."""
    return _top(counts, "total", n, per_period)


def batch_top_trends(trends: DataFrame, n: int = TOP_STREAM, value: str = "trend",
                     per_period: bool = False) -> DataFrame:
    """T4: the n largest trends of the batch; ties by name, month."""
    return _top(trends, value, n, per_period)


def _top(df: DataFrame, value: str, n: int, per_period: bool) -> DataFrame:
    if per_period:
        w = Window.partitionBy("month").orderBy(F.col(value).desc(), F.col("name").asc())
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return df.orderBy(F.col(value).desc(), "name", "month").limit(n)


def top_n_per_period(ticks: DataFrame, n: int = TOP_STREAM, period: str = "period",
                     pct: str = "pct", seq: str = "seq") -> DataFrame:
    """T5: the n best rows of each daily file by percent; equal percents keep
    file order (a stable descending sort).  Planned with a partial
    WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(period).orderBy(F.col(pct).desc(), F.col(seq).asc())
    return (ticks.withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= n))


def month_batches(rows: DataFrame, period: str, base_ts: str,
                  step_seconds: int = 5) -> DataFrame:
    """Every row of one period shares one batch stamp; periods are paced
    ``step_seconds`` apart in order from ``base_ts``.

    Only the distinct periods (a partial aggregate: one row per period) are
    ranked; the stamps join back on the period key.
    """
    periods = rows.select(F.col(period).alias("_p")).distinct()
    ranked = periods.withColumn("batch_no", F.dense_rank().over(Window.orderBy("_p")))
    stamp = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(base_ts)))
                                + (F.col("batch_no") - 1) * step_seconds)
    ranked = ranked.select("_p", F.col("batch_no").cast("int").alias("batch_no"),
                           F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("batch_ts"))
    return rows.join(ranked, rows[period] == ranked["_p"]).drop("_p")


def running_total(counts: DataFrame, name: str = "name", total: str = "total") -> DataFrame:
    """A10: per-name sum of every count message seen (name, total BIGINT)."""
    return counts.groupBy(F.col(name).alias("name")).agg(
        F.sum(total).cast("bigint").alias("total"))


def latest_period_run(msgs: DataFrame, period: str = "month", seq: str = "seq") -> DataFrame:
    """W7 (batch form): the last run of equal periods in arrival order; a null
    period is a period of its own.

    The dashboard keeps appending while a message's period equals the
    previous one's and restarts otherwise, so what it shows at the end is
    every row after the last row of a *different* period than the final one.
    One partial aggregate gives the last ``seq`` of each period; the largest
    belongs to the final period and the second largest is the cut.  They make
    a table of one row, which is joined back on the period.
    """
    ends = msgs.groupBy(F.struct(F.col(period).alias("p")).alias("_last")).agg(F.max(seq).alias("_end"))
    two = ends.orderBy(F.col("_end").desc()).limit(2)
    one = two.agg(F.max_by("_last", "_end").alias("_last"),
                  F.when(F.count(F.lit(1)) == 2, F.min("_end")).alias("_cut"))
    same = F.struct(F.col(period).alias("p")).eqNullSafe(F.col("_last"))
    after = F.col("_cut").isNull() | (F.col(seq) > F.col("_cut"))
    return msgs.join(F.broadcast(one), same & after).drop("_last", "_cut")
