"""W7 with keyed state: the dashboard's last run of equal periods.

What the dashboard shows is every message after the last one of a *different*
period than the newest message's.  For that, the newest arrival of each of the
two periods that were seen last is all one has to know: the first is the period
of the run, the second its cut.  These pairs combine over any split of the
messages, so they are kept per shard of names by ``transformWithState``, one value
of bounded size a shard, and never the run itself.

Per batch a shard passes on its messages after its own cut and a mark (its two
periods).  Both are appended to the batch's own folder::

    {path}/rows/batch_id=<id>/     name, period, trend, at
    {path}/marks/batch_id=<id>/    shard, period, at

``current`` takes the two newest periods over all marks and keeps the rows of the
newest one after the cut: nothing is rewritten from batch to batch, and a batch
that is replayed replaces its own folders.  A shard that has been idle for
``idle_ms`` forgets its state by timer; its marks stay, so the result does not
change, only rows that could have been held back are passed on once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegralType

from ..operators.ranking import sort_ascending_view
from ..session import ship_package

SHARDS = 64
IDLE_MS = 24 * 3600 * 1000
#: of this query only: keyed state lives in RocksDB, and processing-time timers
#: would otherwise run empty batches one after the other for ever
QUERY_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
STATE = "first string, first_a bigint, first_b bigint, first_c bigint, second string, second_a bigint, second_b bigint, second_c bigint"
OUTPUT = "shard int, mark boolean, name string, period string, trend double, a bigint, b bigint, c bigint"

NO_PERIOD = "\0null"      # a message without a period has one of its own

Place = tuple[int, int, int]


def two_newest(seen: dict[str, Place]) -> list[tuple[str, Place]]:
    """The two periods with the newest arrivals, the newest first."""
    return sorted(seen.items(), key=lambda p: p[1], reverse=True)[:2]


class LastTwoPeriods(StatefulProcessor):
    """State of a shard: its two newest periods with their newest arrivals."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def _seen(self) -> dict[str, Place]:
        if not self.known.exists():
            return {}
        s = self.known.get()
        pairs = [(s[0], tuple(s[1:4])), (s[4], tuple(s[5:8]))]
        return {p: at for p, at in pairs if p is not None}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen, batch = self._seen(), []
        for r in rows:
            period, at = NO_PERIOD if r["month"] is None else r["month"], (r["a"], r["b"], r["c"])
            two = two_newest(seen)
            # rows of neither newest period, or before the cut, can never be shown
            if len(two) == 2 and at < two[1][1]:
                continue
            seen[period] = max(at, seen.get(period, at))
            if len(seen) > 64:
                seen = dict(two_newest(seen))
            batch.append((r["name"], period, r["trend"], at))
        two = two_newest(seen)
        cut = two[1][1] if len(two) == 2 else None
        flat: list = []
        for period, at in [*two, (None, (None, None, None))][:2]:
            flat += [period, *at]
        self.known.update(tuple(flat))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        shard = key[0]
        for period, at in two:
            yield Row(shard=shard, mark=True, name=None, period=period, trend=None, a=at[0], b=at[1], c=at[2])
        for name, period, trend, at in batch:
            if period == two[0][0] and (cut is None or at > cut):
                yield Row(shard=shard, mark=False, name=name, period=period, trend=trend, a=at[0], b=at[1], c=at[2])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def start_latest_run(messages: DataFrame, path: str, checkpoint: str, shards: int = SHARDS,
                     idle_ms: int = IDLE_MS, **trigger) -> StreamingQuery:
    """Run W7 over trend messages (value, arrival), ``arrival`` being a struct of
    up to three whole numbers in the order of arrival, with the given trigger.

    A message that is no JSON counts as one without name and period."""
    spark = messages.sparkSession
    ship_package(spark)
    fields = messages.schema["arrival"].dataType.names
    if len(fields) > 3 or any(not isinstance(f.dataType, IntegralType) for f in messages.schema["arrival"].dataType):
        raise ValueError("arrival must be up to three whole numbers")
    at = [F.col(f"arrival.{f}").cast("bigint") for f in fields] + [F.lit(0).cast("bigint")] * (3 - len(fields))
    m = F.from_json("value", "struct<name:string,month:string,trend:double>")
    rows = messages.select(m.alias("m"), *[x.alias(n) for x, n in zip(at, "abc")])
    shard = F.pmod(F.xxhash64("m.name", "a", "b", "c"), F.lit(shards)).cast("int")
    keyed = rows.select(shard.alias("shard"), "m.name", "m.month", "m.trend", "a", "b", "c")
    passed = keyed.groupBy("shard").transformWithState(
        LastTwoPeriods(idle_ms), OUTPUT, "Update", "ProcessingTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.where(~F.col("mark")).drop("mark", "shard").write.mode("overwrite").parquet(
                f"{path}/rows/batch_id={batch_id}")
            batch.where("mark").select("shard", "period", "a", "b", "c").write.mode("overwrite").parquet(
                f"{path}/marks/batch_id={batch_id}")
        finally:
            batch.unpersist()

    query = passed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    with _settings(spark, QUERY_SETTINGS):
        return (query.trigger(**trigger) if trigger else query).start()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a query that is started within; it keeps them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The run (name, month, trend, a, b, c) after the newest batch, ascending by
    trend (T6)."""
    marks = spark.read.schema("period string, a bigint, b bigint, c bigint").parquet(f"{path}/marks/*")
    ends = marks.groupBy("period").agg(F.max(F.struct("a", "b", "c")).alias("at"))
    two = ends.orderBy(F.desc("at")).limit(2)
    one = two.agg(F.max_by("period", "at").alias("last"),
                  F.when(F.count(F.lit(1)) == 2, F.min("at")).alias("cut"))
    rows = (spark.read.schema("name string, period string, trend double, a bigint, b bigint, c bigint")
            .parquet(f"{path}/rows/*"))
    # a table of one row, joined on the period
    run = rows.join(F.broadcast(one), (F.col("period") == F.col("last"))
                    & (F.col("cut").isNull() | (F.struct("a", "b", "c") > F.col("cut"))))
    month = F.when(F.col("period") != NO_PERIOD, F.col("period"))
    return sort_ascending_view(run.select("name", month.alias("month"), "trend", "a", "b", "c"),
                               "trend", ["name", "a", "b", "c"])
