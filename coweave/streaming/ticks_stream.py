"""Structured Streaming form of the tick job.

Source: a stream of JSON tick messages (``sources.messages.read_tick_stream``).
Per micro-batch (``foreachBatch``): parse, count and compound per
(name, month), keep the ten largest of each, publish both as JSON messages.
The batch is persisted once and both results come from it; every write
replaces the ``batch_id=`` directory of its batch, so a batch replayed after
a failure rewrites the same output (exactly-once at the sink).  Offsets and
progress live in the query's checkpoint location (W9).

Downstream: ``route_stream`` splits a merged message stream (W8/X4),
``running_total_stream`` keeps per-name totals (W6, stateful aggregate), and
``LatestRunSink`` keeps the dashboard's last run of equal months (W7).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import message_route, parse_tick
from ..operators import ticks as tk
from ..operators.ranking import sort_ascending_view
from ..sources.messages import to_messages
from ..sources.replay import write_topics

TIMES_TOPIC = "times"
TREND_TOPIC = "trend"
BATCH_SECONDS = 10   # fixed: micro-batch interval of the reference


def batch_results(batch: DataFrame, n: int = tk.TOP_STREAM) -> tuple[DataFrame, DataFrame]:
    """W2–W4 on one batch: (top counts, top trends), both limited to n."""
    parsed = tk.parse_ticks(batch.select(F.monotonically_increasing_id().alias("seq"), "value"))
    counts = tk.batch_top_counts(tk.tick_count(parsed), n)
    trends = tk.batch_top_trends(tk.trend_compound(parsed), n)
    return counts, trends


Publisher = Callable[[DataFrame, str, int], None]


def folder_publisher(out_dir: str) -> Publisher:
    """Publish to ``{out_dir}/{topic}/batch_id={id}/`` as JSON lines; a batch
    that is replayed replaces its own directory."""
    def publish(messages: DataFrame, topic: str, batch_id: int) -> None:
        messages.write.mode("overwrite").text(f"{out_dir.rstrip('/')}/{topic}/batch_id={batch_id}")
    return publish


def topic_publisher(servers: str) -> Publisher:
    """Publish to broker topics; a replayed batch is sent again, its id as key."""
    def publish(messages: DataFrame, topic: str, batch_id: int) -> None:
        (messages.withColumn("key", F.lit(str(batch_id))).write.format("kafka")
         .option("kafka.bootstrap.servers", servers).option("topic", topic).save())
    return publish


class TickTopicsWriter:
    """W5 + S6: both results of a batch as one epoch of ``sources.replay``'s
    topic sink: they become visible in one commit, or neither does."""

    def __init__(self, path: str, n: int = tk.TOP_STREAM):
        self.path, self.n = path, n

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            counts, trends = batch_results(batch, self.n)
            both = to_messages(counts.select("name", "month", "total"), TIMES_TOPIC).unionByName(
                to_messages(trends.select("name", "month", "trend"), TREND_TOPIC))
            write_topics(both, self.path, batch_id)
        finally:
            batch.unpersist()


class TickBatchWriter:
    """The ``foreachBatch`` function — one source, two result topics.

    Messages: ``{"name","month","total"}`` and ``{"name","month","trend"}``,
    handed to ``publish`` topic by topic.
    """

    def __init__(self, publish: Publisher, n: int = tk.TOP_STREAM):
        self.publish = publish
        self.n = n

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            counts, trends = batch_results(batch, self.n)
            self.publish(to_messages(counts.select("name", "month", "total")), TIMES_TOPIC, batch_id)
            self.publish(to_messages(trends.select("name", "month", "trend")), TREND_TOPIC, batch_id)
        finally:
            batch.unpersist()


def start_tick_job(source: DataFrame, out: str | Publisher | TickTopicsWriter, checkpoint: str,
                   trigger: str | None = None, n: int = tk.TOP_STREAM) -> StreamingQuery:
    """W1 + W5 + W9: run the job.  ``out`` is a folder, a publisher (see
    ``topic_publisher``) or a ``TickTopicsWriter``.  ``trigger=None`` → processing-time batches every
    10 s (the reference); ``"availableNow"`` → drain what is there."""
    publish = folder_publisher(out) if isinstance(out, str) else out
    writer = publish if isinstance(publish, TickTopicsWriter) else TickBatchWriter(publish, n)
    w = (source.writeStream.foreachBatch(writer)
         .option("checkpointLocation", checkpoint))
    if trigger == "availableNow":
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=trigger or f"{BATCH_SECONDS} seconds")
    return w.start()


def event_time_results(source: DataFrame, duration: str = "1 day", delay: str = "1 day",
                       stamp: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """W2 + W3 in event time: (start, name, month, total, trend) per window of
    the ticks' own time (``index``), for append mode; a window is final when
    the watermark has passed it.  Ticks without a readable time are in no
    window."""
    ticks = source.select(parse_tick(F.col("value")).alias("t")).select("t.*")
    timed = ticks.withColumn("ts", F.try_to_timestamp("index", F.lit(stamp))).withWatermark("ts", delay)
    growth = F.product(F.lit(1.0) + F.col("stockUpAndDrop") / 100)
    return (timed.groupBy(F.window("ts", duration), "name", F.col("currMonth").alias("month"))
            .agg(F.count(F.lit(1)).alias("total"), growth.alias("trend"))
            .select(F.col("window.start").alias("start"), "name", "month", "total", "trend"))


def route_stream(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W8 + X4: one merged message stream → (count messages, trend messages);
    anything else is dropped."""
    r = messages.withColumn("_route", message_route(F.col("value")))
    return (r.where(F.col("_route") == "total").drop("_route"),
            r.where(F.col("_route") == "trend").drop("_route"))


def running_total_stream(count_messages: DataFrame) -> DataFrame:
    """Per-name sum of ``total`` over every count message so far
    (a stateful streaming aggregate: run in complete or update mode)."""
    m = F.from_json("value", "struct<name:string,month:string,total:bigint>")
    parsed = count_messages.select(m.alias("m")).select("m.*")
    return tk.running_total(parsed)


class LatestRunSink:
    """W7 as a ``foreachBatch`` function over trend messages.

    The current run (rows of the latest month, in arrival order) is a table
    ``{path}/v={batch_id}``.  Each batch recomputes the run from the newest
    earlier version plus its own rows with the batch operator
    ``ticks.latest_period_run`` — distributed, never collected — writes the
    next version and removes those before the one it read, which a replay of
    the batch reads again.  Arrival order is the batch, then the source's
    ``arrival`` where the stream has it, then the place in the batch.
    A version that is there but cannot be read raises.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _versions(self, spark: SparkSession) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        # Spark's own mark of a finished write; a version without it is being rewritten
        return sorted(int(n[2:]) for n in names if n.startswith("v=")
                      and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        m = F.from_json("value", "struct<name:string,month:string,trend:double>")
        arrival = F.col("arrival") if "arrival" in batch.columns else F.struct(F.lit(0).alias("none"))
        rows = (batch.select(F.lit(batch_id).cast("bigint").alias("batch"), arrival.alias("arrival"),
                             F.monotonically_increasing_id().alias("pos"), m.alias("m"))
                .select("batch", "arrival", "pos", "m.*"))
        earlier = [v for v in self._versions(spark) if v < batch_id]
        if earlier:
            rows = spark.read.parquet(f"{self.path}/v={earlier[-1]}").unionByName(rows)
        keyed = rows.withColumn("_seq", F.struct("batch", "arrival", "pos"))
        run = tk.latest_period_run(keyed, "month", "_seq").drop("_seq")
        run.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        for v in earlier[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def current(self, spark: SparkSession) -> DataFrame:
        """The run after the newest batch, ascending by trend."""
        return sort_ascending_view(spark.read.parquet(f"{self.path}/v={self._versions(spark)[-1]}"),
                                   "trend", ["name", "batch", "arrival", "pos"])
