"""Registered streaming queries: each drains a file stream of the tick
messages with ``availableNow`` through the library's own stream job and
returns the sink's rows; the oracle is the batch result over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ticks as tk
from ..session import scratch_path
from ..sources import messages, replay, testdata as td
from ..streaming import latest_run, ticks_stream as ts
from .tick_queries import C_SQL, ROUND_SQL, R_SQL, T_SQL, TR_SQL

TOP = tk.TOP_STREAM


def _input(spark: SparkSession, sf_dir: str) -> str:
    """The tick messages as files of a folder."""
    path = scratch_path(spark)
    td.tick_messages(spark, sf_dir).select("value").coalesce(4).write.text(path)
    return path


def _job_output(spark: SparkSession, sf_dir: str) -> str:
    out = scratch_path(spark)
    stream = messages.read_tick_stream(spark, "text", _input(spark, sf_dir))
    ts.start_tick_job(stream, out, scratch_path(spark), trigger="availableNow").awaitTermination()
    return out


def q_stream_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W2 + W4 + W5: the count topic of the job; one batch holds all."""
    out = spark.read.text(f"{_job_output(spark, sf_dir)}/{ts.TIMES_TOPIC}/*")
    return out.select(F.from_json("value", "name string, month string, total bigint").alias("m")).select("m.*")


SQL_STREAM_TOP_COUNTS = (f"with t as ({T_SQL}), c as ({C_SQL}) select * from c "
                         f"order by total desc, name, month limit {TOP}")


def q_stream_top_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 + W4 + W5: the trend topic of the job."""
    out = spark.read.text(f"{_job_output(spark, sf_dir)}/{ts.TREND_TOPIC}/*")
    m = out.select(F.from_json("value", "name string, month string, trend double").alias("m")).select("m.*")
    return m.withColumn("trend", F.round("trend", 6))


SQL_STREAM_TOP_TRENDS = (f"with t as ({T_SQL}), c as ({TR_SQL}) select name, month, round(trend, 6) as trend from c "
                         f"order by c.trend desc, name, month limit {TOP}")


def q_stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job runs, is started again from its checkpoint and adds
    nothing: batches per topic."""
    source, out, checkpoint = _input(spark, sf_dir), scratch_path(spark), scratch_path(spark)
    for _ in range(2):
        ts.start_tick_job(messages.read_tick_stream(spark, "text", source), out, checkpoint,
                          trigger="availableNow").awaitTermination()
    times, trend = (spark.read.text(f"{out}/{t}").select(F.lit(t).alias("topic"), "batch_id")
                    for t in (ts.TIMES_TOPIC, ts.TREND_TOPIC))
    return times.unionByName(trend).groupBy("topic").agg(
        F.count_distinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("messages"))


SQL_STREAM_RESTART = (f"with t as ({T_SQL}), c as ({C_SQL}), n as (select least({TOP}, count(*)) as n from c) "
                      "select 'times' as topic, 1 as batches, n as messages from n "
                      "union all select 'trend', 1, n from n")


def _result_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and trends of every group as two message folders, read as one
    stream (X4)."""
    ticks = tk.parse_ticks(td.tick_messages(spark, sf_dir))
    a, b = scratch_path(spark), scratch_path(spark)
    messages.write_messages(tk.tick_count(ticks), path=a)
    messages.write_messages(tk.trend_compound(ticks).select("name", "month", "trend"), path=b)
    return messages.read_tick_stream(spark, "text", [a, b])


def q_stream_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 + W8 + X4: per-name totals over the count messages of a merged stream."""
    totals, _ = ts.route_stream(_result_stream(spark, sf_dir))
    out = scratch_path(spark)
    (ts.running_total_stream(totals).writeStream.outputMode("complete")
     .option("checkpointLocation", scratch_path(spark))
     .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


SQL_STREAM_RUNNING_TOTAL = (f"with t as ({T_SQL}), c as ({C_SQL}) "
                            "select name, cast(sum(total) as bigint) as total from c group by name")


def q_stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 + S6: the trend messages of a merged stream, written as messages."""
    _, trends = ts.route_stream(_result_stream(spark, sf_dir))
    out = scratch_path(spark)
    m = trends.select(F.from_json("value", "name string, month string, trend double").alias("m")).select("m.*")
    messages.write_message_stream(m, scratch_path(spark), path=out, trigger_available_now=True).awaitTermination()
    got = spark.read.text(out).select(F.from_json("value", "name string, month string, trend double").alias("m"))
    return got.select("m.name", "m.month", F.round("m.trend", 6).alias("trend"))


SQL_STREAM_ROUTES = (f"with t as ({T_SQL}), c as ({TR_SQL}) select name, month, round(trend, 6) as trend from c")


def q_stream_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + W10: ticks replayed day by day as trend messages; what the
    dashboard shows at the end is the last day."""
    path, run = scratch_path(spark), scratch_path(spark)
    rows = tk.month_batches(td.tick_rows(spark, sf_dir), "period", "2024-01-01 00:00:00").select(
        "batch_no", "name", F.col("period").alias("month"), F.col("pct").alias("trend"))
    messages.replay_as_messages(rows, path)
    sink = ts.LatestRunSink(run)
    (messages.read_tick_stream(spark, "text", path + "/*", max_files_per_trigger=8)
     .writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark))
     .trigger(availableNow=True).start().awaitTermination())
    return sink.current(spark).select("name", "month", "trend")


SQL_STREAM_LATEST_RUN = (f"with r as ({R_SQL}) select name, period as month, pct as trend from r "
                         "where period = (select max(period) from r)")


def q_stream_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + W3 in event time: days that the watermark has closed.  The files
    are one per day in order, so only the last days stay open."""
    path, out = scratch_path(spark), scratch_path(spark)
    rows = tk.month_batches(td.tick_rows(spark, sf_dir), "period", "2024-01-01 00:00:00").select(
        "batch_no", "name", F.col("pct").alias("stockUpAndDrop"), F.col("period").alias("currMonth"), "index")
    messages.replay_as_messages(rows, path)
    stream = messages.read_tick_stream(spark, "text", path + "/*", max_files_per_trigger=8)
    (ts.event_time_results(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(spark)).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "name", "month",
                                          "total", F.round("trend", 6).alias("trend"))


SQL_STREAM_EVENT_TIME = (
    f"with r as ({R_SQL}), e as (select date_trunc('day', max(ts) - interval 1 day) as open from events) "
    "select period as day, name, period as month, count(*) as total, round(product(1 + pct / 100), 6) as trend "
    "from r, e where period < strftime(e.open, '%Y-%m-%d') group by name, period")


def _drain(query) -> None:
    """Let a query work off its source, then end it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _replay(spark: SparkSession, sf_dir: str, *cols) -> str:
    path = scratch_path(spark)
    rows = tk.month_batches(td.tick_rows(spark, sf_dir), "period", "2024-01-01 00:00:00")
    replay.write_replay(rows.select("batch_no", *cols), path)
    return path


def q_replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + W10 + P6 + P8: ticks replayed as a streaming source, one period a
    trigger, with the micro-batch each came in."""
    path = _replay(spark, sf_dir, "name", F.col("pct").alias("stockUpAndDrop"), F.col("period").alias("currMonth"), "index")
    out, checkpoint = scratch_path(spark), scratch_path(spark)
    stream = replay.read_replay(spark, path, f"{checkpoint}-progress")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("value").write.mode("overwrite").text(f"{out}/batch={batch_id}")
    _drain(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start())
    got = spark.read.option("basePath", out).text(f"{out}/batch=*").select(F.col("batch").cast("bigint").alias("seq"), "value")
    return tk.parse_ticks(got).select((F.col("seq") + 1).alias("batch"), "name", "stockUpAndDrop", "currMonth", "index")


SQL_REPLAY_STREAM = (
    f"with r as ({R_SQL}) select dense_rank() over (order by r.period) as batch, r.name, r.pct as stockUpAndDrop, "
    "r.period as currMonth, strftime(e.ts, '%Y-%m-%d %H:%M:%S') as \"index\" from r join events e on e.event_id = r.seq")


def q_stream_latest_run_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + W10 with keyed state: the last run of the replayed ticks."""
    path = _replay(spark, sf_dir, "name", F.col("period").alias("month"), F.col("pct").alias("trend"))
    run, checkpoint = scratch_path(spark), scratch_path(spark)
    stream = replay.read_replay(spark, path, f"{checkpoint}-progress", periods=10)
    _drain(latest_run.start_latest_run(stream, run, checkpoint))
    return latest_run.current(spark, run).select("name", "month", "trend")


def q_stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W5 + S6: both results of the tick job, published in one commit an
    epoch and read back."""
    out = scratch_path(spark)
    stream = messages.read_tick_stream(spark, "text", _input(spark, sf_dir))
    ts.start_tick_job(stream, ts.TickTopicsWriter(out), scratch_path(spark), trigger="availableNow").awaitTermination()
    m = F.from_json("value", "name string, month string, total bigint, trend double")
    got = replay.read_topics(spark, out).select("epoch", "topic", m.alias("m"))
    value = F.coalesce(F.col("m.total").cast("double"), F.round("m.trend", 6))
    return got.select("epoch", "topic", "m.name", "m.month", value.alias("value"))


SQL_STREAM_TOPICS = (
    f"select cast(0 as bigint) as epoch, 'times' as topic, name, month, cast(total as double) as value "
    f"from ({SQL_STREAM_TOP_COUNTS}) union all select 0, 'trend', name, month, trend from ({SQL_STREAM_TOP_TRENDS})")


QUERIES = {
    "stream_top_counts": q_stream_top_counts,
    "stream_top_trends": q_stream_top_trends,
    "stream_restart": q_stream_restart,
    "stream_running_total": q_stream_running_total,
    "stream_routes": q_stream_routes,
    "stream_latest_run": q_stream_latest_run,
    "stream_event_time": q_stream_event_time,
    "replay_stream": q_replay_stream,
    "stream_latest_run_keyed": q_stream_latest_run_keyed,
    "stream_topics": q_stream_topics,
}
ORACLES = {
    "stream_top_counts": SQL_STREAM_TOP_COUNTS,
    "stream_top_trends": SQL_STREAM_TOP_TRENDS,
    "stream_restart": SQL_STREAM_RESTART,
    "stream_running_total": SQL_STREAM_RUNNING_TOTAL,
    "stream_routes": SQL_STREAM_ROUTES,
    "stream_latest_run": SQL_STREAM_LATEST_RUN,
    "stream_event_time": SQL_STREAM_EVENT_TIME,
    "replay_stream": SQL_REPLAY_STREAM,
    "stream_latest_run_keyed": SQL_STREAM_LATEST_RUN,
    "stream_topics": SQL_STREAM_TOPICS,
}
