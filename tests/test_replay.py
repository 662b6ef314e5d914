"""Replay as a streaming source, topics in one commit, W7 with keyed state."""

import json
import os

import pytest
from pyspark.sql import functions as F

from coweave.operators import ticks as tk
from coweave.sources import messages, replay
from coweave.streaming import latest_run, ticks_stream as ts


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def collecting(stream, checkpoint, seen, stop_after=None):
    def take(batch, batch_id):
        if stop_after is not None and len(seen) >= stop_after:
            raise RuntimeError("stopped here")
        rows = batch.select("value", "arrival.*").collect()
        seen.append((batch_id, sorted({r["period"] for r in rows}), [r["value"] for r in rows]))
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()


def rows_of(spark, periods, per=3):
    return spark.createDataFrame([(b, f"n{i}", float(i), f"2024-{b:02}") for b in periods for i in range(per)],
                                 "batch_no int, name string, stockUpAndDrop double, currMonth string")


def test_one_period_a_trigger_in_order(spark, tmp_dir):
    replay.write_replay(rows_of(spark, [12, 3, 1, 7, -2]).repartition(3), tmp_dir + "/r")
    seen = []
    drain(collecting(replay.read_replay(spark, tmp_dir + "/r", tmp_dir + "/p"), tmp_dir + "/ck", seen))
    assert [(b, p) for b, p, _ in seen] == [(0, [-2]), (1, [1]), (2, [3]), (3, [7]), (4, [12])]
    assert all(len(v) == 3 for _, _, v in seen)
    few = []
    drain(collecting(replay.read_replay(spark, tmp_dir + "/r", tmp_dir + "/p2", periods=2), tmp_dir + "/ck2", few))
    assert [p for _, p, _ in few] == [[-2, 1], [3, 7], [12]]


def test_a_query_started_again_goes_on(spark, tmp_dir):
    replay.write_replay(rows_of(spark, range(1, 7)), tmp_dir + "/r")
    seen = []
    for stop_after in (2, 3, None):        # fails in its third batch, in its fourth, not at all
        query = collecting(replay.read_replay(spark, tmp_dir + "/r", tmp_dir + "/p"), tmp_dir + "/ck", seen, stop_after)
        if stop_after is None:
            drain(query)
        else:
            with pytest.raises(Exception, match="stopped here"):
                query.processAllAvailable()
            query.stop()
    assert [p for _, p, _ in seen] == [[n] for n in range(1, 7)]
    drain(collecting(replay.read_replay(spark, tmp_dir + "/r", tmp_dir + "/p"), tmp_dir + "/ck", seen))
    assert len(seen) == 6                  # nothing comes twice


def test_a_large_period_has_several_partitions_and_one_write_makes_all(spark, tmp_dir):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        replay.write_replay(rows_of(spark, [1], 4000).unionByName(rows_of(spark, [2, 3], 2)), tmp_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    reader = replay.ReplayReader({"path": tmp_dir, "progress": tmp_dir + "/p"})
    assert reader.periods == [1, 2, 3]
    assert len(reader.partitions({"periods": 0}, {"periods": 1})) > 1
    assert len(reader.partitions({"periods": 1}, {"periods": 3})) == 2
    assert reader.partitions({"periods": 3}, {"periods": 3}) == []


def published(spark, path):
    return sorted((r["epoch"], r["topic"], r["value"]) for r in replay.read_topics(spark, path).collect())


def topic_rows(spark, rows):
    return spark.createDataFrame(rows, "topic string, value string").repartition(3)


def test_topics_of_an_epoch_appear_together(spark, tmp_dir):
    assert published(spark, tmp_dir) == []
    replay.write_topics(topic_rows(spark, [("times", "1"), ("trend", "2   x"), ("times", "é")]), tmp_dir, 0)
    assert published(spark, tmp_dir) == [(0, "times", "1"), (0, "times", "é"), (0, "trend", "2   x")]
    replay.write_topics(topic_rows(spark, [("times", "9")]), tmp_dir, 1)
    replay.write_topics(topic_rows(spark, [("trend", "7")]), tmp_dir, 0)       # epoch 0 again
    assert published(spark, tmp_dir) == [(0, "trend", "7"), (1, "times", "9")]
    replay.write_topics(topic_rows(spark, []), tmp_dir, 2)
    assert len(published(spark, tmp_dir)) == 2


def test_a_failure_between_the_topics_leaves_neither(spark, tmp_dir):
    """A task writes one topic and dies before the other: nothing can be read,
    its finished neighbours are removed, and a replay publishes both."""
    bad = (topic_rows(spark, [("times", "1"), ("times", "2"), ("trend", "die")])
           .withColumn("value", F.when(F.col("value") == "die", F.raise_error(F.lit("killed"))).otherwise(F.col("value"))))
    with pytest.raises(Exception, match="killed"):
        replay.write_topics(bad, tmp_dir, 0)
    assert published(spark, tmp_dir) == [] and not os.path.exists(tmp_dir + "/epochs/0.json")
    replay.write_topics(topic_rows(spark, [("times", "1"), ("trend", "2")]), tmp_dir, 0)
    assert published(spark, tmp_dir) == [(0, "times", "1"), (0, "trend", "2")]


def test_nothing_is_visible_before_the_manifest(spark, tmp_dir):
    writer = replay.TopicBatchWriter({"path": tmp_dir, "epoch": "3"})
    done = [writer.write(iter([{"topic": "times", "value": "a"}, {"topic": "trend", "value": "b"}])), None]
    assert published(spark, tmp_dir) == [] and len(os.listdir(tmp_dir + "/data")) == 2
    writer.abort(done)
    assert os.listdir(tmp_dir + "/data") == []
    done = [writer.write(iter([{"topic": "times", "value": "a"}, {"topic": "trend", "value": "b"}]))]
    writer.commit(done)
    assert published(spark, tmp_dir) == [(3, "times", "a"), (3, "trend", "b")]


def test_tick_job_publishes_both_results_of_a_batch(spark, tmp_dir):
    os.makedirs(tmp_dir + "/in")
    lines = [json.dumps({"name": f"s{i % 5}", "stockUpAndDrop": 1.0 * i, "currMonth": "m", "index": "i"}) for i in range(40)]
    with open(tmp_dir + "/in/0.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    for _ in range(2):                      # the second start adds nothing
        ts.start_tick_job(messages.read_tick_stream(spark, "text", tmp_dir + "/in"), ts.TickTopicsWriter(tmp_dir + "/out"),
                          tmp_dir + "/ck", trigger="availableNow").awaitTermination()
    got = published(spark, tmp_dir + "/out")
    counts, trends = ts.batch_results(spark.read.text(tmp_dir + "/in"))
    assert sorted(json.loads(v)["total"] for _, t, v in got if t == ts.TIMES_TOPIC) == sorted(r["total"] for r in counts.collect())
    assert sorted(json.loads(v)["trend"] for _, t, v in got if t == ts.TREND_TOPIC) == sorted(r["trend"] for r in trends.collect())


def test_stream_of_topics(spark, tmp_dir):
    os.makedirs(tmp_dir + "/in")
    with open(tmp_dir + "/in/0.json", "w") as f:
        f.write('{"total":1}\n{"trend":2.0}\n{"total":3}\n')
    m = messages.read_tick_stream(spark, "text", tmp_dir + "/in")
    named = m.select(F.when(F.col("value").contains("total"), "times").otherwise("trend").alias("topic"), "value")
    query = replay.write_topic_stream(named, tmp_dir + "/out", tmp_dir + "/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert published(spark, tmp_dir + "/out") == [(0, "times", '{"total":1}'), (0, "times", '{"total":3}'), (0, "trend", '{"trend":2.0}')]


MONTHS = ["m1", "m1", "m2", "m1", None, None, "m2", "m3", "m3"]


@pytest.mark.parametrize("idle_ms", [latest_run.IDLE_MS, 1])
def test_keyed_state_gives_the_latest_run_after_a_restart(spark, tmp_dir, idle_ms):
    """Months that return, messages without one; the query is stopped in
    mid-stream.  With a timer of a millisecond the shards forget in between."""
    rows = [(b, f"n{i}", MONTHS[b], float(b * 10 + i)) for b in range(len(MONTHS)) for i in range(4)]
    df = spark.createDataFrame(rows, "batch_no int, name string, month string, trend double")
    replay.write_replay(df.withColumn("batch_no", F.col("batch_no") + 1), tmp_dir + "/r")

    def start():
        stream = replay.read_replay(spark, tmp_dir + "/r", tmp_dir + "/p", periods=3)
        return latest_run.start_latest_run(stream, tmp_dir + "/run", tmp_dir + "/ck", shards=3, idle_ms=idle_ms)
    first = start()
    while not (first.lastProgress and first.lastProgress.batchId >= 0):
        assert first.isActive, first.exception()
    first.stop()
    drain(start())
    got = sorted((r["name"], r["month"], r["trend"]) for r in latest_run.current(spark, tmp_dir + "/run").collect())
    want = tk.latest_period_run(df.withColumn("seq", F.struct("batch_no", "trend")), "month", "seq")
    assert got == sorted((r["name"], r["month"], r["trend"]) for r in want.collect()) and len(got) == 8


def test_settings_are_those_of_the_query_only(spark):
    for key in latest_run.QUERY_SETTINGS:
        assert spark.conf.get(key, None) != latest_run.QUERY_SETTINGS[key]


def test_two_newest_periods_combine_over_any_split():
    seen = {"a": (1, 0, 0), "b": (5, 0, 0), "c": (4, 2, 0), "d": (4, 1, 9)}
    assert latest_run.two_newest(seen) == [("b", (5, 0, 0)), ("c", (4, 2, 0))]
    left, right = dict(list(seen.items())[:2]), dict(list(seen.items())[2:])
    parts = dict(latest_run.two_newest(left) + latest_run.two_newest(right))
    assert latest_run.two_newest(parts) == latest_run.two_newest(seen)
