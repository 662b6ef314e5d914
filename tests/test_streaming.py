"""Stream = batch checks for the tick job."""

import json
import os

import pytest

from coweave.sources import messages
from coweave.streaming import ticks_stream as ts


def _ticks_json(rows):
    return "\n".join(json.dumps({"name": n, "stockUpAndDrop": p, "currMonth": m, "index": "i"})
                     for n, p, m in rows) + "\n"


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_dir):
    src, out, ck = tmp_dir + "/in", tmp_dir + "/out", tmp_dir + "/ck"
    os.makedirs(src)
    rows = [(f"s{i % 13}", float(i % 7) - 3, "2024-01" if i % 3 else "2024-02") for i in range(80)]
    with open(src + "/b0.json", "w") as f:
        f.write(_ticks_json(rows) + "not json\n")
    stream = messages.read_tick_stream(spark, "text", src)
    q = ts.start_tick_job(stream, out, ck, trigger="availableNow")
    q.awaitTermination()
    got_t = sorted(json.loads(r["value"])["total"] for r in spark.read.text(out + "/times").collect())
    batch = spark.read.text(src)
    counts, trends = ts.batch_results(batch)
    assert got_t == sorted(r["total"] for r in counts.collect())
    got_tr = sorted(json.loads(r["value"])["trend"] for r in spark.read.text(out + "/trend").collect())
    assert got_tr == sorted(r["trend"] for r in trends.collect())
    # restart from the checkpoint: no new batch, output unchanged
    q2 = ts.start_tick_job(messages.read_tick_stream(spark, "text", src), out, ck, trigger="availableNow")
    q2.awaitTermination()
    assert sorted(os.listdir(out + "/times")) == ["batch_id=0"]


def test_route_and_running_total_stream(spark, tmp_dir):
    src = tmp_dir + "/msgs"
    os.makedirs(src)
    lines = ['{"name":"a","month":"m1","total":2}', '{"name":"a","month":"m2","total":3}',
             '{"name":"b","month":"m1","trend":1.5}', '{"x":1}', '{"name":"b","month":"m1","total":1}']
    with open(src + "/0.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    totals, trends = ts.route_stream(messages.read_tick_stream(spark, "text", src))
    q = (ts.running_total_stream(totals).writeStream.outputMode("complete")
         .format("memory").queryName("rt_test").trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r["name"]: r["total"] for r in spark.sql("select * from rt_test").collect()} == {"a": 5, "b": 1}
    q2 = (trends.writeStream.format("memory").queryName("tr_test")
          .trigger(availableNow=True).start())
    q2.awaitTermination()
    assert spark.sql("select * from tr_test").count() == 1


def test_latest_run_sink_across_batches(spark, tmp_dir):
    sink = ts.LatestRunSink(tmp_dir + "/run")

    def batch(rows):
        return spark.createDataFrame([(json.dumps({"name": n, "month": m, "trend": t}),)
                                      for n, m, t in rows], "value string")

    sink(batch([("a", "m1", 1.0), ("b", "m1", 2.0)]), 0)
    sink(batch([("c", "m1", 0.5)]), 1)
    assert sorted(r["name"] for r in sink.current(spark).collect()) == ["a", "b", "c"]
    sink(batch([("d", "m1", 1.0), ("e", "m2", 3.0), ("f", "m2", 1.0)]), 2)
    assert [r["name"] for r in sink.current(spark).collect()] == ["f", "e"]
    sink(batch([("d", "m1", 1.0), ("e", "m2", 3.0), ("f", "m2", 1.0)]), 2)   # replay
    assert sink.current(spark).count() == 2
    # a batch without rows left no version: the newest one before it counts
    sink(batch([("g", "m2", 2.0)]), 4)
    assert [r["name"] for r in sink.current(spark).collect()] == ["f", "g", "e"]
    assert sorted(os.listdir(tmp_dir + "/run")) == ["v=2", "v=4"]


def test_latest_run_sink_raises_on_unreadable_state(spark, tmp_dir):
    sink = ts.LatestRunSink(tmp_dir + "/run")
    one = spark.createDataFrame([('{"name":"a","month":"m1","trend":1.0}',)], "value string")
    sink(one, 0)
    for f in os.listdir(tmp_dir + "/run/v=0"):
        if f.endswith(".parquet"):
            with open(f"{tmp_dir}/run/v=0/{f}", "wb") as broken:
                broken.write(b"nothing")
    with pytest.raises(Exception):
        sink(one, 1)


def test_latest_run_sink_goes_by_arrival(spark, tmp_dir):
    sink = ts.LatestRunSink(tmp_dir + "/run")
    rows = [(9, "c", "m2"), (10, "d", "m2"), (1, "a", "m2"), (5, "b", "m1")]
    batch = spark.createDataFrame([(json.dumps({"name": n, "month": m, "trend": 1.0}), (k,))
                                   for k, n, m in rows], "value string, arrival struct<offset:bigint>")
    sink(batch, 0)
    assert [r["name"] for r in sink.current(spark).collect()] == ["c", "d"]


def test_publisher_argument_gets_both_topics(spark, tmp_dir):
    src = tmp_dir + "/in"
    os.makedirs(src)
    with open(src + "/0.json", "w") as f:
        f.write(_ticks_json([("a", 1.0, "m"), ("b", 2.0, "m")]))
    sent = []
    q = ts.start_tick_job(messages.read_tick_stream(spark, "text", src),
                          lambda m, topic, i: sent.append((topic, i, m.count())),
                          tmp_dir + "/ck", trigger="availableNow")
    q.awaitTermination()
    assert sent == [("times", 0, 2), ("trend", 0, 2)]


def test_processing_time_trigger(spark, tmp_dir):
    src = tmp_dir + "/in"
    os.makedirs(src)
    with open(src + "/0.json", "w") as f:
        f.write(_ticks_json([("a", 1.0, "m")]))
    q = ts.start_tick_job(messages.read_tick_stream(spark, "text", src), tmp_dir + "/out", tmp_dir + "/ck",
                          trigger="1 seconds")
    try:
        q.processAllAvailable()
        assert spark.read.text(tmp_dir + "/out/times").count() == 1
    finally:
        q.stop()


def test_two_sources_as_one_stream(spark, tmp_dir):
    for n, line in (("x", '{"total":1}'), ("y", '{"trend":2.0}')):
        os.makedirs(f"{tmp_dir}/{n}")
        with open(f"{tmp_dir}/{n}/0.json", "w") as f:
            f.write(line + "\n")
    totals, trends = ts.route_stream(messages.read_tick_stream(spark, "text", [tmp_dir + "/x", tmp_dir + "/y"]))
    for df, name in ((totals, "two_a"), (trends, "two_b")):
        df.select("value").writeStream.format("memory").queryName(name).trigger(
            availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == 1


def test_event_time_results_leave_out_open_windows(spark, tmp_dir):
    src = tmp_dir + "/in"
    os.makedirs(src)
    for n, stamps in enumerate((["2024-01-01 10:00:00", "2024-01-01 11:00:00"], ["2024-01-09 00:00:00"], ["2024-01-20 00:00:00"])):
        with open(f"{src}/{n}.json", "w") as f:
            for s in stamps:
                f.write(json.dumps({"name": "a", "stockUpAndDrop": 10.0, "currMonth": "m", "index": s}) + "\n")
        os.utime(f"{src}/{n}.json", (1000 + n, 1000 + n))
    stream = messages.read_tick_stream(spark, "text", src, max_files_per_trigger=1)
    q = (ts.event_time_results(stream).writeStream.format("memory").queryName("event_time")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((str(r["start"]), r["total"], round(r["trend"], 6)) for r in spark.table("event_time").collect())
    assert got == [("2024-01-01 00:00:00", 2, 1.21), ("2024-01-09 00:00:00", 1, 1.1)]


def test_paced_replay_one_batch_per_trigger(spark, tmp_dir):
    rows = spark.createDataFrame([(b, f"n{i}", 1.0, f"2024-{b:02}") for b in range(1, 13) for i in range(b)],
                                 "batch_no int, name string, stockUpAndDrop double, currMonth string")
    messages.replay_as_messages(rows.repartition(5), tmp_dir + "/replay")
    stream = (spark.readStream.format("text").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").load(tmp_dir + "/replay"))
    seen = []
    q = (stream.writeStream.foreachBatch(lambda df, i: seen.extend(
        sorted({json.loads(r["value"])["currMonth"] for r in df.collect()}))).trigger(availableNow=True).start())
    q.awaitTermination()
    assert seen == sorted(seen) and set(seen) == {f"2024-{b:02}" for b in range(1, 13)}


def test_write_message_stream(spark, tmp_dir):
    from coweave.operators import ticks
    src = tmp_dir + "/in"
    os.makedirs(src)
    with open(src + "/0.json", "w") as f:
        f.write(_ticks_json([("a", 1.0, "m"), ("b", 2.0, "m")]))
    parsed = ticks.parse_ticks(messages.read_tick_stream(spark, "text", src)
                               .selectExpr("0L as seq", "value"))
    kv = ticks.keyed_values(parsed)
    q = messages.write_message_stream(kv, tmp_dir + "/ck", path=tmp_dir + "/out",
                                      trigger_available_now=True)
    q.awaitTermination()
    got = sorted(json.loads(r["value"])["name"] for r in spark.read.text(tmp_dir + "/out").collect())
    assert got == ["a", "b"]
