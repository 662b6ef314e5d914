"""Tick operators (A7–A10, P8, T4, T5, W7, F4) and scalar functions."""

import math
import random
from functools import reduce

from pyspark.sql import functions as F

from coweave.functions import maps, scalars
from coweave.operators import ticks


def _ticks(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, name string, stockUpAndDrop double, currMonth string")


def test_fold_values_from_fixtures(spark):
    t = _ticks(spark, [(1, "s", 1.0, "m"), (2, "s", 2.0, "m"), (3, "s", 3.0, "m"), (4, "x", 5.0, "m")])
    comp = {r["name"]: r["trend"] for r in ticks.trend_compound(t).collect()}
    fold = {r["name"]: r["trend_fold"] for r in ticks.trend_pairfold(t).collect()}
    assert math.isclose(comp["s"], 1.01 * 1.02 * 1.03) and math.isclose(comp["x"], 1.05)
    assert math.isclose(fold["s"], _seq_fold([1.0, 2.0, 3.0])) and fold["x"] == 5.0


def _seq_fold(ps):
    return reduce(lambda l, r: (1 + l / 100) * (1 + r / 100), ps)


def test_tree_fold_hot_group_matches_sequential(spark):
    rnd = random.Random(11)
    rows, seq = [], 0
    for _ in range(700):
        seq += rnd.randint(1, 3)
        name = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", "c"])
        rows.append((seq, name, round(rnd.uniform(-10, 10), 2), "m"))
    t = _ticks(spark, rows)
    got = {r["name"]: r["trend_fold"] for r in ticks.trend_pairfold(t, run_rows=4).collect()}
    for name in {r[1] for r in rows}:
        want = _seq_fold([r[2] for r in rows if r[1] == name])
        assert math.isclose(got[name], want, rel_tol=1e-9, abs_tol=1e-9), name


def test_fold_gives_one_answer_however_it_is_cut(spark):
    groups = {"inf": [1.0] * 9 + [math.inf, -20000.0] + [2.0] * 9, "zero": [math.inf, -100.0, 3.0],
              "large": [1e6, -20000.0, 5.0, -3.0, 1e5, 7.0] * 4, "minus": [-math.inf, 4.0, -250.0],
              "one": [-7.0], "long": [((i * 37) % 41) / 4 - 5 for i in range(9000)]}
    rows = [(i, n, p, "m") for n, ps in groups.items() for i, p in enumerate(ps)]
    for run_rows in (1, 4, 512, 4096):
        got = {r["name"]: r["trend_fold"] for r in ticks.trend_pairfold(_ticks(spark, rows), run_rows=run_rows).collect()}
        for n, ps in groups.items():
            want = _seq_fold(ps)
            assert got[n] == want or math.isclose(got[n], want, rel_tol=1e-9) or (got[n] != got[n] and want != want), n


def test_counts_and_running_total(spark):
    t = _ticks(spark, [(1, "a", 1.0, "m1"), (2, "a", 1.0, "m1"), (3, "a", 1.0, "m2"), (4, "b", 1.0, "m1")])
    c = ticks.tick_count(t)
    assert sorted(tuple(r) for r in c.collect()) == [("a", "m1", 2), ("a", "m2", 1), ("b", "m1", 1)]
    assert {r["name"]: r["total"] for r in ticks.running_total(c).collect()} == {"a": 3, "b": 1}
    top = ticks.batch_top_counts(c, 2).collect()
    assert [(r["name"], r["month"]) for r in top] == [("a", "m1"), ("a", "m2")]


def test_parse_tick_defaults(spark):
    msgs = spark.createDataFrame([
        (1, '{"name":"steel","stockUpAndDrop":1.5,"currMonth":"2024-01","index":"x"}'),
        (2, "not json"),
        (3, '{"name":"iron","currMonth":"2024-01","index":"x"}'),
        (4, '{"name":"gold","stockUpAndDrop":2,"currMonth":"2024-02","index":"y"}'),
    ], "seq bigint, value string")
    got = {r["seq"]: tuple(r)[1:] for r in ticks.parse_ticks(msgs).collect()}
    assert got[1] == ("steel", 1.5, "2024-01", "x")
    assert got[2] == ("", 0.0, "", "")
    assert got[3] == ("iron", 0.0, "2024-01", "x")
    assert got[4] == ("gold", 2.0, "2024-02", "y")
    assert ticks.parse_ticks(msgs, drop_bad=True).count() == 2


def test_latest_period_run(spark):
    rows = [(1, "a", "m1"), (2, "b", "m2"), (3, "c", "m1"), (4, "d", "m1")]
    df = spark.createDataFrame(rows, "seq bigint, name string, month string")
    assert [r["seq"] for r in ticks.latest_period_run(df).orderBy("seq").collect()] == [3, 4]
    one = spark.createDataFrame(rows[2:], "seq bigint, name string, month string")
    assert ticks.latest_period_run(one).count() == 2


def test_latest_period_run_with_null_periods(spark):
    def last(months):
        df = spark.createDataFrame([(i, m) for i, m in enumerate(months)], "seq bigint, month string")
        return sorted(r["seq"] for r in ticks.latest_period_run(df).collect())
    assert last(["m1", None, "m1"]) == [2]
    assert last(["m1", "m1", None]) == [2]
    assert last([None, None]) == [0, 1]
    assert last(["m1", None, None]) == [1, 2]
    assert last([]) == []


def test_top_n_per_period_stable(spark):
    rows = [(i, f"n{i}", float(i % 3), "d1") for i in range(12)] + [(100, "z", 1.0, "d2")]
    df = spark.createDataFrame(rows, "seq bigint, name string, pct double, period string")
    got = ticks.top_n_per_period(df, 4).where("period = 'd1'").orderBy("rank").collect()
    assert [r["seq"] for r in got] == [2, 5, 8, 11]


def test_month_batches(spark):
    df = spark.createDataFrame([(1, "2024-02"), (2, "2024-01"), (3, "2024-02")], "seq bigint, p string")
    got = {r["seq"]: (r["batch_no"], r["batch_ts"])
           for r in ticks.month_batches(df, "p", "2024-01-01 00:00:00").collect()}
    assert got == {2: (1, "2024-01-01 00:00:00"), 1: (2, "2024-01-01 00:00:05"),
                   3: (2, "2024-01-01 00:00:05")}


def test_scalars(spark):
    df = spark.createDataFrame([("steel/x", "1.5%", "2024-03-07.csv"), ("oil", "--", "x"),
                                ("a/b/c", "NaN", "y")], "c string, p string, f string")
    r = df.select(scalars.category_prefix(F.col("c")).alias("cat"),
                  scalars.parse_percent(F.col("p")).alias("pct"),
                  *[x.alias(n) for x, n in zip(scalars.date_parts_from_filename(F.col("f")),
                                                ("y", "m", "d"))]).collect()
    assert [(x["cat"], x["pct"]) for x in r] == [("steel", 1.5), ("oil", 0.0), ("a", 0.0)]
    assert (r[0]["y"], r[0]["m"], r[0]["d"]) == ("2024", "03", "07")
    odd = spark.createDataFrame([(p,) for p in ("1.5d", "12f", "0x10", "", " 2 %", "-.5%", "1e2", "+3.%", "inf")], "p string")
    got = [x[0] for x in odd.select(scalars.parse_percent(F.col("p"))).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 2.0, -0.5, 100.0, 3.0, math.inf]


def test_staff_map_and_routes(spark):
    df = spark.createDataFrame([
        ('{"data":{"staff":[{"mid":1,"name":"a"},{"mid":2,"name":"b"},{"mid":1,"name":"c"}]}}',),
        ('{"data":{}}',), ('{"total":3,"name":"x"}',), ('{"trend":1.0}',), ('{"k":1}',),
    ], "v string")
    got = df.select(scalars.staff_map(F.col("v")).alias("m"),
                    scalars.message_route(F.col("v")).alias("r")).collect()
    assert got[0]["m"] == {1: "c", 2: "b"} and got[1]["m"] is None
    assert [g["r"] for g in got[2:]] == ["total", "trend", None]


def test_map_functions(spark):
    df = spark.sql("select map(1L, 2, 2L, 1) as a, map(2L, 0, 3L, 1) as b")
    r = df.select(maps.map_union_min("a", "b").alias("u"),
                  maps.map_minus_decrement("a", "b").alias("d"),
                  maps.keys_with_value(F.col("b"), 0).alias("z"),
                  maps.key_except(F.col("a"), F.col("b")).alias("x")).first()
    assert r["u"] == {1: 2, 2: 0, 3: 1} and r["d"] == {1: 1}
    assert r["z"] == [2] and r["x"] == [1]


def test_date_spine(spark):
    df = spark.sql("select date'2024-01-30' as s, date'2024-02-02' as e")
    got = [str(r[0]) for r in df.select(scalars.date_spine(F.col("s"), F.col("e"))).collect()]
    assert got == ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"]
