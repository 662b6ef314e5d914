"""Scalar functions."""

from pyspark.sql import functions as F

from coweave.functions import scalars


def test_staff_map_parses_a_text_once_and_keeps_the_last_name(spark):
    text = '{"data": {"staff": [{"mid": 1, "name": "a"}, {"mid": 2, "name": "b"}, {"mid": 1, "name": "c"}]}}'
    rows = [(1, text), (2, '{"data": {"staff": []}}'), (3, "{}"), (4, "no json"), (5, None)]
    df = spark.createDataFrame(rows, "id int, value string")
    m = df.select("id", scalars.staff_map(F.col("value")).alias("m"))
    got = {r["id"]: r["m"] for r in m.collect()}
    assert {k: {str(a): b for a, b in v.items()} if v is not None else None for k, v in got.items()} == {
        1: {"1": "c", "2": "b"}, 2: {}, 3: None, 4: None, 5: None}
    assert [r["id"] for r in m.where(scalars.has_members(F.col("m"))).collect()] == [1]
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json(") + plan.lower().count("jsontostructs(") == 1
