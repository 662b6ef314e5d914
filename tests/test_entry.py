"""Driver contract: entry() runs; every query has a matching oracle key."""

import __spark_entry__ as entry
from coweave.operators import graph as gr
from coweave.operators import ticks
from coweave.plans import catalog
from pyspark.sql import functions as F

from conftest import graph_of


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "id", "name", "coworks"]
    assert 0 < len(rows) <= 20


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


def test_reduce_by_key_and_map_vertices(spark):
    g = graph_of(spark, [(1, 2, 3), (1, 3, 1)])
    r = gr.reduce_by_key(g.symmetric(), ["src"], {"w": F.sum("w")})
    assert {x["src"]: x["w"] for x in r.collect()} == {1: 4, 2: 3, 3: 1}
    mv = gr.map_vertices(g, F.col("id") * 10)
    assert sorted(x["attr"] for x in mv.collect()) == [10, 20, 30]


def test_top_per_period_option(spark):
    c = spark.createDataFrame([("a", "m1", 5), ("b", "m1", 4), ("c", "m2", 1)],
                              "name string, month string, total bigint")
    assert [r["name"] for r in ticks.batch_top_counts(c, 1).collect()] == ["a"]
    assert sorted(r["name"] for r in ticks.batch_top_counts(c, 1, per_period=True).collect()) == ["a", "c"]
