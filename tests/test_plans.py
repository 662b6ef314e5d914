"""Plan properties behind the scale claims (skew splitting, partial limits)."""

from pyspark.sql import functions as F

from coweave.operators import cooccur, graph as gr, khop, ticks
from coweave.plans import graph_queries as gq
from coweave.session import cut_lineage
from conftest import graph_of


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_work_gets_blocks_small_work_does_not(spark):
    rows = [(0, m) for m in range(60)] + [(1, 1), (1, 2)]
    m = spark.createDataFrame(rows, "work_id bigint, member bigint")
    nb = {r["work_id"]: r["nb"] for r in cooccur.work_blocks(m, block_rows=8)
          .select("work_id", "nb").distinct().collect()}
    assert nb == {0: 8, 1: 1}
    # every block pair of the hot work is its own join key
    keys = (cooccur.work_blocks(m, block_rows=8).where("work_id = 0")
            .select("blk").distinct().count())
    assert keys == 8


def test_top_per_group_has_partial_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("period"),
                                  F.col("id").alias("seq"), (F.col("id") % 13).cast("double").alias("pct"))
    top = ticks.top_n_per_period(df, 3)
    top.collect()
    assert "WindowGroupLimit" in _plan(top)


def test_aggregates_are_partial(spark):
    t = spark.createDataFrame([(1, "a", 1.0, "m")] * 10 + [(2, "b", 2.0, "m")],
                              "seq bigint, name string, stockUpAndDrop double, currMonth string")
    plan = _plan(ticks.trend_compound(t))
    assert "partial_product" in plan


SMALL = "/root/testdata/sf0.001"


def test_flagship_and_seeds_build_no_pairs(spark):
    for df in (gq.q_coop_top20(spark, SMALL), gq._busiest(spark, SMALL)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "bi#" not in plan and "bj#" not in plan      # the block keys of the pair join


def test_hot_work_above_the_default_block(spark):
    n = cooccur.DEFAULT_BLOCK_ROWS + 200
    m = spark.range(n).select(F.lit(0).cast("bigint").alias("work_id"), F.col("id").alias("member"))
    assert cooccur.work_blocks(m).agg(F.max("nb")).first()[0] == 2
    assert cooccur.cooccurrence_edges(m).count() == n * (n - 1) // 2


def _skewed(spark):
    """Settings under which a few thousand rows of one key count as skewed."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    return before


def _reset(spark, before):
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_joins_on_a_hub_are_split(spark):
    src = F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0)
    hub = spark.range(1, 8001).select(src.alias("src"), F.col("id").alias("dst"),
                                      F.lit(1).cast("bigint").alias("w")).repartition(8)
    names = spark.range(0, 8001).select("id", F.lit("x").alias("name"))
    before = _skewed(spark)
    try:
        # the label join of the triplets
        t = gr.attach_label(hub, names, "src", "src_name")
        t.collect()
        assert "skew=true" in _plan(t)
        # the frontier join through the hub
        g = gr.CoGraph(names, hub)
        ring = khop.khop_ring(g, spark.createDataFrame([(0,)], "id bigint"), 1)
        assert ring.count() == 7840
        # the co-member join of a hot work
        m = hub.select(F.col("src").alias("work_id"), F.col("dst").alias("member"))
        co = m.join(cut_lineage(m.select("work_id").distinct()), "work_id")   # as snowball writes them
        co.collect()
        assert "skew=true" in _plan(co)
    finally:
        _reset(spark, before)
