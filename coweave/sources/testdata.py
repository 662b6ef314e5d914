"""Views over the driver-generated parquet tables.

These only reshape the given tables into the schemas the operators expect
(membership rows, vertex labels, tick messages); they do none of the
operators' work.  Every view reads its whole table, so the work grows with it.

Mapping (fixed):
  memberships   work_id = l_orderkey, member = l_partkey from ``lineitem``,
                distinct
  vertices      id = p_partkey, name = p_name from ``part``
  dense graph   work_id = event type and ten-minute slot of ``events.ts``,
                member = user_id, distinct; the densest one by the hour
  ticks         name = user_id as text, pct = (value % 20) - 10,
                period = ts as yyyy-MM-dd, index = ts as text, seq = event_id;
                'error' events carry their ``props`` JSON as the message, a
                valid object without the tick keys
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cooccur import dealt, partitions_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id BIGINT, member BIGINT), one row per member of a work."""
    li = table(spark, sf_dir, "lineitem")
    # the number of rows stands in the files' footers
    rows = li.select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("member"))
    return dealt(rows, partitions_for(spark, li.count()), "work_id", "member").distinct()


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id BIGINT, name STRING) labels of the membership graph."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def event_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denser graph: users with an event of one type in the same ten minutes.
    (work_id STRING, member BIGINT)."""
    ev = table(spark, sf_dir, "events")
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600)
    return ev.select(F.concat_ws("|", "event_type", slot.cast("string")).alias("work_id"),
                     F.col("user_id").alias("member")).distinct()


def event_hour_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densest graph: users with an event of one type in the same hour.
    (work_id STRING, member BIGINT)."""
    ev = table(spark, sf_dir, "events")
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return ev.select(F.concat_ws("|", "event_type", slot.cast("string")).alias("work_id"),
                     F.col("user_id").alias("member")).distinct()


def event_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of ``events`` as a vertex; the label is the id as text."""
    ev = table(spark, sf_dir, "events")
    return (ev.select(F.col("user_id").alias("id")).distinct()
              .select("id", F.col("id").cast("string").alias("name")))


def tick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ticks (seq, name, pct, period, index) straight from ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("name"),
        ((F.col("value") % 20) - 10).alias("pct"),
        F.date_format("ts", "yyyy-MM-dd").alias("period"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("index"),
        F.col("event_type"),
    )


def tick_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq BIGINT, value STRING): the JSON text a producer would publish.

    Field names are the fixed message keys of the reference's tick record.
    """
    ev = table(spark, sf_dir, "events")
    msg = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("name"),
        ((F.col("value") % 20) - 10).alias("stockUpAndDrop"),
        F.date_format("ts", "yyyy-MM-dd").alias("currMonth"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("index")))
    return ev.select(F.col("event_id").alias("seq"),
                     F.when(F.col("event_type") == "error", F.col("props"))
                      .otherwise(msg).alias("value"))
