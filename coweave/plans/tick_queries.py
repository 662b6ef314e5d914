"""Registered tick queries (batch form of the streaming job) and oracles.

The message table is the JSON a producer would publish for every event
(``sources.testdata.tick_messages``); 'error' events carry a JSON object
without tick keys, which the parser maps to the default record (Q7) — a
single ("", "") group holding a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import encode_message, route_of
from ..operators import ticks as tk
from ..sources import testdata as td

TOP = tk.TOP_STREAM
BATCH_BASE_TS = "2024-01-01 00:00:00"


def parsed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.parse_ticks(td.tick_messages(spark, sf_dir))


# DuckDB building blocks: the parse result written directly from events.
T_SQL = (
    "select event_id as seq, "
    "case when event_type = 'error' then '' else cast(user_id as varchar) end as name, "
    "case when event_type = 'error' then 0.0::double else (value % 20) - 10 end as stockUpAndDrop, "
    "case when event_type = 'error' then '' else strftime(ts, '%Y-%m-%d') end as currMonth, "
    "case when event_type = 'error' then '' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as \"index\" "
    "from events")
R_SQL = ("select event_id as seq, cast(user_id as varchar) as name, (value % 20) - 10 as pct, "
         "strftime(ts, '%Y-%m-%d') as period, event_type from events")
C_SQL = "select name, currMonth as month, count(*) as total from t group by name, currMonth"
TR_SQL = ("select name, currMonth as month, product(1 + stockUpAndDrop / 100) as trend, "
          "(product(1 + stockUpAndDrop / 100) - 1) * 100 as trend_pct "
          "from t group by name, currMonth")
ROUND_SQL = "name, month, round(trend, 6) as trend, round(trend_pct, 6) as trend_pct"


def _rounded(trends: DataFrame) -> DataFrame:
    """Only what a query returns is rounded, never what is ranked."""
    return trends.select("name", "month", F.round("trend", 6).alias("trend"),
                         F.round("trend_pct", 6).alias("trend_pct"))


def q_tick_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message parsed, bad ones as the default record."""
    return parsed_ticks(spark, sf_dir)


SQL_TICK_PARSE = f"with t as ({T_SQL}) select * from t"


def q_tick_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks per (name, month)."""
    return tk.tick_count(parsed_ticks(spark, sf_dir))


SQL_TICK_COUNT = f"with t as ({T_SQL}) {C_SQL}"


def q_tick_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound growth per (name, month), factor and percent."""
    return _rounded(_trends(spark, sf_dir))


def _trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.trend_compound(parsed_ticks(spark, sf_dir))


SQL_TICK_TREND = f"with t as ({T_SQL}), c as ({TR_SQL}) select {ROUND_SQL} from c"


def q_tick_trend_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's literal pair fold in arrival order."""
    return tk.trend_pairfold(parsed_ticks(spark, sf_dir)).select(
        "name", "month", F.round("trend_fold", 6).alias("trend_fold"))


SQL_TICK_TREND_FOLD = (
    f"with t as ({T_SQL}) select name, currMonth as month, "
    "round(list_reduce(list(stockUpAndDrop order by seq), "
    "lambda x, y: (1 + x / 100) * (1 + y / 100)), 6) as trend_fold "
    "from t group by name, currMonth")


def q_tick_count_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the ten largest counts of the batch."""
    return tk.batch_top_counts(q_tick_count(spark, sf_dir))


SQL_TICK_COUNT_TOP10 = (f"with t as ({T_SQL}), c as ({C_SQL}) select * from c "
                        f"order by total desc, name, month limit {TOP}")


def q_tick_trend_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the ten largest trends of the batch."""
    return _rounded(tk.batch_top_trends(_trends(spark, sf_dir)))


SQL_TICK_TREND_TOP10 = (f"with t as ({T_SQL}), c as ({TR_SQL}) select {ROUND_SQL} from c "
                        f"order by c.trend desc, name, month limit {TOP}")


def q_tick_top10_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: ten best ticks of every daily file, stable on file order."""
    r = td.tick_rows(spark, sf_dir)
    return tk.top_n_per_period(r, TOP).select(
        "period", F.col("rank").cast("int").alias("rank"), "seq", "name", "pct")


SQL_TICK_TOP10_PER_DAY = (
    f"with r as ({R_SQL}), x as (select period, cast(row_number() over "
    "(partition by period order by pct desc, seq asc) as integer) as rank, seq, name, pct from r) "
    f"select * from x where rank <= {TOP}")


def q_tick_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: per-name total over all count messages."""
    return tk.running_total(q_tick_count(spark, sf_dir))


SQL_TICK_RUNNING_TOTAL = (f"with t as ({T_SQL}), c as ({C_SQL}) "
                          "select name, cast(sum(total) as bigint) as total from c group by name")


def q_tick_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 batch form: the last run of equal periods (event type) by arrival."""
    r = td.tick_rows(spark, sf_dir).select("seq", "name", F.col("event_type").alias("month"), "pct")
    return tk.latest_period_run(r, "month", "seq")


def q_tick_latest_run_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 where messages without a period are a run of their own: 'view'
    events carry none."""
    month = F.when(F.col("event_type") != "view", F.col("event_type"))
    r = td.tick_rows(spark, sf_dir).select("seq", "name", month.alias("month"), "pct")
    return tk.latest_period_run(r, "month", "seq")


SQL_TICK_LATEST_RUN_NULLS = (
    f"with r as (select *, nullif(event_type, 'view') as month from ({R_SQL})), "
    "l as (select month as last from r order by seq desc limit 1), "
    "c as (select coalesce(max(r.seq), -1) as cut from r, l where r.month is distinct from l.last) "
    "select r.seq, r.name, r.month, r.pct from r, c where r.seq > c.cut")


SQL_TICK_LATEST_RUN = (
    f"with r as ({R_SQL}), l as (select arg_max(event_type, seq) as last from r), "
    "c as (select coalesce(max(r.seq), -1) as cut from r, l where r.event_type <> l.last) "
    "select r.seq, r.name, r.event_type as month, r.pct from r, c where r.seq > c.cut")


def q_tick_day_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick stamped with its day's replay batch (5 s apart)."""
    r = td.tick_rows(spark, sf_dir).select("seq", "period")
    return tk.month_batches(r, "period", BATCH_BASE_TS).select(
        "seq", "period", "batch_no", "batch_ts")


SQL_TICK_DAY_BATCHES = (
    f"with r as ({R_SQL}), p as (select period, cast(dense_rank() over (order by period) as integer) "
    "as batch_no from (select distinct period from r)) "
    f"select r.seq, r.period, p.batch_no, strftime(timestamp '{BATCH_BASE_TS}' + "
    "to_seconds((p.batch_no - 1) * 5), '%Y-%m-%d %H:%M:%S') as batch_ts "
    "from r join p on p.period = r.period")


def q_message_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 + F4 + X4: count and trend results encoded as JSON messages on
    one merged topic, then routed back by their keys."""
    ticks = parsed_ticks(spark, sf_dir)
    # one pass gives both results; each row makes a message for either topic
    both = (ticks.groupBy("name", F.col("currMonth").alias("month"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.product(F.lit(1.0) + F.col("stockUpAndDrop") / 100).alias("trend")))
    key = {"name": F.col("name"), "month": F.col("month")}
    msgs = both.select(F.explode(F.array(encode_message(key | {"total": F.col("total")}),
                                         encode_message(key | {"trend": F.col("trend")}))).alias("value"))
    # read back with a single parse
    m = msgs.select(F.from_json("value", "map<string,string>").alias("m"))
    routed = m.select(route_of(F.col("m")).alias("route"), F.col("m")["name"].alias("name"),
                      F.col("m")["month"].alias("month"))
    return routed.where(F.col("route").isNotNull())


SQL_MESSAGE_ROUTES = (
    f"with t as ({T_SQL}), c as ({C_SQL}), tr as ({TR_SQL}) "
    "select 'total' as route, name, month from c union all "
    "select 'trend' as route, name, month from tr")


QUERIES = {
    "tick_parse": q_tick_parse,
    "tick_count": q_tick_count,
    "tick_trend": q_tick_trend,
    "tick_trend_fold": q_tick_trend_fold,
    "tick_count_top10": q_tick_count_top10,
    "tick_trend_top10": q_tick_trend_top10,
    "tick_top10_per_day": q_tick_top10_per_day,
    "tick_running_total": q_tick_running_total,
    "tick_latest_run": q_tick_latest_run,
    "tick_latest_run_nulls": q_tick_latest_run_nulls,
    "tick_day_batches": q_tick_day_batches,
    "message_routes": q_message_routes,
}
ORACLES = {
    "tick_parse": SQL_TICK_PARSE,
    "tick_count": SQL_TICK_COUNT,
    "tick_trend": SQL_TICK_TREND,
    "tick_trend_fold": SQL_TICK_TREND_FOLD,
    "tick_count_top10": SQL_TICK_COUNT_TOP10,
    "tick_trend_top10": SQL_TICK_TREND_TOP10,
    "tick_top10_per_day": SQL_TICK_TOP10_PER_DAY,
    "tick_running_total": SQL_TICK_RUNNING_TOTAL,
    "tick_latest_run": SQL_TICK_LATEST_RUN,
    "tick_latest_run_nulls": SQL_TICK_LATEST_RUN_NULLS,
    "tick_day_batches": SQL_TICK_DAY_BATCHES,
    "message_routes": SQL_MESSAGE_ROUTES,
}


def q_tick_trend_top10_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 with ``per_period=True`` (Q6): ten largest trends of every day."""
    return _rounded(tk.batch_top_trends(_trends(spark, sf_dir), per_period=True))


SQL_TICK_TREND_TOP10_PER_DAY = (
    f"with t as ({T_SQL}), c as ({TR_SQL}), r as (select *, row_number() over "
    "(partition by month order by trend desc, name asc) as rn from c) "
    f"select {ROUND_SQL} from r where rn <= {TOP}")

QUERIES["tick_trend_top10_per_day"] = q_tick_trend_top10_per_day
ORACLES["tick_trend_top10_per_day"] = SQL_TICK_TREND_TOP10_PER_DAY
