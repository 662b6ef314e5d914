"""Registered queries of the file sources and sinks and of the scalar, map and
ranking functions.  A sink query writes what it is named for under
``spark.checkpoint.dir``, reads it back through the library's own reader and
returns the rows; its oracle is the table the rows came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps, scalars
from ..operators import cooccur, graph as gr, khop, ranking, ticks as tk
from ..session import scratch_path
from ..sources import daily_csv, daily_source, gexf, listings, messages, testdata as td, text
from . import graph_queries as gq
from .tick_queries import C_SQL, R_SQL, T_SQL, parsed_ticks

TOP = gq.TOP


# -- S1, S2, S12, S14: plain-text graph files ---------------------------------

def q_vertices_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 + S1 + P1: ``id label`` lines written and read."""
    path = scratch_path(spark)
    text.write_vertices(td.vertices(spark, sf_dir), path)
    return text.read_vertices(spark, path)


SQL_VERTICES_ROUND_TRIP = "select p_partkey as id, trim(p_name) as name from part"


def q_pair_counts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 + S2: ``src dst w`` lines of the co-occurrence counts."""
    path = scratch_path(spark)
    text.write_pair_counts(cooccur.cooccurrence_edges(td.memberships(spark, sf_dir)), path)
    return text.read_edges(spark, path)


SQL_PAIR_COUNTS_ROUND_TRIP = gq.SQL_COOCCUR_EDGES


# -- S3, S13, P10, A5, M4: membership listings --------------------------------

def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, members): every work once, listed under its least member."""
    # a work's members end in one row anyway, so the rows may be dealt by work
    n = cooccur.partitions_for(spark, td.table(spark, sf_dir, "lineitem").count())
    works = cooccur.dealt(td.memberships(spark, sf_dir), n, "work_id").groupBy("work_id").agg(
        F.array_sort(F.collect_set("member")).alias("members"))
    return works.select(F.element_at("members", 1).alias("member"), "members")


def q_memberships_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + P10 + S3 + A5: listings written in order of their members and read;
    pair counts of what was read, both directions folded into one."""
    path = scratch_path(spark)
    listings.write_listings(_listings(spark, sf_dir), path)
    rows = text.membership_rows(listings.read_listings(spark, path))
    load = cooccur.work_load(rows)
    both = cooccur.symmetrize(cooccur.cooccurrence_edges(rows, load=load), one_pass=True)
    return cooccur.fold_symmetric(both, partitions=cooccur.partitions_for(spark, 2 * load[1]))


SQL_MEMBERSHIPS_ROUND_TRIP = (f"with m as ({gq.M_SQL}), e as ({gq.E_SQL}) "
                              "select src, dst, cast(2 * w as bigint) as w from e")


def q_member_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + S3: all works listed under one member, of two appends, found by the
    index: the member with the most listings, ties to the smaller id."""
    path = scratch_path(spark)
    lines = _listings(spark, sf_dir)
    size = F.size("members") % 2
    listings.write_listings(lines.where(size == 0), path, append="even")
    listings.write_listings(lines.where(size == 1), path, append="odd")
    most = (listings.index_of(spark, path).groupBy("member").agg(F.sum("rows").alias("n"))
            .orderBy(F.desc("n"), "member").first())
    if most is None:
        return spark.createDataFrame([], "member bigint, line string")
    got = listings.read_member(spark, path, most["member"])
    return got.select("member", maps.ids_to_line(F.col("members")).alias("line"))


def q_member_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: every work's members as one line."""
    return _listings(spark, sf_dir).select("member", maps.ids_to_line(F.col("members")).alias("line"))


SQL_MEMBER_LISTING = (
    f"with m as ({gq.M_SQL}), l as (select min(member) as member, "
    "string_agg(cast(member as varchar), ' ' order by member) as line from m group by work_id), "
    "t as (select member from l group by member order by count(*) desc, member limit 1) "
    "select l.member, l.line from l join t using (member)")


SQL_MEMBER_LINES = (f"with m as ({gq.M_SQL}) select min(member) as member, "
                    "string_agg(cast(member as varchar), ' ' order by member) as line from m group by work_id")


def q_distinct_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + J9: the members of all works, each known to the vertex list."""
    m = cooccur.check_membership(td.memberships(spark, sf_dir), td.vertices(spark, sf_dir))
    return cooccur.dedup_members(m)


SQL_DISTINCT_MEMBERS = "select distinct l_partkey as member from lineitem"


# -- S4, S15, P2-P5, P11, T5: daily tables -------------------------------------

DAILY_COLUMNS = ["date", "c0", "c1", "c2", *[f"c{i}" for i in range(3, daily_csv.N_COLUMNS)]]


def _daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, line): a table line per event in the layout of a daily file."""
    r = td.tick_rows(spark, sf_dir)
    cells = [F.concat(F.col("name"), F.lit("/user")), F.col("seq").cast("string"),
             F.concat(F.col("pct").cast("string"), F.lit("%")),
             *[F.lit("") for _ in range(3, daily_csv.N_COLUMNS)]]
    return r.select(F.col("period").alias("date"), "seq", F.concat_ws(",", *cells).alias("line"))


def q_daily_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + P2-P5: one file per day with two leading rows, read and parsed."""
    path = _daily_folder(spark, sf_dir)
    return _daily_columns(daily_source.read_daily(spark, path, day_folders=True))


def q_daily_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + P2-P5: the newest day alone, whose filter chooses the file; long
    files are cut into parts."""
    path = _daily_folder(spark, sf_dir)
    newest = td.tick_rows(spark, sf_dir).agg(F.max("period")).first()[0]
    return _daily_columns(daily_source.read_daily(spark, path, day_folders=True, days=F.col("date") == newest,
                                                  split_bytes=4096))


def _daily_folder(spark: SparkSession, sf_dir: str) -> str:
    """The daily tables, one file per day in a folder named for it."""
    path = scratch_path(spark)
    head = F.concat_ws("\n", *[F.lit(",".join(f"h{i}" for i in range(daily_csv.N_COLUMNS)))] * daily_csv.SKIP_ROWS)
    lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
    days = _daily_rows(spark, sf_dir).groupBy("date").agg(
        F.concat(head, F.lit("\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("value"))
    # a file per day, named for it by its folder
    days.repartition("date").write.partitionBy("date").text(path)
    return path


def _daily_columns(rows: DataFrame) -> DataFrame:
    return rows.select("file", "year", "month", "day", "month_key", F.col("pos").cast("int").alias("pos"),
                       "name", "pct")


SQL_DAILY_FILES = (
    f"with r as ({R_SQL}) select period as file, substr(period, 1, 4) as year, substr(period, 6, 2) as month, "
    "substr(period, 9, 2) as day, substr(period, 1, 7) as month_key, "
    "cast(row_number() over (partition by period order by seq) - 1 as integer) as pos, name, pct from r")


SQL_DAILY_NEWEST = f"select * from ({SQL_DAILY_FILES}) where file = (select max(period) from ({R_SQL}))"


def q_daily_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 + P11: a CSV per date with a header, columns dropped and named by
    position beforehand."""
    path = scratch_path(spark)
    r = td.tick_rows(spark, sf_dir).select("name", "seq", "event_type", "pct", "period")
    named = scalars.drop_rename_by_position(r, [1, 2], ["label", "percent", "date"])
    daily_csv.write_daily_csv(named, path)
    return spark.read.csv(path, header=True, schema="label string, percent double, date string")


SQL_DAILY_CSV_ROUND_TRIP = f"with r as ({R_SQL}) select name as label, pct as percent, period as date from r"


# -- S7, S8, S16, S11: results and messages ------------------------------------

def q_replayed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + P6 + P8: ticks written as JSON messages per replay batch and parsed."""
    path = scratch_path(spark)
    rows = tk.month_batches(td.tick_rows(spark, sf_dir), "period", "2024-01-01 00:00:00").select(
        "batch_no", "name", F.col("pct").alias("stockUpAndDrop"), F.col("period").alias("currMonth"), "index")
    messages.replay_as_messages(rows, path)
    got = spark.read.option("recursiveFileLookup", "true").text(path).select(F.lit(0).alias("seq"), "value")
    return tk.parse_ticks(got).select("name", "stockUpAndDrop", "currMonth", "index")


SQL_REPLAYED_MESSAGES = (f"with r as ({R_SQL}) select r.name, r.pct as stockUpAndDrop, r.period as currMonth, "
                         "strftime(e.ts, '%Y-%m-%d %H:%M:%S') as \"index\" from r join events e on e.event_id = r.seq")


def q_metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S16 + S9: two results saved under their names, one rewritten, and
    read back; the second by way of its JSON pair list."""
    path, pairs = scratch_path(spark), scratch_path(spark)
    top = gq.q_coop_top20(spark, sf_dir)
    messages.export_pairs_json(top, "name", "coworks").write.text(pairs)
    saved = messages.read_result_json(spark, pairs).select("pos", "name", "value")
    messages.write_metric(saved, "coworks", path)
    messages.write_metric(saved, "coworks", path)
    works = cooccur.count_works(td.memberships(spark, sf_dir))
    messages.write_metric(works.select(F.lit(1).alias("pos"), F.lit("works").alias("name"),
                                       F.col("works").cast("double").alias("value")), "totals", path)
    return spark.read.parquet(path).select("metric", "pos", "name", "value")


SQL_METRICS_TABLE = (
    f"with t as ({gq.SQL_COOP_TOP20}) select 'coworks' as metric, rank as pos, name, cast(coworks as double) as value "
    f"from t union all select 'totals', 1, 'works', cast(works as double) from ({gq.SQL_WORKS_MEMBERS})")


def q_gexf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + S11: the graph written as GEXF and its links read back."""
    path = scratch_path(spark)
    gexf.write_gexf(gq.event_graph(spark, sf_dir), path)
    _, edges = gexf.read_gexf(spark, path)
    return edges.select(F.col("source").cast("bigint").alias("src"), F.col("target").cast("bigint").alias("dst"),
                        F.col("weight").cast("bigint").alias("w"))


SQL_GEXF_ROUND_TRIP = f"{gq.EV_CTE} select src, dst, cast(w as bigint) as w from s"


# -- T1, T2, T6, T7, A12, F1, P15, P16, A13 ------------------------------------

def q_sorted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels with the exact place each has in the order."""
    return ranking.placed_by_label(td.vertices(spark, sf_dir)).select("place", "id", "name")


SQL_SORTED_LABELS = ("select row_number() over (order by p_name, p_partkey) as place, "
                     "p_partkey as id, p_name as name from part")


def q_ranked_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + A13 + P16: members by falling degree, from a keyed reduce."""
    g = gq.event_graph(spark, sf_dir)
    d = gr.reduce_by_key(g.symmetric().withColumnRenamed("src", "id"), ["id"], {"coworks": F.sum("w")})
    ranked = ranking.placed_by_value(gr.attach_label(d, g.vertices), "coworks")
    name, value = scalars.view_pairs(F.col("name"), F.col("coworks").cast("string"))
    return ranked.select("place", name.alias("name"), value.alias("value"))


SQL_RANKED_DEGREES = (f"{gq.EV_CTE}, d as (select v.name, s.src as id, cast(sum(s.w) as double) as value from s "
                      "join v on v.id = s.src group by s.src, v.name) "
                      "select row_number() over (order by value desc, name, id) as place, name, value from d")


def q_head_of_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 + T7 + T6: the first 15 of the top 20, shown by rising value."""
    head = ranking.head_slice(gq.q_coop_top20(spark, sf_dir), 15)
    return ranking.sort_ascending_view(head, "coworks", ["name", "id"]).select("rank", "id", "name", "coworks")


SQL_HEAD_OF_RANKING = f"select * from ({gq.SQL_COOP_TOP20}) where rank <= 15"


def q_label_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 20's labels in one text."""
    return ranking.concat_lines(gq.q_coop_top20(spark, sf_dir), "name", "rank", "; ")


SQL_LABEL_LINE = f"select string_agg(name, '; ' order by rank) as text from ({gq.SQL_COOP_TOP20})"


def q_chosen_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + P15: chosen vertices with a new attribute."""
    g = gr.CoGraph(td.vertices(spark, sf_dir), None)
    v = gr.map_vertices(g, F.concat_ws(":", F.col("id").cast("string"), F.upper("name")))
    return scalars.filter_ids(v, [1, 7, 150])


SQL_CHOSEN_VERTICES = ("select p_partkey as id, cast(p_partkey as varchar) || ':' || upper(p_name) as attr "
                       "from part where p_partkey in (1, 7, 150)")


def q_label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of an ``id label`` line by position, cast; a field that does
    not parse is null."""
    line = F.concat_ws(" ", F.col("id").cast("string"), "name")
    v = td.vertices(spark, sf_dir).select(line.alias("line"))
    part = lambda pos, to: scalars.split_cast(F.col("line"), " ", pos, to)
    return v.select(part(0, "bigint").alias("id"), part(1, "string").alias("word"), part(1, "bigint").alias("number"))


SQL_LABEL_PARTS = ("select p_partkey as id, split_part(p_name, ' ', 1) as word, "
                   "try_cast(split_part(p_name, ' ', 1) as bigint) as number from part")


# -- M1-M3, F3, X2, X3: map columns ---------------------------------------------

def _user_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b): per user the hour -> count maps of its events on even and
    on odd days of the month."""
    ev = td.table(spark, sf_dir, "events")
    n = (ev.groupBy("user_id", (F.dayofmonth("ts") % 2).alias("odd"), F.hour("ts").alias("h"))
         .agg(F.count(F.lit(1)).cast("int").alias("n")))
    entries = lambda odd: F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("odd") == odd, F.struct("h", "n")))))
    return n.groupBy(F.col("user_id").alias("id")).agg(entries(0).alias("a"), entries(1).alias("b"))


def _pairs(m) -> "F.Column":
    """A map as one line of its entries in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(
        e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), " ")


def _keys(a) -> "F.Column":
    return F.array_join(F.transform(F.array_sort(a), lambda k: k.cast("string")), " ")


def q_map_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2 + M3 + F3 + X2 + X3 on two map columns."""
    a, b = F.col("a"), F.col("b")
    return _user_maps(spark, sf_dir).select(
        "id", _pairs(maps.map_union_min(a, b)).alias("least"),
        _pairs(maps.map_minus_decrement(a, b)).alias("minus"),
        _pairs(maps.map_merge_first_wins(a, b)).alias("first_wins"),
        _keys(maps.keys_with_value(a, 1)).alias("ones"),
        _keys(maps.key_union(a, b)).alias("either"), _keys(maps.key_except(a, b)).alias("only_a"))


SQL_MAP_MERGES = (
    "with n as (select user_id, hour(ts) as h, count(*) filter (day(ts) % 2 = 0) as x, "
    "count(*) filter (day(ts) % 2 = 1) as y from events group by all), "
    "l as (select user_id as id, h, x, y, cast(h as varchar) as k from n) "
    "select id, "
    "coalesce(string_agg(k || '=' || cast(case when x = 0 then y when y = 0 then x else least(x, y) end as varchar), ' ' order by h), '') as least, "
    "coalesce(string_agg(k || '=' || cast(x - 1 as varchar), ' ' order by h) filter (x > 0 and y = 0), '') as minus, "
    "coalesce(string_agg(k || '=' || cast(case when x > 0 then x else y end as varchar), ' ' order by h), '') as first_wins, "
    "coalesce(string_agg(k, ' ' order by h) filter (x = 1), '') as ones, "
    "coalesce(string_agg(k, ' ' order by h), '') as either, "
    "coalesce(string_agg(k, ' ' order by h) filter (x > 0 and y = 0), '') as only_a "
    "from l group by id")


def q_first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 (tables): per user the type of its first event."""
    r = td.tick_rows(spark, sf_dir).select("name", "event_type", "seq")
    return khop.first_seen_label(r, "name", "event_type", "seq")


SQL_FIRST_LABELS = f"with r as ({R_SQL}) select name, arg_min(event_type, seq) as event_type from r group by name"


# -- P7, P9, P12, P13, F5 ---------------------------------------------------------

def q_works_staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + F5: each order's parts as a JSON staff list, read as mid -> name;
    works with more than one listed line keep one name per mid."""
    li = td.table(spark, sf_dir, "lineitem")
    staff = F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("mid"), F.col("l_returnflag").alias("name"))))
    data = F.struct(F.transform(staff, lambda x: F.struct(x["mid"].alias("mid"), x["name"].alias("name"))).alias("staff"))
    works = li.groupBy("l_orderkey").agg(F.to_json(F.struct(data.alias("data"))).alias("value"))
    m = works.select(F.col("l_orderkey").alias("work_id"), scalars.staff_map(F.col("value")).alias("m"))
    return (m.where(scalars.has_members(F.col("m")))
            .select("work_id", F.explode("m").alias("mid", "name")))


SQL_WORKS_STAFF = ("select l_orderkey as work_id, l_partkey as mid, arg_max(l_returnflag, (l_linenumber, l_returnflag)) as name "
                   "from lineitem group by l_orderkey, l_partkey")


def q_tick_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 + P13: positional values made records, then ((name, month), value)."""
    r = td.tick_rows(spark, sf_dir)
    rec = r.select("seq", scalars.to_record([F.col(c) for c in ("name", "pct", "period", "index")]).alias("t"))
    flat = rec.select("seq", "t.*")
    return tk.keyed_values(flat, F.col("stockUpAndDrop"))


SQL_TICK_RECORDS = f"with r as ({R_SQL}) select name, period as month, pct as value from r"


def q_days_without_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of each user's span, with its number of ticks."""
    ev = td.table(spark, sf_dir, "events")
    span = ev.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    days = span.select("user_id", scalars.date_spine(F.col("lo"), F.col("hi")).alias("day"))
    n = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return (days.join(n, ["user_id", "day"], "left")
            .select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n")))


SQL_DAYS_WITHOUT_TICKS = (
    "with s as (select user_id, cast(min(ts) as date) as lo, cast(max(ts) as date) as hi from events group by user_id), "
    "d as (select user_id, unnest(generate_series(lo, hi, interval 1 day)) as day from s), "
    "n as (select user_id, cast(ts as date) as day, count(*) as n from events group by all) "
    "select d.user_id, strftime(d.day, '%Y-%m-%d') as day, coalesce(n.n, 0) as n from d "
    "left join n on n.user_id = d.user_id and n.day = d.day")


QUERIES = {
    "vertices_round_trip": q_vertices_round_trip,
    "pair_counts_round_trip": q_pair_counts_round_trip,
    "memberships_round_trip": q_memberships_round_trip,
    "member_listing": q_member_listing,
    "member_lines": q_member_lines,
    "distinct_members": q_distinct_members,
    "daily_files": q_daily_files,
    "daily_newest": q_daily_newest,
    "daily_csv_round_trip": q_daily_csv_round_trip,
    "replayed_messages": q_replayed_messages,
    "metrics_table": q_metrics_table,
    "gexf_round_trip": q_gexf_round_trip,
    "sorted_labels": q_sorted_labels,
    "ranked_degrees": q_ranked_degrees,
    "head_of_ranking": q_head_of_ranking,
    "label_line": q_label_line,
    "chosen_vertices": q_chosen_vertices,
    "label_parts": q_label_parts,
    "map_merges": q_map_merges,
    "first_labels": q_first_labels,
    "works_staff": q_works_staff,
    "tick_records": q_tick_records,
    "days_without_ticks": q_days_without_ticks,
}
ORACLES = {
    "vertices_round_trip": SQL_VERTICES_ROUND_TRIP,
    "pair_counts_round_trip": SQL_PAIR_COUNTS_ROUND_TRIP,
    "memberships_round_trip": SQL_MEMBERSHIPS_ROUND_TRIP,
    "member_listing": SQL_MEMBER_LISTING,
    "member_lines": SQL_MEMBER_LINES,
    "distinct_members": SQL_DISTINCT_MEMBERS,
    "daily_files": SQL_DAILY_FILES,
    "daily_newest": SQL_DAILY_NEWEST,
    "daily_csv_round_trip": SQL_DAILY_CSV_ROUND_TRIP,
    "replayed_messages": SQL_REPLAYED_MESSAGES,
    "metrics_table": SQL_METRICS_TABLE,
    "gexf_round_trip": SQL_GEXF_ROUND_TRIP,
    "sorted_labels": SQL_SORTED_LABELS,
    "ranked_degrees": SQL_RANKED_DEGREES,
    "head_of_ranking": SQL_HEAD_OF_RANKING,
    "label_line": SQL_LABEL_LINE,
    "chosen_vertices": SQL_CHOSEN_VERTICES,
    "label_parts": SQL_LABEL_PARTS,
    "map_merges": SQL_MAP_MERGES,
    "first_labels": SQL_FIRST_LABELS,
    "works_staff": SQL_WORKS_STAFF,
    "tick_records": SQL_TICK_RECORDS,
    "days_without_ticks": SQL_DAYS_WITHOUT_TICKS,
}
