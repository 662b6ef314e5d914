"""Registered graph queries over the test tables and their DuckDB oracles.

Each query takes (spark, sf_dir) and returns a DataFrame; each oracle is one
SQL string over the pre-registered views.  Column names and types agree
(ids BIGINT, counts BIGINT, ranks INT, doubles rounded to 6 places).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccur, graph as gr, ranking
from ..sources import testdata as td

TOP = 20          # fixed: top-N of every graph metric in the reference
HEAVY_MIN_W = 2   # heavy-edge threshold on this data (reference view: 10)


def membership_graph(spark: SparkSession, sf_dir: str, reuse: bool = False) -> gr.CoGraph:
    """The co-occurrence graph; ``reuse`` writes its edges once for queries
    that read the graph several times."""
    return _graph(td.memberships(spark, sf_dir), td.vertices(spark, sf_dir), reuse)


def _graph(memberships: DataFrame, vertices: DataFrame, reuse: bool) -> gr.CoGraph:
    load = cooccur.work_load(memberships)
    edges = cooccur.cooccurrence_edges(memberships, load=load)
    g = gr.build_graph(vertices, edges, ends=cooccur.endpoints(memberships), written=False, size=load[1])
    return g.materialized(vertices) if reuse else g


# --------------------------------------------------------------------------
# SQL building blocks (DuckDB)

M_SQL = "select distinct l_orderkey as work_id, l_partkey as member from lineitem"
E_SQL = ("select a.member as src, b.member as dst, count(*) as w from m a "
         "join m b on a.work_id = b.work_id and a.member < b.member "
         "group by a.member, b.member")
S_SQL = "select src, dst, w from e union all select dst as src, src as dst, w from e"
V_SQL = ("select p_partkey as id, max(p_name) as name from part group by p_partkey union all "
         "select x.id, '' as name from (select src as id from e union select dst from e) x "
         "where x.id not in (select p_partkey from part)")
GRAPH_CTE = f"with m as ({M_SQL}), e as ({E_SQL}), s as ({S_SQL}), v as ({V_SQL})"


def _top_sql(metric_sql: str, col: str, n: int = TOP) -> str:
    return (f"{GRAPH_CTE}, d as ({metric_sql}) "
            f"select cast(row_number() over (order by d.{col} desc, v.name asc, d.id asc) as integer) as rank, "
            f"d.id, v.name, d.{col} from d join v on v.id = d.id "
            f"order by d.{col} desc, v.name asc, d.id asc limit {n}")


# --------------------------------------------------------------------------
# queries

def q_cooccur_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every co-member pair with its number of shared works."""
    return cooccur.cooccurrence_edges(td.memberships(spark, sf_dir))


SQL_COOCCUR_EDGES = f"with m as ({M_SQL}), e as ({E_SQL}) select src, dst, w from e"


def q_coop_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + J1 + T3: the 20 members with the most co-works, without building
    any pair."""
    return ranking.top_n(_coworks(spark, sf_dir), "coworks", TOP).select("rank", "id", "name", "coworks")


def _coworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, coworks, name) of every member that shares a work."""
    d = cooccur.weighted_degree_from_memberships(td.memberships(spark, sf_dir))
    return gr.attach_label(d, td.vertices(spark, sf_dir))


SQL_COOP_TOP20 = _top_sql(
    "select src as id, cast(sum(w) as bigint) as coworks from s group by src", "coworks")


def q_neighbour_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + J1 + T3: the 20 members with the most distinct co-members."""
    g = membership_graph(spark, sf_dir)
    d = gr.attach_label(gr.neighbour_count(g), g.vertices)
    return ranking.top_n(d, "neighbours", TOP).select("rank", "id", "name", "neighbours")


SQL_NEIGHBOUR_TOP20 = _top_sql(
    "select dst as id, count(*) as neighbours from s group by dst", "neighbours")


def q_degree_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(neighbours, co-works) per member, joined on id (not by position)."""
    g = membership_graph(spark, sf_dir)
    return gr.attach_label(gr.degree_table(g), g.vertices).select(
        "id", "name", "neighbours", "coworks")


SQL_DEGREE_SCATTER = (
    f"{GRAPH_CTE} select d.id, v.name, d.neighbours, d.coworks from "
    "(select src as id, count(*) as neighbours, cast(sum(w) as bigint) as coworks "
    "from s group by src) d join v on v.id = d.id")


def q_coworks_pairfree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 computed from memberships without building any pair."""
    return cooccur.weighted_degree_from_memberships(td.memberships(spark, sf_dir))


SQL_COWORKS_PAIRFREE = (
    f"{GRAPH_CTE} select src as id, cast(sum(w) as bigint) as coworks from s group by src")


def q_degree_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: largest in/out/total degree of the symmetric graph."""
    return gr.degree_extrema(membership_graph(spark, sf_dir))


SQL_DEGREE_EXTREMA = (
    f"{GRAPH_CTE}, o as (select src as id, count(*) as d from s group by src), "
    "i as (select dst as id, count(*) as d from s group by dst), "
    "t as (select id, sum(d) as d from (select * from o union all select * from i) group by id) "
    "select 'in' as kind, arg_max(id, (d, -id)) as id, cast(max(d) as bigint) as degree from i "
    "union all select 'out', arg_max(id, (d, -id)), cast(max(d) as bigint) from o "
    "union all select 'total', arg_max(id, (d, -id)), cast(max(d) as bigint) from t")


def q_works_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of works and of distinct members."""
    return cooccur.count_works(td.memberships(spark, sf_dir))


SQL_WORKS_MEMBERS = (f"with m as ({M_SQL}) select count(distinct work_id) as works, "
                     "count(distinct member) as members from m")


def q_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directed edge with both endpoint labels."""
    return gr.triplets(membership_graph(spark, sf_dir)).select(
        "src", "dst", "w", "src_name", "dst_name")


SQL_TRIPLETS = (f"{GRAPH_CTE} select s.src, s.dst, s.w, a.name as src_name, "
                "b.name as dst_name from s join v a on a.id = s.src join v b on b.id = s.dst")


QUERIES = {
    "cooccur_edges": q_cooccur_edges,
    "coop_top20": q_coop_top20,
    "neighbour_top20": q_neighbour_top20,
    "degree_scatter": q_degree_scatter,
    "coworks_pairfree": q_coworks_pairfree,
    "degree_extrema": q_degree_extrema,
    "works_members": q_works_members,
    "triplets": q_triplets,
}

ORACLES = {
    "cooccur_edges": SQL_COOCCUR_EDGES,
    "coop_top20": SQL_COOP_TOP20,
    "neighbour_top20": SQL_NEIGHBOUR_TOP20,
    "degree_scatter": SQL_DEGREE_SCATTER,
    "coworks_pairfree": SQL_COWORKS_PAIRFREE,
    "degree_extrema": SQL_DEGREE_EXTREMA,
    "works_members": SQL_WORKS_MEMBERS,
    "triplets": SQL_TRIPLETS,
}


# --------------------------------------------------------------------------
# triangles, k-hop, snowball, PageRank, Pregel, heavy edges

from ..operators import khop, pagerank as prk, triangles as tri  # noqa: E402

K_HOP = 2        # fixed: rounds of the reference's two-hop ring
TOL = 0.001      # fixed: PageRank tolerance of the reference
SNOWBALL_ROUNDS = 3


def q_triangle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles through every vertex (0 for none)."""
    return tri.triangle_count(membership_graph(spark, sf_dir))


TRI_SQL = ("c as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst), "
           "t as (select x.a, x.b, y.b as c from c x join c y on x.b = y.a "
           "join c z on z.a = x.a and z.b = y.b), "
           "pc as (select id, count(*) as n from (select a as id from t union all "
           "select b from t union all select c from t) group by id)")
SQL_TRIANGLE_COUNTS = (f"{GRAPH_CTE}, {TRI_SQL} select v.id, v.name, "
                       "cast(coalesce(pc.n, 0) as bigint) as triangles from v left join pc on pc.id = v.id")


def q_triangle_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 + T3: the 20 members in the most triangles."""
    t = q_triangle_counts(spark, sf_dir)
    return ranking.top_n(t, "triangles", TOP).select("rank", "id", "name", "triangles")


SQL_TRIANGLE_TOP20 = (
    f"{GRAPH_CTE}, {TRI_SQL}, d as (select v.id, v.name, cast(coalesce(pc.n, 0) as bigint) as triangles "
    "from v left join pc on pc.id = v.id) "
    "select cast(row_number() over (order by triangles desc, name asc, id asc) as integer) as rank, "
    f"id, name, triangles from d order by triangles desc, name asc, id asc limit {TOP}")


def _top_neighbour_seeds(g: gr.CoGraph, n: int) -> DataFrame:
    d = gr.attach_label(gr.neighbour_count(g), g.vertices)
    return ranking.top_n(d, "neighbours", n).select("id")


def _ring_query(k: int):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = membership_graph(spark, sf_dir, reuse=True)
        return khop.khop_ring_labelled(g, k, _top_neighbour_seeds(g, 2))
    q.__doc__ = f"""G4 + G5 + J2: {k}-hop ring of the two best-connected members, labelled."""
    return q


def _ring_sql(k: int) -> str:
    steps = ["r0 as (select id, id as other from seeds)"]
    for r in range(1, k + 1):
        nearer = " union all ".join(f"select id, other from r{i}" for i in range(r))
        steps.append(f"r{r} as (select distinct p.id, s.dst as other from r{r - 1} p join s on s.src = p.other "
                     f"except ({nearer}))")
    return (f"{GRAPH_CTE}, seeds as (select d.id from (select dst as id, count(*) as n from s group by dst) d "
            "join v on v.id = d.id order by d.n desc, v.name asc, d.id asc limit 2), " + ", ".join(steps) +
            " select r.id as seed_id, a.name as seed_name, r.other as id, b.name as name "
            f"from r{k} r join v a on a.id = r.id join v b on b.id = r.other")


def q_snowball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of expansion from the member with the most co-works."""
    return khop.snowball_labelled(td.memberships(spark, sf_dir), _busiest(spark, sf_dir),
                                  td.vertices(spark, sf_dir), SNOWBALL_ROUNDS)


def _busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member with the most co-works, found without building pairs."""
    return ranking.top_n(_coworks(spark, sf_dir), "coworks", 1).select(F.col("id").alias("member"))


def _snowball_sql(tail: str) -> str:
    rounds = [
        "seed as (select d.id as member from (select src as id, sum(w) as c from s group by src) d "
        "join v on v.id = d.id order by d.c desc, v.name asc, d.id asc limit 1)",
        "f0 as (select member, 0 as round from seed)",
    ]
    for r in range(1, SNOWBALL_ROUNDS + 1):
        prev = "seed" if r == 1 else f"n{r - 1}"
        seen = " union all ".join(["select member from f0"] + [f"select member from n{i}" for i in range(1, r)])
        rounds.append(f"w{r} as (select distinct m.work_id from m join {prev} p on p.member = m.member)")
        rounds.append(f"n{r} as (select distinct m.member from m join w{r} using (work_id) "
                      f"except ({seen}))")
    found = " union all ".join(["select member, round from f0"] +
                               [f"select member, {r} as round from n{r}"
                                for r in range(1, SNOWBALL_ROUNDS + 1)])
    works = " union ".join(f"select work_id from w{r}" for r in range(1, SNOWBALL_ROUNDS + 1))
    return (f"{GRAPH_CTE}, " + ", ".join(rounds) +
            f", found as ({found}), works as ({works}) " + tail)


SQL_SNOWBALL = _snowball_sql(
    "select f.member, coalesce(v.name, '') as name, f.round from found f "
    "left join v on v.id = f.member")


def q_snowball_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership rows of the works the expansion collected."""
    _, works = khop.snowball(td.memberships(spark, sf_dir), _busiest(spark, sf_dir), SNOWBALL_ROUNDS)
    return works.select("work_id", "member")


SQL_SNOWBALL_WORKS = _snowball_sql(
    "select m.work_id, m.member from m join works using (work_id)")


def q_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + J3: PageRank to tolerance 0.001 for every member, rounded to 6."""
    return _pageranks(spark, sf_dir).select("id", "name", F.round("pagerank", 6).alias("pagerank"))


def _pageranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = membership_graph(spark, sf_dir, reuse=True)
    return gr.outer_join_vertices(g, prk.pagerank(g, TOL), "pagerank")


PR_SQL = (
    "od as (select src as id, 1.0 / count(*) as inv from s group by src), "
    "pr(it, id, rank, delta, active) as ("
    " select 0, id, 0.15::double, 0.15::double, true from v"
    " union all"
    " select p.it + 1, p.id,"
    "  case when mm.msg is null then p.rank else p.rank + 0.85 * mm.msg end,"
    "  case when mm.msg is null then p.delta else 0.85 * mm.msg end,"
    "  mm.msg is not null"
    " from pr p left join ("
    "  select x.dst, sum(q.delta * od.inv) as msg from pr q join s x on x.src = q.id"
    f"  join od on od.id = q.id where q.active and q.delta > {TOL} group by x.dst) mm"
    " on mm.dst = p.id"
    f" where exists (select 1 from pr q join od on od.id = q.id where q.active and q.delta > {TOL})), "
    "fin as (select id, rank from pr where it = (select max(it) from pr)), "
    "prn as (select fin.id, v.name, fin.rank * (select count(*) from fin) / "
    "(select sum(rank) from fin) as pagerank from fin join v on v.id = fin.id)")
SQL_PAGERANK = (f"{GRAPH_CTE.replace('with ', 'with recursive ', 1)}, {PR_SQL} "
                "select id, name, round(pagerank, 6) as pagerank from prn")


def q_pagerank_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + T3: the 20 highest PageRanks, ranked before rounding."""
    top = ranking.top_n(_pageranks(spark, sf_dir), "pagerank", TOP)
    return top.select("rank", "id", "name", F.round("pagerank", 6).alias("pagerank"))


SQL_PAGERANK_TOP20 = (
    f"{GRAPH_CTE.replace('with ', 'with recursive ', 1)}, {PR_SQL} "
    "select cast(row_number() over (order by pagerank desc, name asc, id asc) as integer) as rank, "
    f"id, name, round(pagerank, 6) as pagerank from prn order by prn.pagerank desc, name asc, id asc limit {TOP}")


def q_heavy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + J4: edges with weight >= 2, with both labels."""
    g = membership_graph(spark, sf_dir)
    h = gr.CoGraph(g.vertices, gr.heavy_edges(g, HEAVY_MIN_W), g.written)
    return gr.triplets(h, symmetric=False).select("src", "dst", "w", "src_name", "dst_name")


SQL_HEAVY_EDGES = (f"{GRAPH_CTE} select e.src, e.dst, e.w, a.name as src_name, b.name as dst_name "
                   f"from e join v a on a.id = e.src join v b on b.id = e.dst where e.w >= {HEAVY_MIN_W}")


def q_node_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 + J11: 1 for members on a heavy edge, else 0."""
    return gr.node_category(membership_graph(spark, sf_dir, reuse=True), HEAVY_MIN_W)


SQL_NODE_CATEGORY = (
    f"{GRAPH_CTE}, h as (select src as id from e where w >= {HEAVY_MIN_W} union "
    f"select dst from e where w >= {HEAVY_MIN_W}) "
    "select v.id, v.name, cast(case when h.id is null then 0 else 1 end as integer) as category "
    "from v left join h on h.id = v.id")


QUERIES.update({
    "triangle_counts": q_triangle_counts,
    "triangle_top20": q_triangle_top20,
    "one_hop_of_top2": _ring_query(1),
    "two_hop_of_top2": _ring_query(K_HOP),
    "three_hop_of_top2": _ring_query(3),
    "snowball": q_snowball,
    "snowball_works": q_snowball_works,
    "pagerank": q_pagerank,
    "pagerank_top20": q_pagerank_top20,
    "heavy_edges": q_heavy_edges,
    "node_category": q_node_category,
})
ORACLES.update({
    "triangle_counts": SQL_TRIANGLE_COUNTS,
    "triangle_top20": SQL_TRIANGLE_TOP20,
    "one_hop_of_top2": _ring_sql(1),
    "two_hop_of_top2": _ring_sql(K_HOP),
    "three_hop_of_top2": _ring_sql(3),
    "snowball": SQL_SNOWBALL,
    "snowball_works": SQL_SNOWBALL_WORKS,
    "pagerank": SQL_PAGERANK,
    "pagerank_top20": SQL_PAGERANK_TOP20,
    "heavy_edges": SQL_HEAVY_EDGES,
    "node_category": SQL_NODE_CATEGORY,
})


# --------------------------------------------------------------------------
# the denser second graph: users with an event of one type in one slot

def event_graph(spark: SparkSession, sf_dir: str, reuse: bool = False) -> gr.CoGraph:
    return _graph(td.event_memberships(spark, sf_dir), td.event_vertices(spark, sf_dir), reuse)


EM_SQL = "select distinct event_type, floor(epoch(ts) / 600) as slot, user_id as member from events"
EE_SQL = E_SQL.replace("a.work_id = b.work_id", "a.event_type = b.event_type and a.slot = b.slot")
EV_CTE = (f"with m as ({EM_SQL}), e as ({EE_SQL}), s as ({S_SQL}), "
          "v as (select distinct user_id as id, cast(user_id as varchar) as name from events)")


def q_event_cooccur_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 on the dense graph."""
    return cooccur.cooccurrence_edges(td.event_memberships(spark, sf_dir))


SQL_EVENT_COOCCUR_EDGES = f"{EV_CTE} select src, dst, w from e"


def q_event_degree_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 on the dense graph."""
    g = event_graph(spark, sf_dir)
    return gr.attach_label(gr.degree_table(g), g.vertices).select(
        "id", "name", "neighbours", "coworks")


SQL_EVENT_DEGREE_SCATTER = (
    f"{EV_CTE} select d.id, v.name, d.neighbours, d.coworks from "
    "(select src as id, count(*) as neighbours, cast(sum(w) as bigint) as coworks "
    "from s group by src) d join v on v.id = d.id")


def q_event_triangle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 on the dense graph."""
    return tri.triangle_count(event_graph(spark, sf_dir))


SQL_EVENT_TRIANGLE_COUNTS = (f"{EV_CTE}, {TRI_SQL} select v.id, v.name, "
                             "cast(coalesce(pc.n, 0) as bigint) as triangles "
                             "from v left join pc on pc.id = v.id")

QUERIES.update({
    "event_cooccur_edges": q_event_cooccur_edges,
    "event_degree_scatter": q_event_degree_scatter,
    "event_triangle_counts": q_event_triangle_counts,
})
ORACLES.update({
    "event_cooccur_edges": SQL_EVENT_COOCCUR_EDGES,
    "event_degree_scatter": SQL_EVENT_DEGREE_SCATTER,
    "event_triangle_counts": SQL_EVENT_TRIANGLE_COUNTS,
})


# --------------------------------------------------------------------------
# heavy edges by overlap join, growing input

from ..operators import incremental, overlap  # noqa: E402
from ..session import scratch_path  # noqa: E402

HOUR_MIN_W = 3        # heavy-edge threshold of the hour graph
APPENDED = 5          # batches the memberships arrive in


def q_heavy_edges_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + J4: the heavy edges again, found without counting all pairs."""
    h = overlap.heavy_overlaps(td.memberships(spark, sf_dir), HEAVY_MIN_W)
    g = gr.CoGraph(td.vertices(spark, sf_dir), h)
    return gr.triplets(g, symmetric=False).select("src", "dst", "w", "src_name", "dst_name")


EH_SQL = "select distinct event_type, date_trunc('hour', ts) as slot, user_id as member from events"


def q_event_hour_heavy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 on the densest graph (event type and hour): pairs of users who met in
    at least three slots."""
    return overlap.heavy_overlaps(td.event_hour_memberships(spark, sf_dir), HOUR_MIN_W)


SQL_EVENT_HOUR_HEAVY_EDGES = (
    f"with m as ({EH_SQL}), e as ({EE_SQL}) select src, dst, w from e where w >= {HOUR_MIN_W}")


def q_incremental_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 + S12: the pair counts kept while the memberships arrive in batches
    (by line number, so that most works grow several times); one batch comes
    twice, and the deltas are merged once on the way."""
    view = incremental.EdgeView(spark, scratch_path(spark))
    lines = td.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("member"),
        (F.col("l_linenumber") % APPENDED).alias("batch"))
    for batch in [0, 1, 2, 1, 3, 4]:
        view.append(batch, lines.where(F.col("batch") == batch).select("work_id", "member"))
        if batch == 2:
            view.compact()
    return view.edges()


QUERIES.update({
    "heavy_edges_prefix": q_heavy_edges_prefix,
    "event_hour_heavy_edges": q_event_hour_heavy_edges,
    "incremental_edges": q_incremental_edges,
})
ORACLES.update({
    "heavy_edges_prefix": SQL_HEAVY_EDGES,
    "event_hour_heavy_edges": SQL_EVENT_HOUR_HEAVY_EDGES,
    "incremental_edges": SQL_COOCCUR_EDGES,
})


RING_ROUNDS = 3


def q_ring_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 for all vertices: estimated sizes of the rings 1 to 3."""
    return khop.ring_sizes(membership_graph(spark, sf_dir, reuse=True), RING_ROUNDS)


# Estimates, which SQL cannot give; tests hold them against exact rings.
ESTIMATES = {"ring_sizes": q_ring_sizes}


# --------------------------------------------------------------------------
# exports

from ..sources import gexf as gx, messages as msg  # noqa: E402


def q_coop_top20_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + A12: the co-work top 20 as the reference's JSON pair list."""
    return msg.export_pairs_json(q_coop_top20(spark, sf_dir), "name", "coworks")


SQL_COOP_TOP20_JSON = (
    f"with t as ({SQL_COOP_TOP20}) select '[' || string_agg('[' || cast(to_json(name) as varchar) "
    "|| ',' || cast(coworks as varchar) || ']', ',' order by rank) || ']' as text from t")


def q_gexf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GEXF document of the membership graph as ordered lines."""
    return gx.gexf_lines(membership_graph(spark, sf_dir, reuse=True))


def _xml_sql(c: str) -> str:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = f"replace({out}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return out


def _fixed_rows_sql(lines: list[str], section: int) -> str:
    rows = ", ".join(f"({section}, {i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(lines))
    return (f"select cast(a as integer) as section, cast(b as bigint) as k1, cast(0 as bigint) as k2, "
            f"c as line from (values {rows}) x(a, b, c)")


SQL_GEXF_LINES = (
    f"{GRAPH_CTE} {_fixed_rows_sql(gx.HEADER, 0)} union all "
    "select 1, id, 0, ' <node id=\"' || cast(id as varchar) || '\" label=\"' || "
    f"{_xml_sql('name')} || '\" />' from v union all "
    f"{_fixed_rows_sql(gx.MIDDLE, 2)} union all "
    "select 3, src, dst, ' <edge source=\"' || cast(src as varchar) || '\" target=\"' || "
    "cast(dst as varchar) || '\" label=\"' || cast(w as varchar) || '\" />' from s union all "
    f"{_fixed_rows_sql(gx.FOOTER, 4)}")

QUERIES.update({"coop_top20_json": q_coop_top20_json, "gexf_lines": q_gexf_lines})
ORACLES.update({"coop_top20_json": SQL_COOP_TOP20_JSON, "gexf_lines": SQL_GEXF_LINES})
