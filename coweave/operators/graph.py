"""Property graph as two DataFrames (SURVEY §2: G1, G7, A1–A3, J1, J3–J5,
J10, X1).

``CoGraph.edges`` holds each undirected pair once (``src``, ``dst``, ``w``);
the directed view the reference builds by adding every flipped edge is
``CoGraph.symmetric()``.  ``CoGraph.vertices`` is (id, name) and includes
edge endpoints missing from the vertex list with the default label "" (J10).

No lookup table is shipped to tasks in a closure; labels come in by an
equi-join that Spark may turn into a broadcast after measuring the vertex
side (AQE), never on a hint.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cooccur import dealt, partitions_for, symmetrize

DEFAULT_LABEL = ""


@dataclass
class CoGraph:
    vertices: DataFrame  # id BIGINT, name STRING
    edges: DataFrame     # src BIGINT, dst BIGINT, w BIGINT; one row per pair
    written: bool = True   # edges are cheap to read again (a table, not a computation)
    ends: DataFrame | None = None   # id of every endpoint, where known without the edges
    size: int = 0                   # edges at most, where known (sizes shuffles)

    def symmetric(self) -> DataFrame:
        """Both directions of every edge (the reference's edge RDD)."""
        return symmetrize(self.edges, one_pass=not self.written)

    def persist(self) -> "CoGraph":
        return CoGraph(self.vertices.persist(), self.edges.persist(), True, self.ends, self.size)

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()

    def materialized(self, base_vertices: DataFrame) -> "CoGraph":
        """Write the edges once (under ``spark.checkpoint.dir``) and rebuild
        the vertex set from that table, for queries that use the graph many
        times (iterative operators, labels after a loop)."""
        from ..session import cut_lineage
        return build_graph(base_vertices, cut_lineage(self.edges), ends=self.ends, size=self.size)


def build_graph(vertices: DataFrame, edges: DataFrame, vid: str = "id",
                name: str = "name", src: str = "src", dst: str = "dst",
                w: str | None = "w", ends: DataFrame | None = None, written: bool = True,
                size: int = 0) -> CoGraph:
    """G1 + J10: typed vertices plus every edge endpoint (label "" if absent).
    ``ends`` (column ``id``) gives the endpoints where they are known otherwise,
    so that the edges are not computed for them; ``written`` is false for edges
    that are costly to read twice, ``size`` their number at most.

    A vertex has one label: of an id listed several times the greatest label
    stays (tables have no line order to go by), so no operator counts the
    vertex twice.
    """
    v = vertices.groupBy(F.col(vid).cast("bigint").alias("id")).agg(
        F.max(F.col(name).cast("string")).alias("name"))
    weight = F.col(w).cast("bigint") if w else F.lit(1).cast("bigint")
    e = edges.select(F.col(src).cast("bigint").alias("src"),
                     F.col(dst).cast("bigint").alias("dst"), weight.alias("w"))
    met = ends if ends is not None else symmetrize(e, one_pass=not written).select(F.col("src").alias("id")).distinct()
    missing = met.join(v, "id", "left_anti").select(
        "id", F.lit(DEFAULT_LABEL).alias("name"))
    return CoGraph(v.unionByName(missing), e, written, ends, size)


def attach_label(df: DataFrame, vertices: DataFrame, id_col: str = "id",
                 out: str = "name") -> DataFrame:
    """Look up the label of ``id_col``; "" when the id is unknown."""
    lab = vertices.select(F.col("id").alias(id_col), F.col("name").alias(out))
    return (df.join(lab, id_col, "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(DEFAULT_LABEL))))


def triplets(g: CoGraph, symmetric: bool = True) -> DataFrame:
    """(src, dst, w, src_name, dst_name) for every directed edge."""
    e = g.symmetric() if symmetric else g.edges
    n = partitions_for(g.vertices.sparkSession, g.size * (2 if symmetric else 1))
    e = attach_label(dealt(e, n, "src"), g.vertices, "src", "src_name")
    return attach_label(dealt(e, n, "dst"), g.vertices, "dst", "dst_name")


def aggregate_messages(g: CoGraph, agg: Column, to_dst: Column | None = None,
                       to_src: Column | None = None, symmetric: bool = True,
                       out: str = "msg") -> DataFrame:
    """Send a per-edge Column to an endpoint, merge per receiving vertex.

    ``to_dst`` / ``to_src`` are expressions over the edge columns (src, dst,
    w); ``agg`` is an aggregate over the column ``msg`` (e.g. ``F.sum('msg')``).
    Merge runs as a hash aggregate with map-side partial aggregation, so a
    hub vertex receiving a third of all messages costs one row per map task.
    """
    e = g.symmetric() if symmetric else g.edges
    parts = []
    if to_dst is not None:
        parts.append(e.select(F.col("dst").alias("id"), to_dst.alias("msg")))
    if to_src is not None:
        parts.append(e.select(F.col("src").alias("id"), to_src.alias("msg")))
    if not parts:
        raise ValueError("aggregate_messages needs to_dst and/or to_src")
    msgs = parts[0]
    for p in parts[1:]:
        msgs = msgs.unionByName(p)
    return msgs.groupBy("id").agg(agg.alias(out))


def degree_table(g: CoGraph) -> DataFrame:
    """J5 (A1 + A2 in one aggregation): (id, neighbours, coworks).

    The reference computes co-works and neighbours twice each; here one
    partial/final aggregate over the symmetric edges yields both.
    """
    return (g.symmetric().groupBy(F.col("src").alias("id"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("neighbours"),
                 F.sum("w").cast("bigint").alias("coworks")))


def weighted_degree(g: CoGraph) -> DataFrame:
    """A1: (id, coworks) = Σ edge weight at the vertex; edgeless vertices absent."""
    return degree_table(g).select("id", "coworks")


def neighbour_count(g: CoGraph) -> DataFrame:
    """A2: (id, neighbours) = one message per incoming edge, summed."""
    return aggregate_messages(g, F.sum("msg"), to_dst=F.lit(1)).select(
        "id", F.col("msg").cast("bigint").alias("neighbours"))


def degree_extrema(g: CoGraph) -> DataFrame:
    """A3: vertex with the largest in-, out- and total degree of the directed
    (symmetric) graph; ties go to the smallest id.  (kind, id, degree)."""
    s = g.symmetric()
    outd = s.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    ind = s.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    tot = (outd.unionByName(ind).groupBy("id").agg(F.sum("d").alias("d")))

    def best(df: DataFrame, kind: str) -> DataFrame:
        key = F.struct(F.col("d"), (-F.col("id")).alias("nid"))
        return df.agg(F.max_by("id", key).alias("id"),
                      F.max("d").cast("bigint").alias("degree")) \
                 .select(F.lit(kind).alias("kind"), "id", "degree")

    return best(ind, "in").unionByName(best(outd, "out")).unionByName(best(tot, "total"))


def outer_join_vertices(g: CoGraph, values: DataFrame, col: str,
                        default: float = 0.0) -> DataFrame:
    """Every vertex with ``col`` from ``values`` (id, col), default when absent."""
    return (g.vertices.join(values.select("id", col), "id", "left")
            .withColumn(col, F.coalesce(F.col(col), F.lit(default))))


def heavy_edges(g: CoGraph, min_w: int) -> DataFrame:
    """edges whose weight is at least ``min_w`` (the view tests ``>=``, Q13)."""
    return g.edges.where(F.col("w") >= min_w)


def node_category(g: CoGraph, min_w: int) -> DataFrame:
    """F6 + J11: (id, name, category) — 1 if the vertex touches a heavy edge.

    The endpoint set is deduplicated with a partial aggregate before the
    left join, so a hub on many heavy edges adds one row, not one per edge.
    """
    h = heavy_edges(g, min_w)
    ends = (h.select(F.col("src").alias("id")).union(h.select(F.col("dst").alias("id")))
            .distinct().withColumn("hit", F.lit(1)))
    return (g.vertices.join(ends, "id", "left")
            .select("id", "name", F.coalesce(F.col("hit"), F.lit(0)).cast("int").alias("category")))


def map_vertices(g: CoGraph, attr: Column, name: str = "attr") -> DataFrame:
    """Replace each vertex's attribute by an expression of (id, name)."""
    return g.vertices.select("id", attr.alias(name))


def reduce_by_key(df: DataFrame, keys: list[str], merge: dict[str, Column]) -> DataFrame:
    """Keyed reduce with associative merges given as aggregate Columns
    (e.g. ``{"w": F.sum("w")}``) — partial aggregation before the shuffle,
    no closure shipped to tasks."""
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in merge.items()])
