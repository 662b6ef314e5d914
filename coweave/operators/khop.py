"""Level-wise expansion over graphs and membership rows (G4, G5, G6, F7,
J6, M3).

All are frontier loops on the driver over DataFrames: a round joins the newest
frontier with the edges (or the membership rows), takes out what was reached
before, and the rest is the next frontier.  A round touches only the frontier,
not the whole reached set's neighbourhoods again.

What was reached is one table of bitmaps (32,768 ids a row), replaced every
round by the union of itself and the round's new ids.  A candidate is tested by
its bit, so a round reads that table and the frontier and no round before, and
a visited set of n near ids takes n / 8 bytes.  Both are written as tables under
``spark.checkpoint.dir``, so plans stay short and a lost executor never replays
the whole loop.

``ring_sizes`` does the same for all vertices at once, with sketches in place of
the rings, which nobody could list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import cut_lineage, discard
from . import sketches as sk
from .graph import CoGraph, attach_label


def _materialise(df: DataFrame) -> DataFrame:
    return cut_lineage(df)


# --------------------------------------------------------------------------
# visited sets

def bitmaps(ids: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, bucket, bits): the ids of every key as bitmaps."""
    return (ids.groupBy(*keys, F.bitmap_bucket_number(col).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(col)).alias("bits")))


def merge_bitmaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two sets of bitmaps."""
    return a.unionByName(b).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bit(bits: str, col: str) -> Column:
    """The bit of an id in its bitmap, 0 where there is no bitmap."""
    at = f"bitmap_bit_position({col})"
    byte = f"cast(conv(hex(substring({bits}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce(shiftright({byte}, cast({at} % 8 as int)) & 1, 0)")


def not_visited(candidates: DataFrame, col: str, visited: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates whose bit is not set."""
    bucket = "_bucket"
    met = candidates.withColumn(bucket, F.bitmap_bucket_number(col)).join(
        visited.withColumnRenamed("bucket", bucket), [*keys, bucket], "left")
    return met.where(_bit("bits", col) == 0).select(*candidates.columns)


class Visited:
    """The ids reached so far, per key: one written table of bitmaps."""

    def __init__(self, ids: DataFrame, col: str, keys: list[str] | None = None):
        self.col, self.keys = col, keys or []
        self.table = cut_lineage(bitmaps(ids, col, self.keys))

    def new_of(self, candidates: DataFrame) -> DataFrame:
        return not_visited(candidates, self.col, self.table, self.keys)

    def add(self, ids: DataFrame) -> None:
        """Replace the table by its union with ``ids``; nothing may read the
        one before any more."""
        before = self.table
        self.table = cut_lineage(merge_bitmaps(before, bitmaps(ids, self.col, self.keys), self.keys))
        discard(before)


# --------------------------------------------------------------------------
# rings

def khop_ring(g: CoGraph, seeds: DataFrame, k: int = 2) -> DataFrame:
    """The ring of every seed (``seeds``: one column ``id``).

    Returns (id, other) for every vertex ``other`` at shortest distance
    exactly ``k`` from ``id``; self and nearer vertices are not in the ring.
    The output is the seeds' rings, so the seeds are a chosen few, never all
    vertices.

    A round is one equi-join of the frontier with the edges on ``via``; the
    rows of a hub are a plain exchange, which AQE splits when it is skewed.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    adj = g.symmetric().select(F.col("src").alias("via"), F.col("dst").alias("other"))
    # written once: every round reads them, and they may be costly to find
    start = _materialise(seeds.select(F.col("id").cast("bigint")).distinct())
    frontier = start.select("id", F.col("id").alias("other"))
    visited = Visited(frontier, "other", ["id"])
    for r in range(1, k + 1):
        step = visited.new_of(frontier.select("id", F.col("other").alias("via"))
                              .join(adj, "via").select("id", "other").distinct())
        if r == k:
            return step
        frontier = _materialise(step)
        visited.add(frontier)


def ring_sizes(g: CoGraph, k: int = 3, lg_k: int = 12, grid: tuple[int, int] | None = None) -> DataFrame:
    """G4 for all vertices, as sizes: (id, ring_1 ... ring_k), estimates of the
    number of vertices at shortest distance 1 to k from each.

    Every vertex has a mergeable distinct-count sketch of what is within r
    steps, at first of itself.  A round unites the sketches of a vertex and its
    neighbours (``sketches.balls``): slices of sketches never meet, so all rounds of
    a slice are made in one task, edges are written once as places, and no sketch is
    sent anywhere.  A ring is the difference of two balls.  A sketch takes
    2^lg_k bytes at most, whatever it has counted; the standard error of a ball
    is about 1.04 / sqrt(2^lg_k) (1.6 % at 12) and small balls are exact.
    ``grid`` is (blocks of receivers, slices of sketches), by default what bounds
    a task.
    """
    ids = _materialise(g.vertices.select("id").where(F.col("id").isNotNull()).distinct())
    if not g.written:
        g = CoGraph(g.vertices, _materialise(g.edges.select("src", "dst")))
    ends = g.symmetric().select(F.col("src").alias("id"), F.col("dst").alias("via")).dropna()
    # a ball holds the one before; edges listed twice unite the same sketches
    into = ends.unionByName(ids.select("id", F.col("id").alias("via")))
    n = ids.count()
    blocks, slices = grid or sk.grid_for(n, n + 2 * g.edges.count(), lg_k)
    found = sk.balls(ids, into, k, blocks, slices, lg_k)
    sizes = _materialise(found.select("id", F.lit(1).cast("bigint").alias("b0"), *[f"b{r}" for r in range(1, k + 1)]))
    # estimates of growing balls could fall by chance, sizes do not
    return sizes.select("id", *[F.greatest(F.col(f"b{r}") - F.col(f"b{r - 1}"), F.lit(0)).cast("bigint")
                                .alias(f"ring_{r}") for r in range(1, k + 1)])


def khop_ring_labelled(g: CoGraph, k: int, seeds: DataFrame) -> DataFrame:
    """G5 + J2: seeds' ring with both labels; ids without a vertex are dropped."""
    ring = khop_ring(g, seeds, k)
    lab = g.vertices
    return (ring.join(lab.select("id", F.col("name").alias("seed_name")), "id")
                .join(lab.select(F.col("id").alias("other"),
                                 F.col("name").alias("other_name")), "other")
                .select(F.col("id").alias("seed_id"), "seed_name",
                        F.col("other").alias("id"), F.col("other_name").alias("name")))


def snowball(memberships: DataFrame, seeds: DataFrame, rounds: int = 3,
             work: str = "work_id", member: str = "member") -> tuple[DataFrame, DataFrame]:
    """Level-wise expansion from ``seeds`` (column ``member``).

    Round r expands every member first reached in round r − 1 (F7/J6: never
    one already expanded) to all co-members of all its works.  Returns
    ``(members, works)``: members (member, round) at distance <= rounds, and
    the membership rows of the works collected, i.e. the works of members at
    distance <= rounds − 1 (the reference saves those lines).
    """
    # Memberships are read twice a round and by the result: written once.
    m = _materialise(memberships.select(F.col(work).alias("work_id"),
                                        F.col(member).cast("bigint").alias("member")))
    # bitmaps need numbers; works of another type are compared with the earlier rounds' works
    numbered = isinstance(m.schema["work_id"].dataType, IntegralType)
    frontier = _materialise(seeds.select(F.col("member").cast("bigint")).distinct())
    visited, collected = Visited(frontier, "member"), None
    rounds_found, works_found = [frontier.withColumn("round", F.lit(0))], []
    for r in range(1, rounds + 1):
        works = m.join(frontier, "member").select("work_id").distinct()
        if collected is not None:
            works = collected.new_of(works)
        elif works_found:
            works = works.join(_union(works_found), "work_id", "left_anti")
        works = _materialise(works)
        works_found.append(works)
        if numbered and r < rounds:
            if collected is None:
                collected = Visited(works, "work_id")
            else:
                collected.add(works)
        frontier = _materialise(visited.new_of(m.join(works, "work_id").select("member").distinct()))
        if r < rounds:
            visited.add(frontier)
        rounds_found.append(frontier.withColumn("round", F.lit(r)))
    return _union(rounds_found), m.join(_union(works_found), "work_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_seen_label(labelled: DataFrame, id_col: str = "member",
                     name: str = "name", order: str = "round") -> DataFrame:
    """M3: merge labels over rounds; the earliest round's label wins.

    ``min_by`` is a declarative aggregate, so a member seen in a third of
    all rows still costs one partial row per map task.
    """
    return labelled.groupBy(id_col).agg(
        F.min_by(F.struct(F.col(name), F.col(order)), F.struct(F.col(order), F.col(name)))
         .getField(name).alias(name))


def snowball_labelled(memberships: DataFrame, seeds: DataFrame, vertices: DataFrame,
                      rounds: int = 3) -> DataFrame:
    """(member, name, round) with labels from the vertex list ("" if absent);
    of an id listed several times the label first met stays (M3)."""
    found, _ = snowball(memberships, seeds, rounds)
    named = attach_label(found.withColumnRenamed("member", "id"), vertices) \
        .select(F.col("id").alias("member"), "name", "round")
    label = first_seen_label(named)
    return found.join(label, "member").select("member", "name", "round")
