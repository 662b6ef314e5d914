"""Heavy edges without all pairs.

``graph.heavy_edges`` counts every pair of co-members and then drops most of
them.  Here two members with at least ``min_w`` common works are found by
prefix filtering:

* Works are ordered by size, small ones first (then by id).  If two members
  share t works, then each has at least t - 1 common works after the first
  common one, so that one is not among the t - 1 last works of either.  Only
  the rest of a member's works, its *prefix*, can start a pair: the large works
  of a member, which would make most pairs, are left out of the self-join.
* Members with fewer than t works, and works of one member, take no part.
* The candidates know how many prefix works they share.  What is left of the
  overlap lies in the t - 1 last works of the member whose prefix ends first:
  a work in the other's rest but in this one's prefix would come after the end
  of that prefix.  So a candidate is verified with t - 1 probes.

Where works are so large that the prefixes still make many more pairs than there
are rows, and leave out less than three quarters of all pairs, candidates would
be as many as the pairs of members.  All common works are then counted in one pass
over pairs of member blocks (``cooccur.dense_edges``): no pair is written or
shuffled, only those that reach ``min_w`` leave their task.

The last t - 1 works of a member are a top-k per group (a partial group limit
runs before the shuffle) and their least one is the bound of the prefix, so no
task sorts all works of a member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cooccur import (DEFAULT_BLOCK_ROWS, PAIRS_PER_TASK, _normalise, block_count, dense_edges, is_dense, pair_load,
                      work_blocks)


def _ordered(memberships: DataFrame, min_w: int, work: str, member: str) -> DataFrame:
    """(work_id, member, at): rows that can count, ``at`` (size, work) being
    the work's place in the common order."""
    m = _normalise(memberships, work, member)
    sizes = m.groupBy("work_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    m = m.join(sizes, "work_id")
    enough = (m.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_w).select("member"))
    return m.join(enough, "member").select(
        "work_id", "member", F.struct("k", F.col("work_id").alias("work")).alias("at"))


def _last_works(ordered: DataFrame, min_w: int) -> DataFrame:
    """(work_id, member, at): the ``min_w`` - 1 last works of every member."""
    last = Window.partitionBy("member").orderBy(F.col("at").desc())
    return (ordered.withColumn("place", F.row_number().over(last)).where(F.col("place") < min_w)
            .select("work_id", "member", "at"))


def _prefixes(ordered: DataFrame, last: DataFrame) -> DataFrame:
    """(work_id, member, at, end): the rows of every member's prefix."""
    ends = last.groupBy(F.col("member").alias("m")).agg(F.min("at").alias("end"))
    return (ordered.join(ends, F.col("member") == F.col("m"), "left")
            .where(F.col("end").isNull() | (F.col("at") < F.col("end"))))


def prefix_candidates(ordered: DataFrame, last: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(src, dst, shared, src_first): pairs src < dst with a common work in
    their prefixes, how many, and whether the prefix of src ends first.

    Works above ``block_rows`` prefix rows are split into hash blocks, every
    pair of blocks being its own join key, as in ``cooccur.member_pairs``.
    """
    prefix = _prefixes(ordered, last)
    # the end of a prefix travels as one number pair; null (no rest) is the last of all
    prefix = prefix.select("work_id", "member", F.coalesce(F.col("end.k"), F.lit(2 ** 62)).alias("end_k"),
                           F.col("end.work").alias("end_work"))
    blocks = work_blocks(prefix, block_rows, carry=("end_k", "end_work"))
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    end = F.struct("end_k", "end_work")
    left = blocks.select("work_id", F.col("member").alias("src"), end.alias("src_end"),
                         F.col("blk").alias("bi"), every.alias("bj"))
    right = blocks.select("work_id", F.col("member").alias("dst"), end.alias("dst_end"),
                          every.alias("bi"), F.col("blk").alias("bj"))
    pairs = (left.join(right, ["work_id", "bi", "bj"]).where(F.col("src") < F.col("dst"))
             .select("src", "dst", (F.col("src_end") < F.col("dst_end")).alias("src_first")))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"),
                                           F.bool_or("src_first").alias("src_first"))


def heavy_overlaps(memberships: DataFrame, min_w: int, block_rows: int = DEFAULT_BLOCK_ROWS,
                   work: str = "work_id", member: str = "member",
                   pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """F2 on A4: (src, dst, w) for every pair src < dst that shares at least
    ``min_w`` works, with the exact number.

    Each (work, member) row is expected once.  Rows with a null key take no
    part; members with equal works and works of any size are handled alike.
    """
    if min_w < 1:
        raise ValueError("min_w must be at least 1")
    ordered = cut_lineage(_ordered(memberships, min_w, work, member))     # read four times
    last = cut_lineage(_last_works(ordered, min_w))
    rows, pairs = pair_load(ordered)
    blocks = block_count(pairs, pairs_per_task)
    if is_dense(rows, pairs, blocks):
        _, started = pair_load(_prefixes(ordered, last))
        if is_dense(rows, started, blocks) and 4 * started > pairs:
            return dense_edges(ordered, blocks, min_w=min_w)
    found = cut_lineage(prefix_candidates(ordered, last, block_rows))
    first = F.when(F.col("src_first"), F.col("src")).otherwise(F.col("dst"))
    other = F.when(F.col("src_first"), F.col("dst")).otherwise(F.col("src"))
    probes = (found.select("src", "dst", first.alias("first"), other.alias("member"))
              .join(last.select(F.col("member").alias("first"), "work_id"), "first"))
    hits = (probes.join(ordered.select("member", "work_id"), ["member", "work_id"])
            .select("src", "dst", F.lit(1).cast("bigint").alias("shared")))
    return (found.select("src", "dst", "shared").unionByName(hits)
            .groupBy("src", "dst").agg(F.sum("shared").alias("w")).where(F.col("w") >= min_w))
