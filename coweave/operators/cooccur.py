"""Membership rows → weighted co-occurrence edges (SURVEY §2: J8, J9, A4, A5,
A11, X1, M4).

A membership row says "member m took part in work w".  The weight of a pair
is the number of works both took part in.  The pair list *is* the output
(the graph's edges), so its size is inherent; what must not happen is one
task building all pairs of a huge work.  ``cooccurrence_edges`` therefore
cuts every work larger than ``block_rows`` members into ``nb`` hash blocks
and joins block i with block j on the key (work, i, j): each block pair is
its own join key, so one hot work is spread over nb² tasks, and each pair is
produced exactly once.  Works under the threshold keep nb = 1 and pay
nothing.  Pair counts are then summed with map-side partial aggregation.

Where works are so large that there are many more pairs than rows
(``dense_edges``), no pair is shuffled: members are dealt into blocks, the rows
of two blocks meet in one task, and the pairs between the two are counted there.
How many tasks there are follows the number of pairs, which is counted first
from the sizes of the works.

Metrics that do not need the pairs are computed without them
(``weighted_degree_from_memberships``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, written_files

DEFAULT_BLOCK_ROWS = 2048
PAIRS_PER_TASK = 16_000_000    # of a cell of dense_edges
ROWS_PER_TASK = 2_000_000      # of a shuffle sized by its rows
PAIRS_AT_ONCE = 1 << 20        # of a cell, while they are counted
MATRIX_PLACES = 1 << 24        # a cell of more pairs of members counts sorted pairs


def _normalise(memberships: DataFrame, work: str, member: str, carry: tuple[str, ...] = ()) -> DataFrame:
    # Rows with a null key take part in no pair.  Filtering them here, once,
    # makes every branch below share one identical subtree, so Spark reuses
    # a single scan + exchange for the sizes and both join sides.
    return (memberships.select(F.col(work).alias("work_id"),
                               F.col(member).cast("bigint").alias("member"), *carry)
            .where(F.col("work_id").isNotNull() & F.col("member").isNotNull()))


def work_blocks(memberships: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS,
                work: str = "work_id", member: str = "member", carry: tuple[str, ...] = ()) -> DataFrame:
    """Attach ``nb`` (hash blocks of the row's work) and ``blk`` to each row;
    the columns in ``carry`` come along.

    Only works above ``block_rows`` are looked up; that list is at most
    rows / block_rows long, and AQE broadcasts it only once its measured size
    is under the broadcast threshold, falling back to a shuffle join.
    """
    m = _normalise(memberships, work, member, carry)
    hot = (m.groupBy("work_id").agg(F.count(F.lit(1)).alias("k"))
            .where(F.col("k") > block_rows)
            .select("work_id",
                    F.ceil(F.col("k") / F.lit(block_rows)).cast("int").alias("nb")))
    m = (m.join(hot, "work_id", "left")
          .withColumn("nb", F.coalesce(F.col("nb"), F.lit(1))))
    return m.withColumn("blk", F.pmod(F.xxhash64("member"), F.col("nb")).cast("int"))


def member_pairs(memberships: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS,
                 work: str = "work_id", member: str = "member", partitions: int | None = None,
                 largest: int | None = None) -> DataFrame:
    """(work_id, src, dst) for every pair src < dst inside a work; dealt over
    ``partitions`` tasks where that is more than the session's number.

    Where the ``largest`` work is known and no larger than ``block_rows``, no work
    is cut: its rows meet on the work alone, without a list of large works."""
    if largest is not None and largest <= block_rows:
        m = dealt(_normalise(memberships, work, member), partitions, "work_id")
        return (m.withColumnRenamed("member", "src").join(m.withColumnRenamed("member", "dst"), "work_id")
                 .where(F.col("src") < F.col("dst")).select("work_id", "src", "dst"))
    m = work_blocks(memberships, block_rows, work, member)
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = m.select("work_id", F.col("member").alias("src"),
                    F.col("blk").alias("bi"), every.alias("bj"))
    right = m.select("work_id", F.col("member").alias("dst"),
                     every.alias("bi"), F.col("blk").alias("bj"))
    left, right = (dealt(side, partitions, "work_id", "bi", "bj") for side in (left, right))
    return (left.join(right, ["work_id", "bi", "bj"])
                .where(F.col("src") < F.col("dst"))
                .select("work_id", "src", "dst"))


def pair_load(memberships: DataFrame, work: str = "work_id", member: str = "member") -> tuple[int, int]:
    """(rows, pairs): how many rows there are and how many pairs their works
    make, from the sizes of the works."""
    return work_load(memberships, work, member)[:2]


def work_load(memberships: DataFrame, work: str = "work_id", member: str = "member") -> tuple[int, int, int]:
    """(rows, pairs, largest): ``pair_load`` and the rows of the largest work."""
    k = F.col("k").cast("double")
    load = (_normalise(memberships, work, member).groupBy("work_id").agg(F.count(F.lit(1)).alias("k"))
            .agg(F.sum("k").alias("rows"), F.sum(k * (k - 1) / 2).alias("pairs"), F.max("k").alias("largest")).first())
    return load["rows"] or 0, int(load["pairs"] or 0), load["largest"] or 0


def block_count(pairs: int, pairs_per_task: int = PAIRS_PER_TASK) -> int:
    """Blocks of members, so that two of them share about ``pairs_per_task`` pairs."""
    return max(1, math.ceil(math.sqrt(2 * pairs / pairs_per_task)))


def is_dense(rows: int, pairs: int, blocks: int) -> bool:
    """Whether a copy of every row per block is less than all the pairs."""
    return pairs > 2 * rows * (blocks + 1)


def partitions_for(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int | None:
    """Shuffle partitions for ``rows`` where the session's number would give a
    partition more than ``per_task`` of them, else None."""
    n = math.ceil(rows / per_task)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into ``partitions``; None leaves it to the session."""
    return df.repartition(partitions, *keys) if partitions else df


def _codes(few: pa.ListArray, many: pa.ListArray, a: np.ndarray, b: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """a * width + b of every pair of a row's two lists, about PAIRS_AT_ONCE at a
    time; ``a`` and ``b`` are the places of the lists' members, list after list."""
    n_few, n_many = np.diff(few.offsets.to_numpy()), np.diff(many.offsets.to_numpy())
    start = np.repeat(np.cumsum(n_many) - n_many, n_few)       # of the list that an element of a meets
    n = np.repeat(n_many, n_few).astype(np.int64)
    up_to = np.cumsum(n)
    cuts = np.searchsorted(up_to, np.arange(PAIRS_AT_ONCE, up_to[-1] if len(up_to) else 0, PAIRS_AT_ONCE))
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
        if hi > lo:
            k = n[lo:hi]
            at = np.repeat(start[lo:hi] - np.cumsum(k) + k, k) + np.arange(k.sum())
            yield np.repeat(a[lo:hi] * width, k) + b[at]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their numbers, the same code added up."""
    code, n = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))[:len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


def count_pairs(cell: pa.Table, min_w: int = 1, ids: tuple[np.ndarray, np.ndarray] | None = None
                ) -> Iterator[pa.RecordBatch]:
    """(src, dst, w) of the pairs between two blocks of members that meet ``min_w``
    times, from rows of a work's members in the one (``few``) and in the other
    (``many``).  With ``ids``, those of both blocks, rows have places in them."""
    few, many = (pa.concat_arrays(cell[c].chunks) for c in ("few", "many"))
    apart = cell["apart"][0].as_py()
    ids_a, a = np.unique(few.flatten().to_numpy(), return_inverse=True)
    ids_b, b = np.unique(many.flatten().to_numpy(), return_inverse=True)
    if ids is not None:
        ids_a, ids_b = ids[0][ids_a], ids[1][ids_b]
    width = len(ids_b)
    matrix = len(ids_a) * width <= MATRIX_PLACES
    counts = np.zeros(len(ids_a) * width if matrix else 0, np.int32)
    parts, waiting, done = [], 0, 0
    for code in _codes(few, many, a, b, width):
        if matrix:
            np.add.at(counts, code, np.int32(1))
            continue
        parts.append(np.unique(code, return_counts=True))
        waiting += len(parts[-1][0])
        if waiting > max(2 * done, 4 * PAIRS_AT_ONCE):
            parts = [_counted(parts)]
            waiting = done = len(parts[0][0])
    all_codes, numbers = (None, counts) if matrix else _counted(parts) if parts else (counts, counts)
    for lo in range(0, len(numbers), PAIRS_AT_ONCE):
        n = numbers[lo:lo + PAIRS_AT_ONCE]
        enough = np.flatnonzero(n >= min_w)
        n, code = n[enough].astype(np.int64), lo + enough if matrix else all_codes[lo + enough]
        x, y = ids_a[code // width], ids_b[code % width]
        # within one block every pair is met from both sides
        keep = np.ones(len(x), bool) if apart else x < y
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[keep]) for c in (np.minimum(x, y), np.maximum(x, y), n)], names=["src", "dst", "w"])


def dense_edges(memberships: DataFrame, blocks: int, work: str = "work_id", member: str = "member",
                min_w: int = 1) -> DataFrame:
    """``cooccurrence_edges`` by pairs of member blocks; with ``min_w`` those of this weight at least.

    Members are dealt into ``blocks`` hash blocks and numbered in them, so a member
    is a place of two bytes; a work's members of one block travel as one list to every
    pair of blocks (a cell) it takes part in.  All pairs between two blocks are counted
    in the cell's task (``count_pairs``), which reads the two blocks' ids where they
    were written, so each row is copied ``blocks`` + 1 times and no pair is shuffled.
    """
    spark = memberships.sparkSession
    ship_package(spark)
    m = _normalise(memberships, work, member)
    blk = F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int").alias("blk")
    path = scratch_path(spark)
    (m.select("member").distinct().groupBy(blk).agg(F.sort_array(F.collect_list("member")).alias("ids"))
     .write.parquet(path))
    ids = spark.read.parquet(path)
    most = ids.agg(F.max(F.size("ids"))).first()[0] or 0
    places = ids.select("blk", F.posexplode("ids").alias("pos", "member"))
    lists = (m.join(places, "member").groupBy("work_id", "blk")
             .agg(F.collect_list(F.col("pos").cast("smallint" if most <= 1 << 15 else "int")).alias("ids")))
    cell = (F.expr("bj * (bj + 1) div 2").cast("int") + F.col("bi")).alias("cell")     # bi <= bj
    left = lists.select("work_id", F.col("ids").alias("few"), F.col("blk").alias("bi"),
                        F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("bj"))
    right = lists.select("work_id", F.col("ids").alias("many"), F.col("blk").alias("bj"),
                         F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("bi"))
    cells = blocks * (blocks + 1) // 2
    left = left.select("work_id", "few", (F.col("bi") != F.col("bj")).alias("apart"), cell).repartitionById(cells, "cell")
    right = right.select("work_id", "many", cell).repartitionById(cells, "cell")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        number = rows["cell"][0].as_py()
        bj = (math.isqrt(8 * number + 1) - 1) // 2
        yield from count_pairs(rows, min_w, _block_ids(path, number - bj * (bj + 1) // 2, bj))

    # dealt by cell already: counted where the lists meet
    return (left.join(right, ["work_id", "cell"]).select("cell", "apart", "few", "many")
            .groupBy("cell").applyInArrow(edges, "src bigint, dst bigint, w bigint"))


def _block_ids(path: str, *blocks: int) -> tuple[np.ndarray, ...]:
    """The written ids of these blocks."""
    found = {}
    for file in written_files(path):
        for batch in file.iter_batches(batch_size=16):
            for blk, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blk in blocks:
                    found[blk] = row.values.to_numpy()
    return tuple(found[b] for b in blocks)


def cooccurrence_edges(memberships: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS,
                       work: str = "work_id", member: str = "member",
                       pairs_per_task: int = PAIRS_PER_TASK,
                       load: tuple[int, int, int] | None = None) -> DataFrame:
    """A4 (+A5 folded in): canonical edges (src < dst, w = shared works).

    Zero-weight pairs are never produced (Q4: the graph that was analysed had
    them removed).  Each (work, member) row is expected once; duplicated
    listings of the *same* work under different work ids count once per
    listing, as in the reference (Q12).

    The works' sizes (``load``, counted by one job if not given) tell how many
    pairs there are: by that they are dealt over tasks, or, where they are far
    more than the rows, counted block by block (``dense_edges``).
    """
    rows, pairs, largest = load or work_load(memberships, work, member)
    blocks = block_count(pairs, pairs_per_task)
    if is_dense(rows, pairs, blocks):
        return dense_edges(memberships, blocks, work, member)
    n = partitions_for(memberships.sparkSession, pairs)
    found = dealt(member_pairs(memberships, block_rows, work, member, n, largest).select("src", "dst"), n, "src", "dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def endpoints(memberships: DataFrame, work: str = "work_id", member: str = "member") -> DataFrame:
    """(id) of every member that shares a work with another one: the endpoints
    of ``cooccurrence_edges``, without building any pair."""
    m = _normalise(memberships, work, member)
    shared = (m.groupBy("work_id").agg(F.min("member").alias("lo"), F.max("member").alias("hi"))
              .where(F.col("lo") < F.col("hi")).select("work_id"))
    return m.join(shared, "work_id", "left_semi").select(F.col("member").alias("id")).distinct()


def fold_symmetric(pair_counts: DataFrame, src: str = "src", dst: str = "dst",
                   w: str = "w", partitions: int | None = None) -> DataFrame:
    """A5: add m[i][j] and m[j][i]; keep one row per unordered pair (src < dst).

    Self pairs (i == i) are dropped, as the reference only walks i < j.  The rows
    are dealt over ``partitions`` tasks if given.
    """
    a, b = F.col(src), F.col(dst)
    both = pair_counts.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"),
                                            F.col(w).alias("w"))
    return dealt(both, partitions, "src", "dst").groupBy("src", "dst").agg(F.sum("w").cast("bigint").alias("w"))


def symmetrize(edges: DataFrame, src: str = "src", dst: str = "dst", one_pass: bool = False) -> DataFrame:
    """Every edge plus its flipped copy (other columns carried).  With
    ``one_pass`` the edges are computed once and doubled row by row; without, they
    are read twice, which suits a written table."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    if one_pass:
        ways = [F.struct(F.col(a).alias(src), F.col(b).alias(dst), *rest) for a, b in ((src, dst), (dst, src))]
        return edges.select(F.inline(F.array(*ways)))
    flipped = edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest)
    return edges.select(src, dst, *rest).unionByName(flipped)


def weighted_degree_from_memberships(memberships: DataFrame, work: str = "work_id",
                                     member: str = "member") -> DataFrame:
    """A1 without building pairs: Σ over a member's works of (size − 1).

    Equal to the sum of edge weights at the member because every co-member
    of every work adds exactly one to one of the member's edges.  Members
    alone in all their works have no edge and are not returned (as A1).
    """
    m = _normalise(memberships, work, member)
    sizes = m.groupBy("work_id").agg(F.count(F.lit(1)).alias("k"))
    return (m.join(sizes, "work_id")
             .where(F.col("k") > 1)
             .groupBy(F.col("member").alias("id"))
             .agg(F.sum(F.col("k") - 1).cast("bigint").alias("coworks")))


def check_membership(memberships: DataFrame, vertices: DataFrame,
                     member: str = "member", vid: str = "id") -> DataFrame:
    """Raise if a member id is missing from the vertex list (Q17).

    One left-anti join and a count; returns the memberships unchanged.
    """
    unknown = (memberships.select(F.col(member).alias("_m")).distinct()
               .join(vertices.select(F.col(vid).alias("_m")), "_m", "left_anti"))
    first = unknown.limit(1).collect()
    if first:
        raise ValueError(f"member {first[0]['_m']} is not in the vertex list")
    return memberships


def count_works(memberships: DataFrame, work: str = "work_id",
                member: str = "member") -> DataFrame:
    """Totals of works and of distinct members (one row)."""
    return memberships.agg(
        F.count_distinct(work).cast("bigint").alias("works"),
        F.count_distinct(member).cast("bigint").alias("members"))


def dedup_members(memberships: DataFrame, member: str = "member") -> DataFrame:
    """M4: distinct members over all works."""
    return memberships.select(member).distinct()
