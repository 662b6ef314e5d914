"""Co-occurrence edges of growing input (SURVEY §2: A4, S12 as view
maintenance).

The reference appends to its pair file; here the pair counts of all
memberships so far are a maintained view.  A batch of new membership rows Δ
changes them by

    Δ(m ⋈ m) = (Δ ⋈ m) + (m ⋈ Δ) + (Δ ⋈ Δ)

so of the works that the batch touches only pairs with a new row are made.  New
and earlier rows meet once, as two lists per work; works above ``block_rows`` are
joined block by block instead.  How many tasks share the rows and the pairs follows
their numbers, counted first from the works' sizes.  A batch is kept as two tables of its own, its new rows and its
change of the edges::

    {path}/rows/batch=<id>/        (work_id, member)
    {path}/deltas/batch=<id>/      (src, dst, w)
    {path}/merged/upto=<id>/       edges of all batches up to <id>

A batch counts once its delta is written whole (Spark's own mark of a finished
write); appending a batch that counts already changes nothing, and one that was
cut off is written anew, so a batch may be replayed at any time.  The edges are
the newest merged table and the later deltas, summed; ``compact`` writes the
next merged table.  Batches are appended one after the other by one writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .cooccur import DEFAULT_BLOCK_ROWS, _normalise, dealt, partitions_for, work_blocks

EDGE_FIELDS = "src bigint, dst bigint, w bigint"


def pairs_with_new(rows: DataFrame | None, block_rows: int = DEFAULT_BLOCK_ROWS,
                   works: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every pair src < dst inside a work of ``rows`` (work_id,
    member, new), or of the lists ``works`` (see ``touched_works``), of which at
    least one row is new.

    New rows are the left side, all rows the right one; a pair of two new rows
    is met from its smaller member.  Works above ``block_rows`` are split into
    hash blocks, every pair of blocks being its own join key.
    """
    if rows is None:
        return pairs_of_touched(works)
    blocks = work_blocks(rows, block_rows, carry=("new",))
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = blocks.where("new").select("work_id", F.col("member").alias("a"), F.col("blk").alias("bi"), every.alias("bj"))
    right = blocks.select("work_id", F.col("member").alias("b"), F.col("new").alias("b_new"),
                          every.alias("bi"), F.col("blk").alias("bj"))
    a, b = F.col("a"), F.col("b")
    found = (left.join(right, ["work_id", "bi", "bj"]).where((a < b) | ((a > b) & ~F.col("b_new")))
             .select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")))
    return found if works is None else found.unionByName(pairs_of_touched(works))


def touched_works(rows: DataFrame) -> DataFrame:
    """(work_id, news, olds) of every work of ``rows`` (work_id, member, new) with
    members that only new rows have: these, and the members of its other rows."""
    member = F.col("member")
    return (rows.groupBy("work_id").agg(F.collect_list(F.when(F.col("new"), member)).alias("news"),
                                        F.collect_list(F.when(~F.col("new"), member)).alias("olds"))
            # which also leaves each once
            .select("work_id", F.array_except("news", "olds").alias("news"), "olds").where(F.size("news") > 0))


def pairs_of_touched(works: DataFrame) -> DataFrame:
    """(src, dst) for every pair of a work (work_id, news, olds) with a new member."""
    a, b = F.col("a"), F.col("b")
    return (works.select(F.explode("news").alias("a"), F.size("news").alias("n"), F.concat("news", "olds").alias("all"))
            .select("a", "n", F.posexplode("all").alias("at", "b")).where((F.col("at") >= F.col("n")) | (a < b))
            .select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")))


def _load(rows: DataFrame) -> tuple[int, int, int]:
    """(rows, most rows of a work that the batch touches, pairs with a new row) of
    ``rows`` (work_id, member, new), from the sizes of the works."""
    k, f = F.col("k").cast("double"), F.col("f").cast("double")
    got = (rows.groupBy("work_id").agg(F.count(F.lit(1)).alias("k"), F.count_if("new").alias("f"))
           .agg(F.sum("k").alias("rows"), F.max(F.when(f > 0, F.col("k"))).alias("most"),
                F.sum(f * (k - f) + f * (f - 1) / 2).alias("pairs")).first())
    return got["rows"] or 0, got["most"] or 0, int(got["pairs"] or 0)


class EdgeView:
    """The edges of the memberships appended so far."""

    def __init__(self, spark: SparkSession, path: str, block_rows: int = DEFAULT_BLOCK_ROWS):
        self.spark, self.path, self.block_rows = spark, path.rstrip("/"), block_rows

    def _finished(self, table: str, key: str) -> list[int]:
        """Numbers of the finished folders ``{table}/{key}=<number>``."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{table}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return sorted(int(n[len(key) + 1:]) for n in names if n.startswith(f"{key}=")
                      and fs.exists(hadoop.Path(root, f"{n}/_SUCCESS")))

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _merged_upto(self) -> int | None:
        merged = self._finished("merged", "upto")
        return merged[-1] if merged else None

    def batches(self) -> list[int]:
        """Numbers of the batches that count, in order."""
        return self._finished("counted", "batch")

    def memberships(self) -> DataFrame:
        """(work_id, member) of all batches that count."""
        paths = [f"{self.path}/rows/batch={b}" for b in self.batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def append(self, batch: int, memberships: DataFrame, work: str = "work_id", member: str = "member") -> bool:
        """Add a batch; False if it counted already.  Rows that are there
        already (or twice in the batch) add nothing; rows with a null key take
        part in no pair."""
        if batch in self.batches():
            return False
        rows, deltas = f"{self.path}/rows/batch={batch}", f"{self.path}/deltas/batch={batch}"
        met, old = _normalise(memberships, work, member).withColumn("new", F.lit(True)), self.memberships()
        if old is not None:
            met = met.unionByName(old.withColumn("new", F.lit(False)))
        n, most, n_pairs = _load(met)
        # rows are shuffled as they are, not as partial lists
        parts = partitions_for(self.spark, n)
        met, large = met.repartition(*([parts] if parts else []), "work_id"), None
        if most > self.block_rows:
            sizes = met.groupBy("work_id").agg(F.count(F.lit(1)).alias("k"), F.bool_or("new").alias("new"))
            hot = cut_lineage(sizes.where((F.col("k") > self.block_rows) & F.col("new")).select("work_id"))
            large = cut_lineage(met.join(hot, "work_id", "left_semi").groupBy("work_id", "member")
                                .agg(F.bool_and("new").alias("new")))
            met = met.join(hot, "work_id", "left_anti")
        works = cut_lineage(touched_works(met))
        new = works.select("work_id", F.explode("news").alias("member"))
        if large is not None:
            new = new.unionByName(large.where("new").select("work_id", "member"))
        new.write.mode("overwrite").parquet(rows)
        pairs = pairs_with_new(large, self.block_rows, works)
        delta = (dealt(pairs, partitions_for(self.spark, n_pairs), "src", "dst")
                 .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
        delta.write.mode("overwrite").parquet(deltas)
        for written in [works] if large is None else [works, hot, large]:
            discard(written)
        # the batch counts from here on: one empty table, written last
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/counted/batch={batch}")
        return True

    def edges(self) -> DataFrame:
        """(src, dst, w) of everything appended so far."""
        upto = self._merged_upto()
        paths = [] if upto is None else [f"{self.path}/merged/upto={upto}"]
        merged = set() if upto is None else set(self._merged_batches(upto))
        paths += [f"{self.path}/deltas/batch={b}" for b in self.batches() if b not in merged]
        if not paths:
            return self.spark.createDataFrame([], EDGE_FIELDS)
        written = self.spark.read.schema(EDGE_FIELDS).parquet(*paths)
        # the number of rows stands in the files' footers
        return (dealt(written, partitions_for(self.spark, written.count()), "src", "dst")
                .groupBy("src", "dst").agg(F.sum("w").alias("w")))

    def _merged_batches(self, upto: int) -> list[int]:
        kept = self.spark.read.parquet(f"{self.path}/merged_batches/upto={upto}")
        return [r["batch"] for r in kept.collect()]       # one number per appended batch

    def compact(self) -> None:
        """Merge what is there into one table and drop the one before.  Nothing
        reads the deltas it holds any more, except a reader that began before;
        they stay on disk until the next merge."""
        batches, before = self.batches(), self._merged_upto()
        if not batches or (before is not None and set(self._merged_batches(before)) == set(batches)):
            return
        done = [] if before is None else self._merged_batches(before)
        upto = 0 if before is None else before + 1
        (self.spark.createDataFrame([(b,) for b in batches], "batch bigint").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/merged_batches/upto={upto}"))
        self.edges().write.mode("overwrite").parquet(f"{self.path}/merged/upto={upto}")
        for b in done:
            self._delete(f"deltas/batch={b}")
        if before is not None:
            self._delete(f"merged/upto={before}")
            self._delete(f"merged_batches/upto={before}")
