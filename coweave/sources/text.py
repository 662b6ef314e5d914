"""Plain-text graph files.

All reads are line-wise ``spark.read.text`` / ``csv`` scans, split across
tasks by file block; nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE_SCHEMA = "src BIGINT, dst BIGINT, w BIGINT"


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """S1 + P1: lines ``id label`` → (id BIGINT, name STRING).

    The id ends at the first run of whitespace; the rest of the line,
    trimmed, is the label (a label after two spaces is kept, Q2).  A line
    whose id does not parse fails the job.
    """
    parts = F.split(F.trim(F.col("value")), r"\s+", 2)
    return (spark.read.text(path)
            .select(_number(parts.getItem(0)).alias("id"),
                    F.coalesce(F.trim(parts.getItem(1)), F.lit("")).alias("name")))


def _number(text):
    """An id as a number; anything else fails the job, naming the text."""
    bad = F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(text, F.lit("")))).cast("bigint")
    return F.coalesce(text.try_cast("bigint"), bad)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``src dst w`` → typed edges, each pair as written.  A line
    that does not parse fails the job."""
    return spark.read.csv(path, sep=" ", schema=EDGE_SCHEMA, mode="FAILFAST")


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """S3: a directory of per-member files, one line per work, ids split by
    spaces (trailing space allowed) → (file, line_no, members ARRAY<BIGINT>).

    ``file`` (the path) and ``line_no`` (from 0, within the file) identify the
    work listing, however the input is split (Q12: the same work in two files
    counts twice).  Lines are numbered file by file: a file holds the works of
    one member.  An id that does not parse fails the job.
    """
    ids = F.filter(F.split(F.trim(F.col("value")), r"\s+"), lambda x: x != "")
    in_file = Window.partitionBy("file").orderBy("block", "row")
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"),
                    F.transform(ids, _number).alias("members"))
            .withColumn("line_no", (F.row_number().over(in_file) - 1).cast("bigint"))
            .where(F.size("members") > 0).select("file", "line_no", "members"))


def membership_rows(lines: DataFrame) -> DataFrame:
    """S3 → (work_id, member) rows for the co-occurrence operators; the work
    is the listing's file and line."""
    return lines.select(F.concat_ws("#", "file", F.col("line_no").cast("string")).alias("work_id"),
                        F.explode("members").alias("member"))


def write_pair_counts(edges: DataFrame, path: str, mode: str = "append") -> None:
    """``src dst w`` lines, appended."""
    edges.select(F.concat_ws(" ", "src", "dst", "w").alias("value")) \
         .write.mode(mode).text(path)


def write_memberships(lines: DataFrame, path: str, member: str = "member",
                      members: str = "members", mode: str = "append") -> None:
    """S13 + P10: one output directory per member, one line per work, the
    ids space-separated with the trailing space the reference leaves."""
    line = F.concat(F.array_join(F.transform(F.col(members), lambda x: x.cast("string")), " "),
                    F.lit(" "))
    # hashed by member first, so a member's folder gets one file, not one per task
    lines.select(F.col(member).cast("string").alias("member"), line.alias("value")) \
         .repartition("member").write.partitionBy("member").mode(mode).text(path)


def write_vertices(vertices: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``id label`` lines."""
    vertices.select(F.concat_ws(" ", F.col("id").cast("string"), "name").alias("value")) \
            .write.mode(mode).text(path)
