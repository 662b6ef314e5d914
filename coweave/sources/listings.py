"""Clustered store of member listings.

``text.write_memberships`` keeps the reference's shape, one folder a member,
which is millions of files for millions of members.  Here an append is a set of
files, in proportion to its bytes, that are sorted by member over all of them
(range partitioning), and an index table says where each member's rows are::

    {path}/rows/append=<name>/    part files: member, value (the line)
    {path}/index/append=<name>/   member, file, first, rows

One member's listing reads the index (sorted, so one row group answers) and
opens the files it names, as a rule one per append.  A member with more rows than
a file holds is spread over several, since the line is part of the range key.  An
append counts once its index is written whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maps import ids_to_line

ROW_SCHEMA = "member bigint, value string"
INDEX_SCHEMA = "member bigint, file string, first bigint, rows bigint"


def write_listings(lines: DataFrame, path: str, member: str = "member", members: str = "members",
                   append: str | None = None) -> str:
    """S13 + P10: append the listings ``lines`` (member, members array) and
    return the append's name.  Writing an append of the same name again replaces
    it, so a writer that died is simply run again.  Rows without member or
    members are left out."""
    spark, path = lines.sparkSession, path.rstrip("/")
    append = append or uuid.uuid4().hex
    rows, index = f"{path}/rows/append={append}", f"{path}/index/append={append}"
    out = lines.where(F.col(member).isNotNull() & F.col(members).isNotNull()).select(
        F.col(member).cast("bigint").alias("member"),
        F.concat(ids_to_line(F.col(members)), F.lit(" ")).alias("value"))
    # bounds of the ranges are sampled to the driver, so a line takes part by its beginning
    (out.repartitionByRange("member", F.substring("value", 1, 32)).sortWithinPartitions("member", "value")
     .write.mode("overwrite").parquet(rows))
    at = F.col("_metadata.row_index")
    places = (spark.read.schema(ROW_SCHEMA).parquet(rows)
              .select("member", F.col("_metadata.file_name").alias("file"), at.alias("at"))
              .groupBy("member", "file").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")))
    places.repartitionByRange("member").sortWithinPartitions("member", "file").write.mode("overwrite").parquet(index)
    return append


def _appends(spark: SparkSession, path: str) -> list[str]:
    """Names of the appends that count (their index is whole)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/index")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted(n[len("append="):] for n in names if n.startswith("append=")
                  and fs.exists(hadoop.Path(root, f"{n}/_SUCCESS")))


def _lines(rows: DataFrame, append: str) -> DataFrame:
    """(member, file, line_no, members): file and line_no identify a listing."""
    file = F.concat(F.lit(f"{append}/"), F.col("_metadata.file_name"))
    ids = F.filter(F.split("value", " "), lambda x: x != "")
    return rows.select("member", file.alias("file"), F.col("_metadata.row_index").alias("line_no"),
                       F.transform(ids, lambda x: x.cast("bigint")).alias("members"))


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], "member bigint, file string, line_no bigint, members array<bigint>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """S3: every listing as (member, file, line_no, members); a plain scan, the
    place in a file comes from the file format."""
    path = path.rstrip("/")
    return _union([_lines(spark.read.schema(ROW_SCHEMA).parquet(f"{path}/rows/append={a}"), a)
                   for a in _appends(spark, path)], spark)


def read_member(spark: SparkSession, path: str, member: int) -> DataFrame:
    """S3 for one member: only the files that the index names are opened, and in
    them only the row groups with the member."""
    path, parts = path.rstrip("/"), []
    for a in _appends(spark, path):
        index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index/append={a}")
        # as many rows as files hold the member's lines, one as a rule
        files = [r["file"] for r in index.where(F.col("member") == member).select("file").collect()]
        if files:
            rows = spark.read.schema(ROW_SCHEMA).parquet(*[f"{path}/rows/append={a}/{f}" for f in files])
            parts.append(_lines(rows, a).where(F.col("member") == member))
    return _union(parts, spark)


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """(append, member, file, first, rows) of all appends that count."""
    path, parts = path.rstrip("/"), []
    for a in _appends(spark, path):
        index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index/append={a}")
        parts.append(index.select(F.lit(a).alias("append"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
