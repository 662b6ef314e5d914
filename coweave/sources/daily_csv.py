"""Daily category tables.

A daily file ``YYYY-MM-DD.csv`` has two leading rows to skip; column 0 is
``category/...`` and column 2 the percent change.  Spark's CSV reader can
drop only one header line per file, so each file is read as one text value
(a daily table is small and bounded by the source's page size; the many
files spread over tasks), split into lines with their position, and the
lines are parsed with ``from_csv`` (quoted commas kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import category_prefix, date_parts_from_filename, month_key, parse_percent

SKIP_ROWS = 2     # fixed: leading rows of every daily file
N_COLUMNS = 11    # fixed: columns of a daily file
CSV_SCHEMA = ", ".join(f"c{i} STRING" for i in range(N_COLUMNS))


def read_daily_csv(spark: SparkSession, path: str, day_folders: bool = False) -> DataFrame:
    """S4 → (file, year, month, day, month_key, pos, name, pct).

    The day is the file's name, or with ``day_folders`` that of its folder
    ``date=YYYY-MM-DD``.

    ``pos`` is the 0-based data row within its file (file order, the
    tie-break of the per-file top list).
    """
    name = F.col("_metadata.file_name")
    if day_folders:
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/date=([^/]*)/[^/]*$", 1)
    raw = (spark.read.option("recursiveFileLookup", str(day_folders).lower())
           .text(path, wholetext=True).select(name.alias("file"), F.col("value")))
    lines = raw.select("file", F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("line_no", "line"))
    rows = lines.where((F.col("line_no") >= SKIP_ROWS) & (F.length("line") > 0))
    rec = F.from_csv(F.col("line"), CSV_SCHEMA)
    y, m, d = date_parts_from_filename(F.col("file"))
    return rows.select(
        "file", y.alias("year"), m.alias("month"), d.alias("day"),
        month_key(y, m).alias("month_key"),
        (F.col("line_no") - SKIP_ROWS).alias("pos"),
        category_prefix(rec["c0"]).alias("name"),
        parse_percent(rec["c2"]).alias("pct"))


def write_daily_csv(df: DataFrame, path: str, date_col: str = "date",
                    mode: str = "overwrite") -> None:
    """One CSV directory per date, with a header row."""
    df.write.partitionBy(date_col).mode(mode).option("header", True).csv(path)
