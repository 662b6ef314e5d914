"""Daily tables as a partitioned source, a Python data source.

``daily_csv.read_daily_csv`` takes a whole file as one value.  Here a file is a
partition, and a long one several, cut by byte range at line ends; a file is
streamed, never held.  The day is known from the file's name (or its folder
``date=YYYY-MM-DD``) and is a column of its own, so a filter on ``date`` chooses
the files before anything is opened.

A row's place counts all lines of its file.  Where a file is cut, the lines of its
earlier parts are counted first, and only there: one count per part is summed up,
not one per row.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    In, InputPartition, LessThan, LessThanOrEqual)

from ..functions.scalars import category_prefix, date_parts_from_filename, month_key, parse_percent
from ..session import ship_package
from .daily_csv import CSV_SCHEMA, SKIP_ROWS
from .replay import open_fs

SPLIT_BYTES = 64 << 20
DAY = re.compile(r"(\d{4}-\d{2}-\d{2})")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BATCH_LINES = 8_192
READ_BYTES = 1 << 20


@dataclass
class DayPart(InputPartition):
    date: str
    file: str          # name of the file, or its day where days are folders
    path: str
    split: int
    start: int
    end: int


def day_files(path: str, day_folders: bool) -> list[tuple[str, str, str, int]]:
    """(date, file, path, bytes) of every daily file under ``path``."""
    from pyarrow import fs
    files, root = open_fs(path)
    out = []
    for f in files.get_file_info(fs.FileSelector(root, recursive=day_folders)):
        name = f.base_name
        if f.type != fs.FileType.File or name.startswith(("_", ".")):
            continue
        folder = posixpath.basename(posixpath.dirname(f.path))
        day = re.fullmatch(r"date=(.*)", folder) if day_folders else DAY.match(name)
        if day:
            out.append((day.group(1), day.group(1) if day_folders else name, f.path, f.size))
    return sorted(out)


class DailyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.folders = options.get("day_folders", "false") == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.days: list = []               # pushed filters on the day

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if known and f.attribute == ("date",):
                self.days.append(f)
            else:
                yield f

    def _wanted(self, day: str) -> bool:
        tests = {EqualTo: lambda v: day == v, In: lambda v: day in v, GreaterThan: lambda v: day > v,
                 GreaterThanOrEqual: lambda v: day >= v, LessThan: lambda v: day < v, LessThanOrEqual: lambda v: day <= v}
        return all(tests[type(f)](f.value) for f in self.days)

    def partitions(self) -> list[DayPart]:
        out = []
        for day, file, path, size in day_files(self.path, self.folders):
            if self._wanted(day):
                cuts = [*range(0, size, self.split_bytes), size]
                out += [DayPart(day, file, path, n, a, b) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return out

    def read(self, partition: DayPart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:               # no file is left
            return
        lines: list[str] = []
        row = 0

        def batch() -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.date] * n), pa.array([partition.file] * n), pa.array([partition.path] * n),
                 pa.array([partition.split] * n, pa.int32()), pa.array(range(row - n, row), pa.int64()), pa.array(lines)],
                names=["date", "file", "path", "split", "row", "line"])

        for line in lines_between(self.path, partition):
            lines.append(line.decode("utf-8", "replace"))
            row += 1
            if len(lines) == BATCH_LINES:
                yield batch()
                lines = []
        if lines:
            yield batch()


def lines_between(root: str, part: DayPart) -> Iterator[bytes]:
    """The lines that start in a byte range, without their ends."""
    files, _ = open_fs(root)
    with files.open_input_file(part.path) as f:
        at = part.start
        rest = b""
        if at:                              # the line that goes on here is the range's before
            f.seek(at - 1)
            skipping, at = True, at - 1
        else:
            skipping = False
        while True:
            data = f.read(READ_BYTES)
            if not data:
                break
            if skipping:
                cut = data.find(b"\n")
                at += len(data) if cut < 0 else cut + 1
                if cut < 0:
                    if at >= part.end:
                        return
                    continue
                skipping, data = False, data[cut + 1:]
                if at >= part.end:
                    return
            pieces = (rest + data).split(b"\n")
            rest = pieces.pop()
            for line in pieces:
                yield line[:-1] if line.endswith(b"\r") else line
                at += len(line) + 1
                if at >= part.end:
                    return
        if rest and at < part.end:
            yield rest[:-1] if rest.endswith(b"\r") else rest


class DailySource(DataSource):
    """Batch source ``coweave_daily``; options ``path``, ``day_folders``,
    ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "coweave_daily"

    def schema(self) -> str:
        return "date string, file string, path string, split int, row bigint, line string"

    def reader(self, schema) -> DailyReader:
        return DailyReader(dict(self.options))


def read_daily(spark: SparkSession, path: str, day_folders: bool = False, days=None,
               split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """S4 → (file, year, month, day, month_key, pos, name, pct), as
    ``daily_csv.read_daily_csv``; ``days`` is a condition on the column ``date``
    (text, YYYY-MM-DD) that chooses the files.

    Files without a day in their name are left out; an empty folder has no rows.
    """
    ship_package(spark)
    spark.dataSource.register(DailySource)
    spark.conf.set(PUSHDOWN, "true")
    lines = (spark.read.format("coweave_daily").option("path", path).option("day_folders", str(day_folders).lower())
             .option("split_bytes", str(split_bytes)).load())
    if days is not None:
        lines = lines.where(days)
    line_no = F.col("row")
    if any(size > split_bytes for *_, size in day_files(path, day_folders)):
        # one count per part of a file; what lies before a part is their running sum
        parts = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.select(F.col("path").alias("p"), F.col("split").alias("s"),
                              F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        lines = lines.join(before, (F.col("path") == F.col("p")) & (F.col("split") == F.col("s")))
        line_no = F.col("before") + F.col("row")
    rows = lines.withColumn("line_no", line_no).where((F.col("line_no") >= SKIP_ROWS) & (F.length("line") > 0))
    rec = F.from_csv(F.col("line"), CSV_SCHEMA)
    y, m, d = date_parts_from_filename(F.col("file"))
    return rows.select("file", y.alias("year"), m.alias("month"), d.alias("day"), month_key(y, m).alias("month_key"),
                       (F.col("line_no") - SKIP_ROWS).alias("pos"), category_prefix(rec["c0"]).alias("name"),
                       parse_percent(rec["c2"]).alias("pct"))
