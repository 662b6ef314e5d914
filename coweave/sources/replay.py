"""Replay as a streaming source, and two topics in one commit (SURVEY §2: S7,
W10, S6, W5), as Python data sources.

**Replay.**  ``write_replay`` encodes the rows once, in one job, into one folder
per period, in the order of the periods.  ``ReplaySource`` serves that table as a
stream: an offset is the number of periods given out, every trigger admits one
period more, and the files of a period are its partitions.  ``progress`` names a
folder in which the source keeps the last offset that Spark has committed, so a
query that is started again goes on behind it.

**Topics.**  ``TopicSink`` takes rows (topic, value).  A task writes a file per
topic under a name of its own; the driver then publishes one manifest per epoch
that names the files of all topics.  Only what a manifest names can be read, so
the topics of an epoch become visible together or not at all; an epoch written
again replaces its manifest, and an aborted one removes its files.

Paths are URIs of any store that ``pyarrow.fs`` reaches; a path without a scheme
is one of the shared file system.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter,
                                    DataSourceWriter, InputPartition, WriterCommitMessage)

from ..session import ship_package

PERIOD = "period"


def open_fs(path: str):
    """(file system, path in it) of a URI or plain path."""
    from pyarrow import fs
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:", "", path)


def _names(files, folder: str) -> list[str]:
    from pyarrow import fs
    return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _put(files, path: str, text: str) -> None:
    """Write a small file whole: under another name first, then moved."""
    files.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as out:
        out.write(text.encode())
    files.move(part, path)


# --------------------------------------------------------------------------
# replay

def write_replay(df: DataFrame, path: str, batch_col: str = "batch_no") -> None:
    """All rows as JSON messages, one folder per period, in one job.  Rows
    are dealt by range of the period and a hash, so a large period has several
    files (its partitions later) and small ones share a task."""
    rest = [c for c in df.columns if c != batch_col]
    out = df.select(F.col(batch_col).cast("bigint").alias(PERIOD), F.to_json(F.struct(*rest)).alias("value"))
    (out.repartitionByRange(PERIOD, F.xxhash64("value")).sortWithinPartitions(PERIOD, "value")
     .write.mode("overwrite").partitionBy(PERIOD).parquet(path))


@dataclass
class PeriodFile(InputPartition):
    period: int
    place: int
    path: str


class ReplayReader(DataSourceStreamReader):
    """Offsets count periods; ``latestOffset`` moves on by ``periods`` (one) a call."""

    def __init__(self, options: dict):
        self.path, self.progress = options["path"].rstrip("/"), options["progress"].rstrip("/")
        self.step = int(options.get("periods", 1))
        files, root = open_fs(self.path)
        found = (re.fullmatch(rf"{PERIOD}=(-?\d+)", n) for n in _names(files, root))
        self.periods = sorted(int(m.group(1)) for m in found if m)
        self.given = self._committed()

    def _mark(self) -> tuple:
        files, folder = open_fs(self.progress)
        return files, posixpath.join(folder, "committed.json")

    def _committed(self) -> int:
        files, mark = self._mark()
        if files.get_file_info(mark).type.name == "NotFound":
            return 0
        with files.open_input_stream(mark) as f:
            return json.loads(f.read())["periods"]

    def initialOffset(self) -> dict:
        return {"periods": 0}

    def latestOffset(self) -> dict:
        self.given = min(self.given + self.step, len(self.periods))
        return {"periods": self.given}

    def partitions(self, start: dict, end: dict) -> list[PeriodFile]:
        # a query that was started again may be ahead of what was committed here
        self.given = max(self.given, end["periods"])
        files, root = open_fs(self.path)
        out = []
        for period in self.periods[start["periods"]:end["periods"]]:
            folder = posixpath.join(root, f"{PERIOD}={period}")
            names = [n for n in _names(files, folder) if n.endswith(".parquet")]
            out += [PeriodFile(period, i, f"{self.path}/{PERIOD}={period}/{n}") for i, n in enumerate(names)]
        return out

    def read(self, partition: PeriodFile) -> Iterator[pa.RecordBatch]:
        files, path = open_fs(partition.path)
        row = 0
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(8_192, columns=["value"]):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([partition.period] * n, pa.int64()),
                     pa.array([partition.place] * n, pa.int32()), pa.array(range(row, row + n), pa.int64())],
                    names=["value", PERIOD, "file", "row"])
                row += n

    def commit(self, end: dict) -> None:
        files, mark = self._mark()
        if end["periods"] > self._committed():
            _put(files, mark, json.dumps({"periods": end["periods"]}))


class ReplaySource(DataSource):
    """Streaming source ``coweave_replay``; options ``path``, ``progress`` and
    ``periods`` (a trigger, one unless given)."""

    @classmethod
    def name(cls) -> str:
        return "coweave_replay"

    def schema(self) -> str:
        return f"value string, {PERIOD} bigint, file int, row bigint"

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(dict(self.options))


def read_replay(spark: SparkSession, path: str, progress: str, periods: int = 1) -> DataFrame:
    """S7 + W10: the replay written at ``path`` as a stream of (value, arrival),
    one period a trigger (or a few).  ``progress`` is a folder of the query's own, kept as
    long as its checkpoint."""
    ship_package(spark)
    spark.dataSource.register(ReplaySource)
    stream = (spark.readStream.format("coweave_replay").option("path", path).option("progress", progress)
              .option("periods", str(periods)).load())
    return stream.select("value", F.struct(PERIOD, "file", "row").alias("arrival"))


# --------------------------------------------------------------------------
# topics

@dataclass
class Written(WriterCommitMessage):
    files: dict          # topic -> names under data/


class _TopicWriter:
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        """One file a topic, named by the task's attempt, so that no two meet."""
        files, root = open_fs(self.path)
        folder = posixpath.join(root, "data")
        files.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"{uuid.uuid4().hex}-{context.partitionId()}" if context else uuid.uuid4().hex
        out: dict[str, tuple] = {}
        try:
            for row in iterator:
                topic = row["topic"]
                if topic not in out:
                    file = f"{len(out)}-{name}.json"
                    out[topic] = file, files.open_output_stream(posixpath.join(folder, file))
                out[topic][1].write((row["value"] + "\n").encode())
        finally:
            for _, stream in out.values():
                stream.close()
        return Written({topic: file for topic, (file, _) in out.items()})

    def publish(self, messages: list, epoch: int) -> None:
        """One manifest names the files of all topics: they appear together."""
        named: dict[str, list[str]] = {}
        for m in messages:
            for topic, file in (m.files if m else {}).items():
                named.setdefault(topic, []).append(file)
        files, root = open_fs(self.path)
        _put(files, posixpath.join(root, "epochs", f"{epoch}.json"),
             json.dumps({t: sorted(names) for t, names in sorted(named.items())}))

    def discard(self, messages: list) -> None:
        files, root = open_fs(self.path)
        for m in messages:
            for file in (m.files if m else {}).values():
                files.delete_file(posixpath.join(root, "data", file))


class TopicStreamWriter(_TopicWriter, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.discard(messages)


class TopicBatchWriter(_TopicWriter, DataSourceWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.epoch = int(options["epoch"])

    def commit(self, messages: list) -> None:
        self.publish(messages, self.epoch)

    def abort(self, messages: list) -> None:
        self.discard(messages)


@dataclass
class TopicFile(InputPartition):
    epoch: int
    topic: str
    file: str


class TopicReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[TopicFile]:
        files, root = open_fs(self.path)
        out = []
        for name in _names(files, posixpath.join(root, "epochs")):
            if re.fullmatch(r"\d+\.json", name):
                with files.open_input_stream(posixpath.join(root, "epochs", name)) as f:
                    manifest = json.loads(f.read())
                out += [TopicFile(int(name[:-5]), t, n) for t, names in manifest.items() for n in names]
        return out

    def read(self, partition: TopicFile | None) -> Iterator[tuple]:
        if partition is None:               # nothing is published yet
            return
        files, root = open_fs(self.path)
        with io.BufferedReader(files.open_input_stream(posixpath.join(root, "data", partition.file))) as f:
            for line in f:
                yield partition.topic, line.rstrip(b"\n").decode(), partition.epoch


class TopicSink(DataSource):
    """Sink and source ``coweave_topics``; options ``path``, and ``epoch`` for a
    batch write.  Rows: topic, value, and when read the epoch."""

    @classmethod
    def name(cls) -> str:
        return "coweave_topics"

    def schema(self) -> str:
        return "topic string, value string, epoch bigint"

    def streamWriter(self, schema, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TopicBatchWriter:
        return TopicBatchWriter(dict(self.options))

    def reader(self, schema) -> TopicReader:
        return TopicReader(dict(self.options))


def write_topics(messages: DataFrame, path: str, epoch: int) -> None:
    """S6 + W5: the messages (topic, value) of one epoch, all topics in one
    commit.  An epoch written again replaces what it published before."""
    spark = messages.sparkSession
    ship_package(spark)
    spark.dataSource.register(TopicSink)
    (messages.select("topic", "value").write.format("coweave_topics").mode("append")
     .option("path", path).option("epoch", str(epoch)).save())


def write_topic_stream(messages: DataFrame, path: str, checkpoint: str):
    """S6 (stream): a streaming result (topic, value), one commit per batch for
    all topics; returns the stream writer, to be given a trigger and started."""
    spark = messages.sparkSession
    ship_package(spark)
    spark.dataSource.register(TopicSink)
    return (messages.select("topic", "value").writeStream.format("coweave_topics").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, value, epoch) of all published epochs."""
    ship_package(spark)
    spark.dataSource.register(TopicSink)
    return spark.read.format("coweave_topics").option("path", path).load()
