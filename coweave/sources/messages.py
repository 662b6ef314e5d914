"""Message streams and result files.

The reference talks to a message broker; the same contract is kept with a
``fmt`` parameter: ``kafka`` (needs the connector on the classpath) or a
directory of JSON-lines text files, which is what the tests use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, discard


def read_tick_stream(spark: SparkSession, fmt: str = "text", path: str | list[str] | None = None,
                     topic: str | list[str] | None = None, servers: str | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame with ``value STRING`` and ``arrival``, a
    struct that sorts messages in the order they came (file blocks, for files).

    kafka: subscribe to ``topic`` from the latest offset (offsets live in the
    query checkpoint, not in the broker: auto-commit off, W9).  text: every
    new file of ``path``, optionally a few files per trigger (W10).  Several
    topics or paths are read as one stream (X4).
    """
    if fmt == "kafka":
        r = (spark.readStream.format("kafka")
             .option("kafka.bootstrap.servers", servers)
             .option("subscribe", topic if isinstance(topic, str) else ",".join(topic or []))
             .option("startingOffsets", "latest")
             .load())
        return r.select(F.col("value").cast("string").alias("value"),
                        F.struct("timestamp", "topic", "partition", "offset").alias("arrival"))
    out = None
    for one in [path] if isinstance(path, str) else path or []:
        r = spark.readStream.format("text")
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = r.load(one).select("value", F.struct(
            "_metadata.file_modification_time", "_metadata.file_path",
            "_metadata.file_block_start").alias("arrival"))
        out = lines if out is None else out.unionByName(lines)
    if out is None:
        raise ValueError("a path or a topic is needed")
    return out


def to_messages(df: DataFrame, topic: str | None = None) -> DataFrame:
    """Every row → ``value`` JSON text (+ ``topic`` when given)."""
    cols = [F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")]
    if topic is not None:
        cols.append(F.lit(topic).alias("topic"))
    return df.select(*cols)


def write_messages(df: DataFrame, fmt: str = "text", path: str | None = None,
                   topic: str | None = None, servers: str | None = None,
                   mode: str = "append") -> None:
    """S6/S7 (batch): rows → JSON records on a topic or into a directory."""
    msgs = to_messages(df)
    if fmt == "kafka":
        (msgs.write.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("topic", topic).save())
        return
    msgs.write.mode(mode).text(path)


def replay_as_messages(df: DataFrame, path: str, batch_col: str = "batch_no") -> None:
    """S7 + W10: write each replay batch as a directory of JSON lines, one
    batch after the other, so that a file stream, which reads by file time,
    feeds them in the order of their numbers.

    The rows are encoded once; a batch is then one parallel write of its own
    rows.  The driver only sees the list of batch numbers (one per period).
    """
    cols = [c for c in df.columns if c != batch_col]
    encoded = cut_lineage(df.select(F.col(batch_col), F.to_json(F.struct(*cols)).alias("value")))
    batches = sorted(r[0] for r in encoded.select(batch_col).distinct().collect())
    for batch in batches:
        encoded.where(F.col(batch_col) == F.lit(batch)).select("value") \
               .write.mode("overwrite").text(f"{path.rstrip('/')}/{batch_col}={batch}")
    discard(encoded)


def write_metric(df: DataFrame, metric: str, path: str) -> None:
    """Save one result set under its metric name (tall table, one
    ``metric=`` partition each, replaced on rewrite)."""
    (df.withColumn("metric", F.lit(metric)).write
       .option("partitionOverwriteMode", "dynamic")
       .mode("overwrite").partitionBy("metric").parquet(path))


def export_pairs_json(ranked: DataFrame, label: str, value: str,
                      rank_col: str = "rank") -> DataFrame:
    """A ranked (bounded, top-n) result → one row with the text
    ``[["label",value],...]`` in rank order; labels are JSON-escaped."""
    quoted = F.regexp_extract(F.to_json(F.array(F.col(label).cast("string"))), r"^\[(.*)\]$", 1)
    pair = F.concat(F.lit("["), quoted, F.lit(","), F.col(value).cast("string"), F.lit("]"))
    return ranked.agg(F.concat(F.lit("["), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank_col), pair.alias("p")))),
                    lambda x: x["p"]), ","), F.lit("]")).alias("text"))


def read_result_json(spark: SparkSession, path: str) -> DataFrame:
    """Saved ``[[label, value], ...]`` or ``[label, ...]`` files →
    (file, pos INT, name STRING, value DOUBLE).  Result files are top-n
    lists, so each is read as one value."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value"))
    pairs = F.from_json("value", "array<array<string>>")
    labels = F.from_json("value", "array<string>")
    as_pairs = raw.where(pairs.isNotNull() & F.col("value").startswith("[[")).select(
        "file", F.posexplode(pairs).alias("pos", "p")).select(
        "file", (F.col("pos") + 1).cast("int").alias("pos"),
        F.col("p")[0].alias("name"), F.col("p")[1].try_cast("double").alias("value"))
    as_labels = raw.where(~F.col("value").startswith("[[")).select(
        "file", F.posexplode(labels).alias("pos", "name")).select(
        "file", (F.col("pos") + 1).cast("int").alias("pos"), "name",
        F.lit(None).cast("double").alias("value"))
    return as_pairs.unionByName(as_labels)


def write_message_stream(stream: DataFrame, checkpoint: str, fmt: str = "text",
                         path: str | None = None, topic: str | None = None,
                         servers: str | None = None, trigger_available_now: bool = False):
    """S6 (stream): every row of a streaming result → JSON record on a topic
    (``kafka``) or in a directory (``text``); progress in ``checkpoint``."""
    w = to_messages(stream).writeStream.option("checkpointLocation", checkpoint)
    if fmt == "kafka":
        w = (w.format("kafka").option("kafka.bootstrap.servers", servers)
             .option("topic", topic))
    else:
        w = w.format("text").option("path", path)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
