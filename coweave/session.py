"""Session construction and lineage cutting.

Library code never invents storage locations on a cluster: iterative
operators cut lineage by writing each round as a table into the directory
the cluster names in ``spark.checkpoint.dir``.  Only a local-mode session
without that setting (unit tests, laptops) gets a fresh scratch folder.
"""

from __future__ import annotations

import os
import pathlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "coweave", **extra: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    AQE stays on: it coalesces small shuffle partitions, turns a join into a
    broadcast only after the build side has been *measured* below the
    threshold, and splits skewed sort-merge-join partitions at run time.
    """
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, wiring it into the context.

    Order: a directory already set on the SparkContext, then the
    ``spark.checkpoint.dir`` setting of the session.  Only when neither
    exists *and* the master is local is a scratch folder created; a cluster
    session without the setting is an error, since a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a "
                "shared checkpoint directory on a cluster")
        configured = tempfile.mkdtemp(prefix="coweave-ckpt-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame, observe: list[Column] | None = None
                ) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` as a parquet table under ``spark.checkpoint.dir`` and
    return a DataFrame reading it back.

    Used by driver loops (PageRank, k-hop, snowball) so plans stay
    short and a lost executor recomputes from the last written round, never
    from round zero.  One job per call: the write.  ``observe`` aggregates
    (e.g. "how many vertices still send") are computed by that same job via
    ``DataFrame.observe`` and returned as a dict, so a loop's convergence
    test costs no extra pass.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/coweave-{uuid.uuid4().hex}"
    obs = None
    if observe:
        obs = Observation(f"o{uuid.uuid4().hex[:8]}")
        df = df.observe(obs, *observe)
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written_to = path
    if observe:
        return out, dict(obs.get)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by ``cut_lineage`` that a loop has superseded.
    Nothing may read ``df`` any more."""
    path = getattr(df, "_written_to", None)
    if path is not None:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession) -> str:
    """A fresh path under ``spark.checkpoint.dir`` for files that a query
    writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/coweave-{uuid.uuid4().hex}"


def written_files(path: str) -> Iterator[pq.ParquetFile]:
    """The files of a parquet table under such a path, in name order, for a task to
    read them by ``pyarrow.fs``; a path without a scheme is one of the shared file system."""
    files, root = fs.LocalFileSystem(), re.sub(r"^file:(?!//)", "", path)
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        files, root = fs.FileSystem.from_uri(path)
    for f in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.base_name):
        if f.base_name.endswith(".parquet"):
            with files.open_input_file(f.path) as source:
                yield pq.ParquetFile(source)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run: it
    is shipped once per session as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_coweave_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="coweave-"), package.name),
                                  "zip", root_dir=package.parent, base_dir=package.name)
    sc.addPyFile(archive)
    sc._coweave_shipped = True
