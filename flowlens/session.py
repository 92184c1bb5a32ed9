"""Session helpers: a tuned local/cluster session and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "flowlens",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE, UTC time and Arrow on; the UI stays off.

    On a cluster the master and resources come from spark-submit; the
    explicit master is only for tests and the bench.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # k-row dictionaries are broadcast explicitly after a size check;
        # keep the automatic threshold modest so big sides never broadcast.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor (applies when this
        # call starts the JVM; a running session keeps its heap)
        conf["spark.driver.memory"] = "8g"
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def wide_table_mode(spark: SparkSession) -> Iterator[None]:
    """Turn off Catalyst constraint propagation for plans over wide tables.

    With dozens of aliased feature columns followed by a filter and a join,
    constraint inference grows exponentially and exhausts the driver heap;
    this optimizer-only switch leaves results unchanged.  The session's own
    setting comes back at the end.
    """
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is.  Only a local
    session without one (tests) gets a private folder; on a cluster a
    machine-local folder would not be visible to other executors, so an
    unset setting is an error there.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: flowlens stages tables in that "
                               "shared folder; set it to a path every executor can reach")
        base = tempfile.mkdtemp(prefix="flowlens-ckpt-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


_scratch_roots: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a staged table.

    An application stages into a folder of its own, which its driver removes
    when it ends (a killed driver leaves it behind)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    root = os.path.join(base, "flowlens", spark.sparkContext.applicationId)
    if root not in _scratch_roots:
        fs, place = file_system(spark, root)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        _scratch_roots.add(root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system of a path, path object): local, HDFS and object
    stores alike."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False, and nothing written, if the name is taken."""
    fs, p = file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Exception:  # the JVM's FileAlreadyExistsException, or a real failure
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True
