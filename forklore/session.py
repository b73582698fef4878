"""Session settings, and the shared folder where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}


def build_session(app: str = "forklore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    for the data (AQE coalesces what turns out to be too many).
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) is a local one made, once
    per session. On a cluster each executor would write to its own disk, so there it is an error.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors reach")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="forklore-")
        configured = _own_dirs[app]
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back, in folders by the values of ``by`` if given.

    Cuts the lineage of iterative operators. The files outlive lost executors, are
    pruned by column when read again, and give the optimizer true sizes.
    """
    path = new_path(df.sparkSession, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """:func:`materialize` for chains in which no later job reads what an earlier one shuffled.

    Shuffle files go as the job ends; what that leaves goes as the driver collects the garbage of its plans.
    """
    was = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")

    def write(df: DataFrame, label: str) -> DataFrame:
        spark._jvm.System.gc()
        table = materialize(df, label)
        spark._jvm.System.gc()
        return table

    try:
        yield write
    finally:
        if was is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, was)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` wrote; nothing may read them again."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        for name in {os.path.dirname(file) for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            if path.getParent().toUri().getPath() == top.toUri().getPath():
                path.getFileSystem(conf).delete(path, True)


def materialize_counted(df: DataFrame, label: str, counted: Column | None = None):
    """:func:`materialize`, and the number of rows (those that meet ``counted``).

    The count is observed while writing, so no second job is needed for it.
    """
    seen = Observation()
    what = F.count(F.lit(1)) if counted is None else F.count_if(counted)
    written = materialize(df.observe(seen, what.alias("n")), label)
    return written, seen.get["n"]
