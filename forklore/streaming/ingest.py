"""Incremental ingest: read what is new, append results once, set processed files aside.

Each call drains what has arrived (``availableNow``) and stops; the checkpoint knows
which files were read, so calling it again from a scheduler is the refresh loop.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from forklore.operators.joins import absent
from forklore.sources.sinks import least_per_key

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def csv_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    archive: str | None = None,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """A stream of export files; read files are moved below ``archive`` if one is named."""
    reader = spark.readStream.schema(schema).options(
        multiLine="true", quote='"', escape='"', header="true", comment="#",
        maxFilesPerTrigger=str(files_per_batch), recursiveFileLookup="true",
    )
    if archive:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)
    return reader.csv(path).withColumn("path", F.url_decode(F.col("_metadata.file_path")))


def first_within(stream: DataFrame, keys: Sequence[str], moment: str, delay: str) -> DataFrame:
    """One row per key, of copies that arrive within ``delay`` of each other.

    The state holds the keys of the last ``delay`` only. Use it for feeds that deliver a row again soon; a key that may come back at
    any time needs :func:`insert_new`.
    """
    return stream.withWatermark(moment, delay).dropDuplicatesWithinWatermark(list(keys))


def append_new(stream: DataFrame, out: str, checkpoint: str) -> dict | None:
    """Append the rows of new files to parquet; the file sink's log makes it exactly once.

    State, if the stream has any, lies in RocksDB. Returns the progress of the last batch, None if there was none.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(STATE_STORE, before)
    run(query)
    return query.lastProgress


class KeyTable:
    """The keys of a table, in buckets by hash: ``bucket=b/part=p`` below ``path``.

    A batch reads the buckets of its own keys and adds a part to each. A bucket of more than ``fold`` parts is merged
    into one. A key that stands in two parts, as after a merge that was cut off, does no harm.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64, fold: int = 8):
        self.spark, self.path, self.buckets, self.fold = spark, path, buckets, fold
        self.keys = schema.names
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("part", T.StringType())])
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return self.files.exists(self.hadoop(self.path))

    def parts(self, bucket: int) -> list[str]:
        at = self.hadoop(f"{self.path}/bucket={bucket}")
        if not self.files.exists(at):
            return []
        return [status.getPath().toString() for status in self.files.listStatus(at)]

    def read(self, buckets: Sequence[int]) -> DataFrame:
        """Keys of some buckets, each with its ``part``; nothing else is listed or read."""
        found = [f"{self.path}/bucket={b}" for b in buckets if self.parts(b)]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*found)

    def add(self, rows: DataFrame, part: str) -> None:
        """Add the keys of ``rows`` as ``part``, in place of what an attempt that failed left of it."""
        keys = rows.select(*self.keys, self.bucket().alias("bucket"), F.lit(part).alias("part"))
        keys.write.partitionBy("bucket", "part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)

    def merge(self, buckets: Sequence[int], part: str) -> None:
        """Merge buckets of many parts; the old parts go only when the new one stands."""
        old = {b: self.parts(b) for b in buckets}
        old = {b: parts for b, parts in old.items() if len(parts) > self.fold}
        if old:
            self.add(self.read(list(old)).select(*self.keys).distinct(), part)
            for path in (path for parts in old.values() for path in parts):
                self.files.delete(self.hadoop(path), True)


def insert_new(
    stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str], buckets: int = 64, fold: int = 8
) -> None:
    """Insert rows whose key the table lacks, each once, however often a batch is repeated.

    Every batch writes its own folder, named by the query's id (kept in the checkpoint) and the batch, overwriting what
    a failed attempt left there. Known keys lie beside the table (``<out>-keys``) in ``buckets`` by hash
    (:class:`KeyTable`): a batch meets the buckets of its own keys, not the table. A new checkpoint on an existing
    table neither repeats nor replaces a row; a table without keys beside it is read once to make them.
    """
    schema = T.StructType([stream.schema[k] for k in keys])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = spark.read.text(f"{checkpoint}/metadata").first()[0]
        own = f"{json.loads(kept)['id']}-{batch_id}"
        known = KeyTable(spark, f"{out}-keys", schema, buckets, fold)
        if not known.exists() and known.files.exists(known.hadoop(out)):
            known.add(spark.read.parquet(out).select(*keys).distinct(), "before")
        rows = least_per_key(batch, keys)
        met = [r[0] for r in batch.select(known.bucket()).distinct().collect()]  # numbers below ``buckets``
        rows = absent(rows, known.read(met).filter(F.col("part") != own), keys)
        folder = f"{out}/run={own.rpartition('-')[0]}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        known.add(spark.read.schema(stream.schema).parquet(folder), own)
        known.merge(met, f"merged-{own}")

    run(
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh(jobs: Sequence[Callable[[], None]]) -> None:
    """One scheduled turn over all ingests."""
    for job in jobs:
        job()


def run(query: StreamingQuery) -> None:
    query.awaitTermination()
