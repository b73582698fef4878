"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

What is known of all lines seen so far lies in runs: tables with one row per line key,
bucketed and sorted by hash. A batch of documents is merged against the runs (both sides are
sorted by hash and dealt to the same buckets, so no run is shuffled again); keys that
no run has are fresh and belong to the batch's last document. The batch is then added
as a run of level 0. When a level has ``fanout`` runs, they are compacted into one run of the
next level, so a row is rewritten once per level and a batch meets few runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forklore.llm.common import BLANKS, lower_ascii, shuffle_partitions
from forklore.session import materialize, new_path

HASH = ["h1", "h2"]
RUN = "h1 long, h2 long, docs long, fresh boolean, keeper long"


class LineRuns:
    """The levelled runs: ``h1, h2, docs`` (documents with the key), ``keeper`` (null unless fresh)."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.paths: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge a batch (``h1, h2, docs, last``; one row per key) and return its run.

        ``keeper`` is set in the rows that match no earlier run.
        """
        marked = keys
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            seen = run.select(*HASH, F.lit(True).alias(f"in{i}"))
            marked = marked.join(seen, HASH, "left")
            known = known | F.col(f"in{i}").isNotNull()
        keeper = F.when(~known, F.col("last")).alias("keeper")
        return self._store(marked.select(*HASH, "docs", (~known).alias("fresh"), keeper), 0)

    def merged(self) -> DataFrame:
        """One row per key over all runs."""
        # read as plain files: a union of bucketed tables would count as dealt by their buckets
        every = self.spark.read.schema(RUN).parquet(*[p for level in self.paths for p in level])
        return every.groupBy(*HASH).agg(
            F.sum("docs").alias("docs"), F.max("fresh").alias("fresh"), F.max("keeper").alias("keeper")
        )

    def _store(self, rows: DataFrame, level: int) -> DataFrame:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        (
            rows.repartition(self.buckets, *HASH)
            .sortWithinPartitions(*HASH)
            .write.bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", path)
            .saveAsTable(name)
        )
        run = self.spark.table(name)
        while len(self.levels) <= level:
            self.levels.append([])
            self.paths.append([])
        self.levels[level].append(run)
        self.paths[level].append(path)
        if len(self.levels[level]) == self.fanout:
            part = LineRuns(self.spark, self.fanout, self.buckets)
            part.paths = [self.paths[level]]
            self.levels[level], self.paths[level] = [], []
            self._store(part.merged(), level + 1)
        return run


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of the lines whose key has ``min_chars`` code points or more.

    ``docs``: ``doc_id, text, text_hash``. A key is the line without blanks at its ends, A-Z lower-cased.
    """
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """Document ids that cut the documents into even batches, descending."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    return sorted(set(found or []), reverse=True)


def dedup_lines(
    docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """Drop the lines that ``min_docs`` documents or more hold, except in the largest doc_id.

    Returns ``row`` (the input row with all its columns), ``text`` (kept lines joined by line
    feed), ``n_lines`` and ``n_dropped``. Only keys of ``min_chars`` code points or more count.
    Documents go through the runs in batches of descending doc_id, so the first batch that holds a
    key holds its largest doc_id.

    A null or empty text is one empty line. Rows that share a doc_id are one document
    when keys are counted; each row is returned. A null doc_id is one document that
    comes before all others. Repeated rows give repeated rows. An empty table gives an empty result.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    lines = materialize(line_keys(slim, min_chars), "lines")
    held = F.coalesce("doc_id", F.lit(-(2**63)))
    runs = LineRuns(docs.sparkSession, fanout)
    above = None
    for edge in [*_batch_edges(slim, batches), None]:
        batch = lines
        if above is not None:
            batch = batch.where(held <= above)
        if edge is not None:
            batch = batch.where(held > edge)
        keys = batch.select(*HASH, held.alias("doc")).distinct().groupBy(*HASH)
        runs.add(keys.agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last")))
        above = edge
    # written, so that both sides of the join are plain shuffles and a line of very many documents is split
    common = materialize(runs.merged().where(F.col("docs") >= min_docs).select(*HASH, "keeper"), "common")
    gone = (
        lines.join(common, HASH)
        .where(held != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    text = F.coalesce("row.text", F.lit(""))
    full = docs.select(F.struct("*").alias("row"))
    full = full.withColumn("_id", F.col("row.doc_id").cast("long")).withColumn("_hash", F.xxhash64(text))
    met = full.join(
        gone, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left"
    ).select("row", F.split(text, "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    return met.select(
        "row",
        F.when(F.size("gone") == 0, text).otherwise(rest).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )


def without_common_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept text in place of ``text``, and ``n_chars``, if there, counted anew where lines went.

    Rows that lose no line stay as they are, nulls included.
    """
    kept = dedup_lines(docs, **options)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return kept.select(*[
        F.when(changed, new[f.name].cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`")).alias(f.name)
        if f.name in new
        else F.col(f"row.`{f.name}`").alias(f.name)
        for f in docs.schema.fields
    ])
