"""Incremental and streaming operators (T1 - T5), drained over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from forklore import schemas
from forklore.catalog.registry import query
from forklore.catalog.sources import TIMELINE_COLUMNS, TIMELINE_SQL, timeline_export
from forklore.catalog.views import Tables
from forklore.session import new_path
from forklore.sources import exports
from forklore.streaming import ingest, threads


@query("t01_incremental_timeline_ingest", TIMELINE_SQL)
def t01(t: Tables):
    source, archive, out, marks = timeline_export(t), *[
        new_path(t.spark, name) for name in ("archive", "ingested", "marks")
    ]

    def turn() -> None:
        stream = ingest.csv_stream(t.spark, source, schemas.TIMELINE, archive)
        ingest.append_new(exports.timeline(stream).select(*TIMELINE_COLUMNS), out, marks)

    # The second turn finds nothing new and adds nothing.
    ingest.refresh([turn, turn])
    return t.spark.read.parquet(out)


def _event_files(t: Tables) -> str:
    """The event table as parquet files of consecutive positions, for a file stream."""
    path = new_path(t.spark, "events")
    t.timeline.select("thread_id", "actor_id", "event_pos", "event").repartitionByRange(
        4, "event_pos"
    ).write.parquet(path)
    return path


def _event_stream(t: Tables, path: str):
    schema = t.timeline.select("thread_id", "actor_id", "event_pos", "event").schema
    return t.spark.readStream.schema(schema).parquet(path)


@query(
    "t02_resumed_insert",
    "SELECT DISTINCT thread_id, actor_id FROM timeline",
)
def t02(t: Tables):
    out, marks, source = [new_path(t.spark, n) for n in ("pairs", "marks", "slices")]
    pairs = t.timeline.select("thread_id", "actor_id", "event_pos")
    halves = [pairs.filter(F.col("event_pos") % 2 == i).drop("event_pos") for i in (0, 1)]
    for half in halves:
        half.write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(half.schema).parquet(source)
        ingest.insert_new(stream, out, marks, ["thread_id", "actor_id"])
    return t.spark.read.parquet(out).select("thread_id", "actor_id")


@query(
    "t03_deduplicated_stream",
    "SELECT DISTINCT thread_id, actor_id FROM timeline",
)
def t03(t: Tables):
    out, marks = [new_path(t.spark, n) for n in ("unique", "marks")]
    stream = _event_stream(t, _event_files(t)).select("thread_id", "actor_id")
    ingest.append_new(stream.dropDuplicates(["thread_id", "actor_id"]), out, marks)
    return t.spark.read.parquet(out)


@query(
    "t03_deduplicated_within_watermark",
    "SELECT event_id, user_id FROM events",
)
def t03b(t: Tables):
    out, marks, source = [new_path(t.spark, n) for n in ("unique", "marks", "feed")]
    events = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.unionByName(events).write.parquet(source)  # every event is delivered twice
    stream = t.spark.readStream.schema(events.schema).parquet(source)
    ingest.append_new(ingest.first_within(stream, ["event_id"], "ts", "1 hour"), out, marks)
    return t.spark.read.parquet(out).select("event_id", "user_id")


@query(
    "t04_known_users_stream",
    """SELECT t.thread_id, t.actor_id, t.event_pos FROM timeline t
    WHERE t.event='cross-referenced' AND EXISTS (
      SELECT 1 FROM timeline s WHERE s.thread_id=t.thread_id AND s.actor_id=t.actor_id
        AND s.event_pos<t.event_pos)""",
)
def t04(t: Tables):
    out, marks = [new_path(t.spark, n) for n in ("known", "marks")]
    ingest.append_new(threads.known_users(_event_stream(t, _event_files(t))), out, marks)
    return t.spark.read.parquet(out)


@query(
    "t04_closes_after_merge_stream",
    """SELECT thread_id, actor_id, event_pos FROM (
      SELECT *, lag(event) OVER (PARTITION BY thread_id ORDER BY event_pos) AS p FROM timeline)
    WHERE event='closed' AND p='merged'""",
)
def t04b(t: Tables):
    out, marks, source = [new_path(t.spark, n) for n in ("closes", "marks", "parts")]
    half = "(SELECT max(event_id)/2 FROM events)"
    for rule in (f"event_pos < {half}", f"event_pos >= {half}"):
        events = t.sql(
            f"SELECT thread_id, actor_id, event_pos, event FROM timeline WHERE {rule}"
        )
        events.write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(events.schema).parquet(source)
        ingest.append_new(threads.closes_after_merge(stream), out, marks)
    return t.spark.read.parquet(out)


@query(
    "t05_repeated_refresh",
    "SELECT thread_id, count(*) AS n_events FROM timeline GROUP BY 1",
)
def t05(t: Tables):
    out, marks, source = [new_path(t.spark, n) for n in ("seen", "marks", "arrivals")]
    events = t.timeline.select("thread_id", "event_pos")

    def turn() -> None:
        stream = t.spark.readStream.schema(events.schema).parquet(source)
        ingest.append_new(stream, out, marks)

    for half in (0, 1):
        events.filter(F.col("event_pos") % 2 == half).write.mode("append").parquet(source)
        ingest.refresh([turn])
    return t.spark.read.parquet(out).groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("n_events")
    )
