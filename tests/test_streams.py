"""State that ends, and inserts that read only the buckets they meet."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from forklore.streaming import ingest, threads

SCHEMA = "thread_id long, actor_id long, event_pos long, event string, at timestamp"
START = dt.datetime(2020, 1, 1)


def drain(spark, tmp_path, operator, batches):
    """What each batch adds, and the rows of state after it."""
    source, out, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    known, added, sizes = set(), [], []
    for batch in batches:
        spark.createDataFrame(
            [(t, a, p, e, START + dt.timedelta(hours=h)) for t, a, p, e, h in batch], SCHEMA
        ).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        progress = ingest.append_new(operator(stream), out, marks)
        found = {tuple(r) for r in spark.read.parquet(out).collect()}
        added.append(found - known)
        known = found
        sizes.append(progress["stateOperators"][0]["numRowsTotal"])
    return added, sizes


def test_known_users_are_forgotten_when_quiet(spark, tmp_path):
    ref, say = "cross-referenced", "commented"
    batches = [
        [(1, 7, 1, say, 0), (1, 8, 2, ref, 0), (1, 7, 3, ref, 1), (2, 7, 4, ref, 1)],
        [(1, 8, 5, ref, 2), (2, 9, 7, ref, 3), (2, 9, 6, say, 3)],
        [(1, 7, 8, ref, 90), (1, 8, 9, ref, 4), (3, 1, 10, say, 200)],
    ]
    quiet = dt.timedelta(hours=24)
    added, sizes = drain(spark, tmp_path, lambda s: threads.known_users(s, quiet, "at", "100 hours"), batches)
    assert added == [{(1, 7, 3)}, {(1, 8, 5), (2, 9, 7)}, {(1, 8, 9)}]
    kept, _ = drain(spark, tmp_path / "kept", threads.known_users, batches)
    assert kept == [{(1, 7, 3)}, {(1, 8, 5), (2, 9, 7)}, {(1, 8, 9), (1, 7, 8)}]
    # at hour 200, less 100 for late events, only thread 3 and user 7 (until hour 114) are kept
    assert sizes[-1] < sizes[0]


def test_last_event_is_kept_from_batch_to_batch(spark, tmp_path):
    batches = [
        [(1, 7, 1, "merged", 0), (2, 7, 2, "merged", 0), (2, 7, 3, "commented", 0), (3, 1, 4, "merged", 0)],
        [(1, 8, 6, "closed", 1), (2, 8, 7, "closed", 1)],
        [(1, 9, 9, "closed", 300), (1, 9, 8, "merged", 300), (3, 1, 10, "closed", 300)],
    ]
    quiet = dt.timedelta(hours=24)
    added, sizes = drain(spark, tmp_path, lambda s: threads.closes_after_merge(s, quiet, "at"), batches)
    assert added == [set(), {(1, 8, 6)}, {(1, 9, 9)}]
    assert sizes[-1] <= sizes[0]
    kept, _ = drain(spark, tmp_path / "kept", threads.closes_after_merge, batches)
    assert kept[2] == {(1, 9, 9), (3, 1, 10)}


def test_keys_expire_within_the_watermark(spark, tmp_path):
    """A copy within the delay is dropped, one long after is a new row, one too late is dropped with the watermark."""
    batches = [
        [(1, 1, 1, "a", 0), (1, 1, 2, "a", 0)],
        [(1, 1, 3, "a", 1), (2, 2, 4, "b", 30)],
        [(1, 1, 5, "a", 60), (9, 9, 6, "late", 1)],
    ]
    operator = lambda s: ingest.first_within(s, ["thread_id"], "at", "2 hours").select("thread_id", "at")
    added, sizes = drain(spark, tmp_path, operator, batches)
    hour = lambda h: START + dt.timedelta(hours=h)
    assert added == [{(1, hour(0))}, {(2, hour(30))}, {(1, hour(60))}]
    assert sizes[-1] == 1


def test_inserts_read_only_the_buckets_of_their_keys(spark, tmp_path, monkeypatch):
    """Eight batches of equal size over ever more keys: what a batch reads does not grow with the table."""
    import glob
    import os

    schema = "k long, v string"
    out, marks, source = (f"{tmp_path}/{n}" for n in ("out", "marks", "in"))
    buckets = 1000
    where = spark.range(40_000).select("id", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("b")).collect()
    by_bucket = {}
    for row in where:
        by_bucket.setdefault(row.b, []).append(row.id)
    read = []
    real = ingest.KeyTable.read

    def watched(table, met):
        read.append(sum(os.path.getsize(f) for b in met for f in glob.glob(f"{table.path}/bucket={b}/*/*.parquet")))
        return real(table, met)

    monkeypatch.setattr(ingest.KeyTable, "read", watched)
    want = set()
    for turn in range(8):
        # one bucket of its own for each batch, and some keys of the first one again and again
        keys = by_bucket[10 + turn][:30] + by_bucket[10][turn : turn + 5]
        want |= set(keys)
        spark.createDataFrame([(k, f"{turn}") for k in keys], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.insert_new(stream, out, marks, ["k"], buckets=buckets, fold=3)
    got = [r.k for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want)
    assert max(read[2:]) <= 4 * max(read[1], 1)
    # a new checkpoint, and then a table whose keys are lost, still know every row
    ingest.insert_new(spark.readStream.schema(schema).parquet(source), out, f"{marks}2", ["k"], buckets=buckets)
    os.rename(f"{out}-keys", f"{out}-lost")
    ingest.insert_new(spark.readStream.schema(schema).parquet(source), out, f"{marks}3", ["k"], buckets=buckets)
    assert spark.read.parquet(out).count() == len(want)
