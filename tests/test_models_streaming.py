"""K-Means, and the streaming KPIs against the batch aggregation of the same events."""

import uuid

import pytest
from pyspark.sql import functions as F

from tillroll.operators import clusters, rfm
from tillroll.operators.clean import clean_transactions
from tillroll.session import names_in, scratch_path
from tillroll.sources.retail import load_retail
from tillroll.streaming import kpis


def test_kmeans_assigns_every_customer(spark):
    r = rfm.rfm_notebook(clean_transactions(load_retail(spark, "/root/testdata/sf0.001")))
    seg = clusters.kmeans_segments(r, k=4)
    assert seg.count() == r.count()
    assert seg.select("cluster").distinct().count() <= 4


def test_streaming_kpis_equal_batch(spark, sf_small):
    run = uuid.uuid4().hex
    out, ckpt = scratch_path(spark, "test_stream", run, "o"), scratch_path(spark, "test_stream",
                                                                           run, "c")
    stream = kpis.weekly_kpis(kpis.event_stream(spark, sf_small, "events.parquet"))
    kpis.run_to_table(stream, out, ckpt).awaitTermination()
    got = kpis.read_latest(spark, out).toPandas()
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    want = ev.groupBy(F.date_trunc("week", "ts").alias("window_start"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users")).toPandas()
    m = got.merge(want, on=["window_start", "event_type"])
    assert len(m) == len(want) == len(got)
    assert (m["events_x"] == m["events_y"]).all()
    # approximate distinct users stay within HyperLogLog++'s default error
    assert ((m["approx_users"] - m["users"]).abs() <= 0.1 * m["users"] + 2).all()


def test_late_events_and_folders_are_read_whole(spark, tmp_path):
    """Three files, the newest first and one a trigger; the table is a folder."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    total = events.count()
    ranked = events.repartitionByRange(3, F.col("ts").desc()).sortWithinPartitions("ts")
    ranked.write.parquet(str(tmp_path / "events.parquet"))
    run = uuid.uuid4().hex
    out, ckpt = scratch_path(spark, "test_stream", run, "o"), scratch_path(spark, "test_stream", run, "c")
    assert kpis.read_latest(spark, out).count() == 0
    stream = kpis.weekly_kpis(kpis.event_stream(spark, str(tmp_path), "events.parquet", 1))
    kpis.run_to_table(stream, out, ckpt).awaitTermination()
    assert kpis.read_latest(spark, out).agg(F.sum("events")).first()[0] == total


def folder_names(spark, path):
    return [n for n in names_in(spark, path) if not n.startswith(("_SUCCESS", "."))]


def test_exact_users_with_late_files_and_a_restart(spark, tmp_path):
    """Files in any order, one a trigger, in two runs of the same queries."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    parts = events.repartitionByRange(4, F.col("ts").desc())
    src, run = tmp_path / "in", uuid.uuid4().hex
    out, ckpt = scratch_path(spark, "test_users", run, "o"), scratch_path(spark, "test_users", run, "c")
    parts.where(F.spark_partition_id() < 2).write.parquet(str(src))

    def run_all():
        stream = kpis.event_stream(spark, str(src), "*.parquet", 1)
        running = [kpis.run_to_table(kpis.weekly_kpis(stream, approx_users=False), out, f"{ckpt}/k"),
                   kpis.run_users_to_table(kpis.weekly_users(stream), out, f"{ckpt}/u")]
        for q in running:
            q.awaitTermination()

    run_all()
    parts.where(F.spark_partition_id() >= 2).write.mode("append").parquet(str(src))
    parts.where(F.spark_partition_id() == 1).write.mode("append").parquet(str(src))  # the same events again
    run_all()
    got = kpis.read_latest(spark, out).select("window_start", "event_type", "users").collect()
    want = events.groupBy(F.date_trunc("week", "ts").alias("window_start"), "event_type").agg(
        F.countDistinct("user_id").alias("users")).collect()
    assert {(str(r[0]), r[1], r[2]) for r in got} == {(str(r[0]), r[1], r[2]) for r in want}
    for kind in ("kpis", "users"):
        assert len([n for n in folder_names(spark, f"{out}/{kind}") if n.startswith("v=")]) <= 2


def test_snapshots_are_bounded_and_survive_a_crash(spark, monkeypatch):
    folder = scratch_path(spark, "test_snap", uuid.uuid4().hex)

    def batch(i):
        return spark.createDataFrame([("w%d" % (i % 3), "t", 10 * i), ("w9", "t", i)],
                                     "window_start string, event_type string, events long")

    for i in range(12):
        kpis.commit_batch(batch(i), i, folder, "q", kpis.latest_rows)
    assert len([n for n in folder_names(spark, folder) if n.startswith("v=")]) == 2
    assert len(folder_names(spark, f"{folder}/{kpis.MARKS}")) == 2

    def rows():
        return {r.window_start: r.events for r in kpis.snapshot(spark, folder).collect()}

    assert rows() == {"w0": 90, "w1": 100, "w2": 110, "w9": 11}
    # A crash after the version is written and before its marker.
    with monkeypatch.context() as m:
        m.setattr(kpis, "touch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kpis.commit_batch(batch(12), 12, folder, "q", kpis.latest_rows)
    assert rows() == {"w0": 90, "w1": 100, "w2": 110, "w9": 11}
    kpis.commit_batch(batch(12), 12, folder, "q", kpis.latest_rows)
    assert rows() == {"w0": 120, "w1": 100, "w2": 110, "w9": 12}
    kpis.commit_batch(batch(40), 12, folder, "q", kpis.latest_rows)  # the same batch again
    assert rows() == {"w0": 120, "w1": 100, "w2": 110, "w9": 12}
    kpis.commit_batch(batch(0), 0, folder, "other", kpis.latest_rows)  # a new query begins anew
    assert rows() == {"w0": 0, "w9": 0}
    users = scratch_path(spark, "test_snap", uuid.uuid4().hex)
    for i in range(3):
        kpis.commit_batch(batch(i), i, users, "q", kpis.added_users)
    assert {r.window_start: r.users for r in kpis.snapshot(spark, users).collect()} == {"w0": 1, "w1": 1, "w2": 1, "w9": 3}
