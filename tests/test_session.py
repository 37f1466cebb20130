"""Scratch folder comes from the session's checkpoint setting; derived tables
are built once per session and per source."""

import uuid

import pytest

from tillroll.session import scratch_dir, scratch_path
from tillroll.sources.tables import materialized


def test_scratch_dir_is_the_sessions_checkpoint_dir(spark):
    d = scratch_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir().rstrip("/")
    assert scratch_path(spark, "a", "b").endswith("/a/b")
    assert scratch_path(spark, "a", "b").startswith(f"{d}/tillroll/{spark.sparkContext.applicationId}/")


def test_materialized_builds_once(spark, sf_small):
    calls = []
    name = f"probe_{uuid.uuid4().hex}"

    def build():
        calls.append(1)
        return spark.range(5)

    a = materialized(spark, name, sf_small, build)
    b = materialized(spark, name, sf_small + "/", build)  # same source, normalised path
    assert a.count() == b.count() == 5
    assert len(calls) == 1


def test_no_local_scratch_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tillroll import session
    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_tables_are_built_again_when_source_or_parameters_change(spark, tmp_path):
    from tillroll.sources.tables import materialized
    src = str(tmp_path / "in")
    spark.range(3).write.parquet(src + "/t.parquet")

    def build():
        return spark.read.parquet(src + "/t.parquet")

    assert materialized(spark, "probe", src, build).count() == 3
    assert materialized(spark, "probe", src, lambda: spark.range(9)).count() == 3
    assert materialized(spark, "probe", src, lambda: spark.range(9), home="x").count() == 9
    spark.range(4).write.mode("append").parquet(src + "/t.parquet")
    assert materialized(spark, "probe", src, build).count() == 7


def test_recency_has_no_time_zone(spark):
    from pyspark.sql import functions as F

    from tillroll.functions.expressions import floor_days, instant_to_ntz, ntz_to_instant
    rows = [("2011-03-27 01:30:00", "2011-03-28 01:45:00", 1), ("2017-10-15 00:10:00", "2017-10-16 00:20:00", 1),
            ("2011-03-27 01:30:00", "2011-03-28 01:15:00", 0), ("2011-10-30 01:30:00", "2011-10-31 01:30:00", 1),
            ("2020-01-01 12:00:00", "2020-12-31 11:59:59", 364)]
    df = spark.createDataFrame(rows, "a string, b string, days int").select(
        F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"), "days")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/London", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            out = df.select((floor_days("a", "b") == F.col("days")).alias("ok"),
                            F.unix_micros(ntz_to_instant("a")).alias("at"),
                            (instant_to_ntz(ntz_to_instant("a")) == F.col("a")).alias("back")).collect()
            assert all(r.ok and r.back for r in out), zone
            assert out[0]["at"] == 1301189400 * 10**6
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
