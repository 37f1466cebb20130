"""Structured Streaming KPIs over the event stream (STR1, the claimed
"real-time KPIs").

File source → Monday-aligned weekly tumbling windows per event type → update-mode
micro-batches.  A second query de-duplicates (week, type, user) in keyed state; the new
ones, counted in each micro-batch, add up to exact distinct users.

Each query keeps its result as a snapshot: a micro-batch is merged with the snapshot so
far, written as the next version and made current by one empty marker file, which either
exists or does not.  A batch that runs again after a failure finds its marker and does
nothing, or finds none and writes the same version again.  Versions before the last two
are deleted, so that folders and reads are bounded by the keys, not by the batches.

There is no watermark: its only use would be to drop state, and with it events
that arrive late.  The state has a row for each calendar week, event type and user.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.expressions import instant_to_ntz, ntz_to_instant
from tillroll.session import is_directory, names_in, remove, touch
from tillroll.sources.schema import EVENTS_SCHEMA

# Epoch (1970-01-01) was a Thursday: a 4-day offset starts windows on Monday.
WEEK = "7 days"
MONDAY_OFFSET = "4 days"
KEYS = ("window_start", "event_type")
#: Folder of the markers: number of the version, batch id and query id.
MARKS = "_current"
KPI_SCHEMA = ("window_start timestamp_ntz, window_end timestamp_ntz, event_type string, "
              "events bigint, total_value decimal(28,2), purchases bigint")


def event_stream(spark: SparkSession, source_dir: str, file_glob: str = "events*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of event parquet files with the declared schema.  ``file_glob``
    picks files of the folder; where it names a folder inside (a table written
    by Spark), that folder's files are the stream."""
    inner = f"{source_dir}/{file_glob}"
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if "*" not in file_glob and is_directory(spark, inner):
        return reader.parquet(inner)
    return reader.option("pathGlobFilter", file_glob).parquet(source_dir)


def weekly_kpis(events: DataFrame, approx_users: bool = True) -> DataFrame:
    """Per Monday-start week and event type: events, exact value total (cents),
    purchases and (approximate — exact distinct is not supported in streaming
    aggregation) distinct users."""
    aggs = [F.count(F.lit(1)).alias("events"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value"),
            F.count(F.when(F.col("event_type") == "purchase", 1)).alias("purchases")]
    if approx_users:
        aggs.append(F.approx_count_distinct("user_id").alias("approx_users"))
    timed = events.withColumn("event_time", ntz_to_instant("ts"))
    return (timed.groupBy(F.window("event_time", WEEK, WEEK, MONDAY_OFFSET).alias("w"), "event_type")
            .agg(*aggs)
            .select(instant_to_ntz("w.start").alias("window_start"),
                    instant_to_ntz("w.end").alias("window_end"),
                    "event_type", *[a for a in ("events", "total_value", "purchases",
                                                "approx_users")
                                    if a != "approx_users" or approx_users]))


def weekly_users(events: DataFrame) -> DataFrame:
    """The first event of each (week, type, user), once over the whole stream."""
    timed = events.where("user_id is not null").withColumn("event_time", ntz_to_instant("ts"))
    week = F.window("event_time", WEEK, WEEK, MONDAY_OFFSET)
    return timed.select(instant_to_ntz(week["start"]).alias("window_start"), "event_type", "user_id").dropDuplicates(
        ["window_start", "event_type", "user_id"])


def current_version(spark: SparkSession, folder: str) -> tuple[int, int, str] | None:
    """(number, batch id, query id) of the current snapshot: the last marker."""
    marks = [m.split(".") for m in names_in(spark, f"{folder}/{MARKS}") if not m.startswith((".", "_"))]
    return max(((int(n), int(b), q) for n, b, q in marks), default=None)


def snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    current = current_version(spark, folder)
    return spark.read.parquet(f"{folder}/v={current[0]}") if current else None


def commit_batch(batch: DataFrame, batch_id: int, folder: str, query_id: str, merge) -> None:
    """Make ``merge(batch, snapshot so far)`` the current snapshot.  A batch of the same query
    that is in the snapshot already changes nothing; another query begins anew."""
    spark = batch.sparkSession
    current = current_version(spark, folder)
    same = current is not None and current[2] == query_id
    if same and current[1] >= batch_id:
        return
    number = current[0] + 1 if current else 0
    merged = merge(batch, snapshot(spark, folder) if same else None)
    merged.write.mode("overwrite").parquet(f"{folder}/v={number}")
    touch(spark, f"{folder}/{MARKS}/{number}.{batch_id}.{query_id}")
    # The version before stays for those who are reading it.
    for m in names_in(spark, f"{folder}/{MARKS}"):
        if not m.startswith((".", "_")) and int(m.split(".")[0]) < number - 1:
            remove(spark, f"{folder}/{MARKS}/{m}")
    for v in names_in(spark, folder):
        if v.startswith("v=") and int(v[2:]) < number - 1:
            remove(spark, f"{folder}/{v}")


def latest_rows(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Rows of the batch, and those before that it does not replace."""
    if before is None:
        return batch
    return batch.unionByName(before.join(batch.select(*KEYS), [*KEYS], "left_anti"))


def added_users(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Users so far: new ones are counted and added."""
    new = batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("users"))
    if before is None:
        return new
    return before.unionByName(new).groupBy(*KEYS).agg(F.sum("users").alias("users"))


def _start(stream: DataFrame, mode: str, folder: str, checkpoint_dir: str, merge, available_now: bool,
           processing_time: str | None):
    known: list[str] = []

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if not known:  # the checkpoint names the query
            known.append(json.loads(batch.sparkSession.read.text(f"{checkpoint_dir}/metadata").first()[0])["id"])
        batch.persist()
        commit_batch(batch, batch_id, folder, known[0], merge)
        batch.unpersist()

    writer = (stream.writeStream.outputMode(mode).foreachBatch(upsert)
              .option("checkpointLocation", checkpoint_dir))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def run_to_table(kpis: DataFrame, out_dir: str, checkpoint_dir: str,
                 available_now: bool = True, processing_time: str | None = None):
    """Start the stream of ``weekly_kpis``: its current rows by key."""
    return _start(kpis, "update", f"{out_dir}/kpis", checkpoint_dir, latest_rows, available_now, processing_time)


def run_users_to_table(users: DataFrame, out_dir: str, checkpoint_dir: str,
                       available_now: bool = True, processing_time: str | None = None):
    """Start the stream of ``weekly_users``: distinct users by key."""
    return _start(users, "append", f"{out_dir}/users", checkpoint_dir, added_users, available_now, processing_time)


def read_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current state of the KPI table: a row per week and event type (none before the first
    batch), with the distinct ``users`` so far if their query has run."""
    kpis = snapshot(spark, f"{out_dir}/kpis")
    if kpis is None:
        return spark.createDataFrame([], KPI_SCHEMA)
    users = snapshot(spark, f"{out_dir}/users")
    return kpis if users is None else kpis.join(users, [*KEYS], "left").withColumn("users", F.coalesce("users", F.lit(0)))
