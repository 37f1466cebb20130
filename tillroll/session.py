"""Session construction and the shared scratch folder.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names
(a shared file system); without it nothing runs there, because executors would
write to their own disks.  Only a local master (one machine: runs on a laptop,
tests) gets a folder under the system temp folder instead.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tillroll") -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or max(8, 2 * cpus)
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Reads ``spark.checkpoint.dir`` (or a checkpoint folder set already) from the
    session.  Unset, a local master gets a temp folder; any other master raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError(
                f"master {sc.master} needs spark.checkpoint.dir: a folder that the driver and all "
                "executors share")
        configured = _LOCAL_SCRATCH.setdefault(
            sc.applicationId, tempfile.mkdtemp(prefix="tillroll-scratch-"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A sub-path of this application's part of the scratch folder (a fresh one
    when no parts are given)."""
    return "/".join([_own_scratch(spark), *(parts or (uuid.uuid4().hex,))])


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tillroll/{spark.sparkContext.applicationId}"


def durable_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder with its lineage cut, so that a
    lost executor costs no recomputation."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in the scratch folder, at ``path`` below it if given.  A checkpoint keeps the planner's estimate of
    its size, which a join takes as the product of its sides; a loop of joins needs tables,
    whose size is that of their files: products grow without end in the driver."""
    path = path or scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path): any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where there is no folder."""
    fs, p = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file; it is there or it is not, on any store."""
    fs, p = _path(spark, path)
    fs.create(p, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of a result that its writer has replaced."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def folder_version(spark: SparkSession, path: str) -> str:
    """Changes when a file in the folder, or in a folder in it, is written."""
    fs, p = _path(spark, path)
    seen = []
    for f in fs.listStatus(p):
        inner = fs.listStatus(f.getPath()) if f.isDirectory() else [f]
        seen += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in inner]
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch folder; call it when its
    DataFrames are no longer read."""
    delete_path(spark, _own_scratch(spark))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this application's scratch."""
    if not path.startswith(_own_scratch(spark)):
        raise ValueError(f"{path} is not below this application's scratch folder")
    fs, p = _path(spark, path)
    fs.delete(p, True)


MiB = 1 << 20


def recommended_conf(input_bytes: int, executors: int, cores_per_executor: int,
                     partition_bytes: int = 256 * MiB,
                     shuffle_fraction: float = 0.25) -> dict[str, str]:
    """Cluster settings sized from the input volume.

    * file splits of ``partition_bytes`` (scan tasks that fit in memory);
    * initial shuffle partitions for the expected shuffle volume (lines are
      partially aggregated before the first exchange, so ``shuffle_fraction``
      of the input), never fewer than twice the cores — AQE then coalesces
      small partitions to ``partition_bytes`` and splits skewed join
      partitions;
    * ``parallelismFirst=false`` so coalescing targets the advisory size
      rather than keeping every core busy with tiny tasks.
    """
    cores = max(1, executors * cores_per_executor)
    shuffle_parts = max(2 * cores, -(-int(input_bytes * shuffle_fraction) // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.session.timeZone": "UTC",
    }
