"""Session construction and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "traceframe", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    ``shuffle_partitions`` is only an upper start value: adaptive execution
    coalesces small exchanges and splits skewed ones.  On a cluster leave it
    unset and give ``spark.sql.shuffle.partitions`` by input size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a machine-local folder: on a cluster
    other executors could not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="traceframe-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an aggregated intermediate to shared scratch and read it back.

    Used where a small result of a large scan feeds several branches: column
    pruning would otherwise give every branch its own scan of the input.  The
    written table also survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled._settled_path = path
    return settled


def discard(*settled: DataFrame | None) -> None:
    """Delete tables of ``settle`` that nothing reads any more; what was derived from them must be settled itself."""
    for df in settled:
        path = getattr(df, "_settled_path", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def widen(scan: DataFrame) -> DataFrame:
    """Repartition a file scan only when it has fewer splits than the cluster has cores.

    Large inputs have many splits and stay untouched; a small file in one row
    group would otherwise keep row-local work on a single core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spread(df: DataFrame, work: int, *keys: str, per_task: int = 500_000) -> DataFrame:
    """Hash-partition a small table whose rows stand for ``work`` units of computation."""
    tasks = max(1, work // per_task)
    return df.repartition(tasks, *keys) if tasks > 1 else df
