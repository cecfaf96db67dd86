"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods above this size; wide projections then run in smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streamed session windows are merged in each task before their shuffle, so a busy client cannot overload one task.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

#: Settings that can only be given when a session is started.
LAUNCH_SETTINGS = {
    # Capturing the call site of every column costs more than planning does for jobs with many columns.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cinderlog")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **LAUNCH_SETTINGS}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a session in one machine (tests) may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"cinderlog-{label}-") + "/data"


def through_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and stops the parsing work being repeated by every later scan. A lost executor
    costs nothing: the rows are in the shared file system, and later scans prune columns.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def through_tables(spark: SparkSession, jobs: list[Callable[[], DataFrame]], label: str) -> DataFrame:
    """Run independent jobs side by side, each writing its rows, and read all of them as one table.

    The jobs give the same columns. Side by side they fill a cluster that one of them would leave idle.
    """
    root = scratch_dir(spark, label)

    def run(numbered: tuple[int, Callable[[], DataFrame]]) -> tuple[str, object]:
        number, job = numbered
        df, path = job(), f"{root}/part={number}"
        df.write.parquet(path)
        return path, df.schema

    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(run), enumerate(jobs)))
    schema = done[0][1]
    return spark.read.schema(schema).parquet(*[path for path, _ in done])

