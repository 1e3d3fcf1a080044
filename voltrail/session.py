"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Calendar fields (hour, weekday, month) must not depend on where the job runs.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "voltrail", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_calendar(spark: SparkSession) -> None:
    """Make date and hour fields independent of the driver's time zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Without that setting, local mode takes ``spark.voltrail.local.dir``, or makes a folder of its own as in unit
    tests; a cluster is refused, as is a ``file:`` folder on machines that do not share one (any master but local ones).
    Nothing in the folder is removed: expire what lies below ``voltrail/`` by age, or with the application's end.
    """
    context = spark.sparkContext
    local = context.master.startswith("local[") or context.master == "local"
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = context.getConf().get("spark.voltrail.local.dir", None) or tempfile.mkdtemp(prefix="voltrail-")
    elif named.startswith("file:") and not context.master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir is {named}, which other machines cannot see")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten or deleted."""
    return f"{shared_dir(spark).rstrip('/')}/voltrail/{label}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later passes prune its columns.

    What the write shuffled is removed at once, as the stored rows are what is read from now on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so that a lost executor costs a re-read and not a re-run."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
