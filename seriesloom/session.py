"""Session settings and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SEGMENTS_CONF = "spark.seriesloom.segments"


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew join).

    `master` and `shuffle_partitions` stay unset on a cluster, where the submit command and AQE own them.
    """
    builder = (
        SparkSession.builder.appName("seriesloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def segments(spark: SparkSession) -> int:
    """How many range segments an ordered operator splits a table into (a power of two).

    No window group then holds more than about 1/segments of all rows, whatever the key skew is.
    """
    wanted = int(spark.conf.get(SEGMENTS_CONF, "0") or 0)
    if wanted <= 0:
        wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    power = 1
    while power < wanted:
        power *= 2
    return max(power, 2)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    A local session without it gets a temporary folder; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, which survives the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stored(df: DataFrame) -> DataFrame:
    """Like `checkpointed`, for state that is rewritten round after round: a checkpoint keeps the constraints that Spark has
    derived for its rows, and these multiply with every round; a table that is written and read again has none.
    """
    path = f"{shared_folder(df.sparkSession)}/state-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
