"""Shared folders, stored tables and skew-safe lookups of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import shuffles_removed

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Where the setting is absent, a local session gets a folder of its own, removed at exit; on a cluster that would lose
    files with their executor, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = folder = tempfile.mkdtemp(prefix="spark-llm-")
        atexit.register(shutil.rmtree, folder, True)
    return _own[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, gives Catalyst true sizes."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def whole(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value` computed once per row: a lambda binds it, so no rewrite can copy the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The input row as one struct beside computed columns, so that no input name can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, shares: int | None = None) -> DataFrame:
    """Inner join of `rows` with their group's row on `key`, safe when one group owns a third of all rows.

    `groups` has the number of rows of each key in `size`. Keys above 1/shares of all rows number fewer than `shares`, a
    bound that no data can exceed, so just those are broadcast; the rest meet in a sort-merge join whose keys are all
    small. Both inputs should be stored, as each is read twice.
    """
    spark = rows.sparkSession
    shares = shares or 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(total // shares, 1)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit).hint("merge")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return rows.join(hot, key).unionByName(rest)
