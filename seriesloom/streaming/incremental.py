"""Incremental loading and time-to-live on streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def load_new_files(spark: SparkSession, folder: str, schema: StructType, sink: str, checkpoint: str, fmt: str = "parquet",
                   glob: str | None = None, files_per_trigger: int = 1000) -> None:
    """Append the rows of files not seen before to `sink`, then stop.

    The checkpoint records finished files, so a lost run resumes where it stopped and a repeated run adds nothing.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    run = (reader.load(folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink)
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()


def newest_within(stream: DataFrame, keys: list[str], stamp: str, ttl: str) -> DataFrame:
    """First row per key inside the time to live of a stream, for sinks that only append; older state is dropped by the
    watermark. `newest_wins` follows later rows."""
    return stream.withWatermark(stamp, ttl).dropDuplicatesWithinWatermark(keys)


class _Newest(StatefulProcessor):
    """Holds the time of the newest row of a key until the watermark has passed it.

    A call of the state costs far more than a row, so a key has one timer at a time: it is set for the key's first row, and
    where newer rows have come until it fires, it is set again for the newest. Columns go by their place, as Spark hands rows
    over under other names where a column's name is no Python identifier; the time is the last one, in microseconds.
    """

    def __init__(self, columns: list[str]):
        self.named = Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("newest", "micros long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.best.get()
        best, row = timerValues.getCurrentWatermarkInMs() * 1000 - 1, None
        if held is not None:
            best = max(best, held[0])
        for r in rows:
            if r[-1] > best:
                best, row = r[-1], r
        if row is not None:
            self.best.update((best,))
            if held is None:
                self.handle.registerTimer(best // 1000 + 1)
            yield self.named(*row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ends = self.best.get()[0] // 1000 + 1
        if ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
        else:
            self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


MICROS = "__micros"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_wins(stream: DataFrame, keys: list[str], stamp: str, ttl: str) -> DataFrame:
    """Newest row per key inside the time to live of a stream (update mode): a key's row comes out each time a newer one
    arrives, so the last one written for a key is its newest.

    The state holds one time per key in the RocksDB store, beyond the memory of the executors, and an event-time timer drops
    it when the watermark, `ttl` behind the newest time seen, has passed it. Rows behind the watermark and rows without a time
    are ignored; of equal times the first seen stays. NULL keys are one key.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = stream.where(F.col(stamp).isNotNull()).withColumn(MICROS, F.unix_micros(F.col(stamp).cast("timestamp")))
    newest = timed.withWatermark(stamp, ttl).groupBy(*keys).transformWithState(_Newest(timed.columns), timed.schema, "update", "EventTime")
    return newest.drop(MICROS)


def newest_table(newest: DataFrame, keys: list[str], stamp: str, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream of `newest_wins` until its source is read, and returns the newest row per key.

    Every micro-batch overwrites its own folder of `path`, so a batch that is repeated after a failure adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = newest.sparkSession.read.schema(newest.schema.add("batch", "long")).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*newest.columns), F.struct(stamp, "batch")).alias("r"))
    return last.select("r.*")


def windowed_counts(stream: DataFrame, stamp: str, width: str, step: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sliding event counts on a stream in append mode, late rows accepted up to the watermark."""
    return (stream.withWatermark(stamp, late).groupBy(F.window(stamp, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select("window.start", "window.end", *keys, "n"))
