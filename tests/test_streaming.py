"""Stateful streams over files that arrive one after another."""

from datetime import datetime

import pytest

from seriesloom.streaming.incremental import MICROS, _Newest, newest_table, newest_wins

SCHEMA = "k string, at timestamp, `_v` int"


def day(d, h=0):
    return datetime(2024, 1, d, h)


def written(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


BATCHES = [
    [("a", day(10), 1), ("a", day(10, 5), 2), ("b", day(10), 3), ("c", None, 9), (None, day(10), 10)],
    [("a", day(10, 3), 4), ("b", day(11), 5), ("a", day(10, 5), 11), (None, day(10, 1), 12)],  # older, newer, equal, NULL key
    [("a", day(1), 6), ("d", day(1), 7), ("b", day(10), 8)],  # behind the watermark, or older
    [("b", day(20), 13)],  # the watermark passes every other key
    [("a", day(12), 14), ("d", day(19), 15)],  # late for the stream though newer than what expired; in time
    [("a", day(19, 1), 16), ("b", day(19), 17)],  # an expired key comes back; a held one stays newer
]
SEEN = [(None, 10), (None, 12), ("a", 2), ("a", 16), ("b", 3), ("b", 5), ("b", 13), ("d", 15)]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_newest_row_wins_and_old_rows_are_ignored(spark, tmp_path, zone):
    seen, before = [], spark.conf.get("spark.sql.session.timeZone")

    def take(df, _):
        seen.extend(tuple(r) for r in df.select("k", "_v").collect())

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        run = newest_wins(written(spark, tmp_path, BATCHES), ["k"], "at", "2 days").writeStream.outputMode("update").foreachBatch(take)
        run.option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(seen, key=lambda r: (r[0] or "", r[1])) == SEEN


def test_table_of_the_newest_rows_survives_a_second_run(spark, tmp_path):
    stream = newest_wins(written(spark, tmp_path, BATCHES), ["k"], "at", "2 days")
    for _ in range(2):  # the second run finds nothing new
        table = newest_table(stream, ["k"], "at", str(tmp_path / "out"), str(tmp_path / "marks"))
        assert {(r.k, r["_v"]) for r in table.collect()} == {(None, 12), ("a", 16), ("b", 13), ("d", 15)}


def test_newer_rows_of_a_held_key_leave_its_timer():
    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, new):
            calls.append("update")
            self.held = new

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        def getValueState(self, *_):
            return value

        def registerTimer(self, at):
            calls.append(("timer", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    calls, value = [], Value()
    newest = _Newest(["k", MICROS])
    newest.init(Handle())
    assert [tuple(r) for r in newest.handleInputRows(("a",), iter([("a", 5_000), ("a", 7_000), ("a", 6_000)]), Times(0))] == [("a", 7_000)]
    assert calls == ["get", "update", ("timer", 8)]
    calls.clear()
    assert [tuple(r) for r in newest.handleInputRows(("a",), iter([("a", 7_000), ("a", 20_000)]), Times(0))] == [("a", 20_000)]
    assert calls == ["get", "update"]
    calls.clear()
    list(newest.handleExpiredTimer(("a",), Times(9), None))
    assert calls == ["get", ("timer", 21)]
    calls.clear()
    list(newest.handleExpiredTimer(("a",), Times(21), None))
    assert calls == ["get", "clear"]
