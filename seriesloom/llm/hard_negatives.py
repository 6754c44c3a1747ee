"""Hard negatives by slot-decomposed selection.

The upper limits of an anchor's positives cut the score axis into disjoint slots. Every combiner keeps the first k rows of a
slot, combiners are merged slot by slot, and the window of a positive is answered by the slots from its own downwards: the
first k rows under its upper limit are all among them.

Anchors are the query set. They meet all rows in blocks: (chunk of anchors) x (part of rows) is one stretch of a sorted
partition, anchors ahead of rows, so that a task holds one chunk and one batch. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import attach, stored
from seriesloom.llm.vectors import component_limit, dense, longest, usable, whole_numbers

#: Anchors of a chunk and rows of a part. They set memory and traffic, never the result.
CHUNK, PART = 8192, 8192
FOUND = "anchor long, slot int, score long, vec_id long, row long"


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact in floating point as components keep every sum below 2^52."""
    dims = min(left.shape[1], right.shape[1])
    return (left[:, :dims].astype(float) @ right[:, :dims].astype(float).T).astype(np.int64)


class SlotCombiner:
    """The first k rows of every (anchor, slot). Rows have to arrive in ascending order of their tie (vec_id, row).

    `limits` has an anchor's upper limits in descending order, then the least score that any of its windows takes.
    """

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, limits: np.ndarray, k: int, same: bool):
        self.rows, self.labels, self.vectors, self.k, self.same = rows, labels, vectors, k, same
        limits, self.least = limits[:, :-1], limits[:, -1:]
        self.limits = limits
        self.floor = np.full(limits.shape, np.iinfo(np.int64).min)
        self.full = np.zeros(limits.shape, bool)
        self.held = np.zeros((0, 5), np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        step, start = 256, 0
        while start < len(rows):
            cut = slice(start, start + step)
            found = [self._admitted(slice(a, a + 512), rows[cut], ids[cut], labels[cut], vectors[cut]) for a in range(0, len(self.rows), 512)]
            if found:
                self._merge(np.concatenate(found))
            start, step = start + step, min(2 * step, 4096)

    def _admitted(self, part: slice, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        score = products(self.vectors[part], vectors)
        limits, floor, full = self.limits[part], self.floor[part], self.full[part]
        slot = np.zeros(score.shape, np.int8)
        for j in range(1, limits.shape[1]):
            slot += score <= limits[:, j, None]
        fits = (score <= limits[:, :1]) & (score >= self.least[part]) & ((self.labels[part, None] == labels) == self.same) & (self.rows[part, None] != rows)
        # rows come in tie order: an equal score behind k others is never among the first k
        fits &= np.where(np.take_along_axis(full, slot, 1), score > np.take_along_axis(floor, slot, 1), True)
        a, r = np.nonzero(fits)
        return np.stack([a + part.start, slot[a, r].astype(np.int64), score[a, r], ids[r], rows[r]], 1)

    def _merge(self, found: np.ndarray) -> None:
        if not len(found):
            return
        rows = np.concatenate([self.held, found])
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
        group = rows[:, 0] * self.limits.shape[1] + rows[:, 1]
        first = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        self.held = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.full[last[:, 0], last[:, 1]] = True
        self.floor[last[:, 0], last[:, 1]] = last[:, 2]

    def result(self) -> pa.RecordBatch:
        h = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.rows[h[:, 0]]), pa.array(h[:, 1], pa.int32()), *(pa.array(h[:, c]) for c in (2, 3, 4))],
                                          ["anchor", "slot", "score", "vec_id", "row"])


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal (block, chunk, part, kind)."""
    cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "chunk", "part", "kind")]
    turns = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in cols])) + 1
    for start, end in zip(np.r_[0, turns], np.r_[turns, batch.num_rows]):
        yield tuple(int(c[start]) for c in cols), batch.slice(start, end - start)


def _limits(batch: pa.RecordBatch) -> np.ndarray:
    return dense(batch.column("limits"))


def _combine(k: int, same: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, combiner = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for (*group, kind), rows in _stretches(batch):
                if group != at:
                    if combiner is not None:
                        yield combiner.result()
                    at, anchors, combiner = group, [], None
                if kind == 0:
                    anchors.append(rows)
                    continue
                if not anchors:
                    continue
                numbers = lambda x, name: x.column(name).to_numpy(zero_copy_only=False)
                if combiner is None:
                    whole = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
                    combiner = SlotCombiner(numbers(whole, "row"), numbers(whole, "label"), dense(whole.column("v")), _limits(whole), k, same)
                combiner.add(numbers(rows, "row"), numbers(rows, "vec_id"), numbers(rows, "label"), dense(rows.column("v")))
        if combiner is not None:
            yield combiner.result()

    return work


def _meet(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """First k rows of every (anchor, slot). Both inputs carry block, n_chunks and n_parts; anchors also `limits`, descending."""
    def number(n: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))

    left = anchors.select("block", number("n_chunks").alias("chunk"), every("n_parts").alias("part"), F.lit(0).alias("kind"),
                          "row", "vec_id", "label", "v", "limits")
    right = rows.select("block", every("n_chunks").alias("chunk"), number("n_parts").alias("part"), F.lit(1).alias("kind"),
                        "row", "vec_id", "label", "v", F.array().cast("array<long>").alias("limits"))
    dealt = left.unionByName(right).repartition("block", "chunk", "part").sortWithinPartitions("block", "chunk", "part", "kind", "vec_id", "row")
    found = dealt.mapInArrow(_combine(k, same), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Components become
    floor(scale * x), held within +-component_limit (2^23 for 64 components), so that scores are exact. Scores are inner products; a shorter vector
    counts as ended by zeros. Higher scores come first, ties by smaller id. Anchors are the rows where `anchor` holds (default: ids
    divisible by 100); their positives the first `n_positives` other rows of the same label. A positive's negatives are
    the first `n_negatives` rows of other labels with low% of its score <= score <= high% of it. Rows that repeat an id are
    rows of their own. Anchors without positives, positives without negatives and empty tables give no rows.
    """
    base = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("e"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("e"))
    limit = component_limit(longest(base, "e"), 54)
    rows = stored(base.select("vec_id", "label", F.monotonically_increasing_id().alias("row"), whole_numbers("e", scale, limit).alias("v")), "vectors")
    anchors = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor)

    def parts(n: Column, size: int) -> Column:
        return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")

    by_label = anchors.groupBy("label").agg(F.count("*").alias("m")).join(rows.groupBy("label").agg(F.count("*").alias("n")), "label")
    by_label = stored(by_label.select("label", "n", parts(F.col("m"), chunk).alias("n_chunks"), parts(F.col("n"), part).alias("n_parts")), "label-sizes")
    every = F.array(F.lit(2**63 - 1), F.lit(-(2**63)))
    same = attach(rows, by_label, "label", "n").withColumn("block", F.col("label"))
    own = attach(anchors, by_label, "label", "n").select(F.col("label").alias("block"), "*", every.alias("limits"))
    positives = _meet(same, own, n_positives, True).select("anchor", F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"),
                                                           F.col("score").alias("positive_score"))

    def floor_percent(amount: Column) -> Column:
        return ((amount - F.pmod(amount, F.lit(100))) / 100).cast("long")

    score = F.col("positive_score")
    wanted = stored(positives.select("*", floor_percent(score * high).alias("upper"), (-floor_percent(-score * low)).alias("lower")), "windows")
    limits = wanted.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("some"), F.min("lower").alias("least"))
    # every anchor gets as many slots: unused ones repeat the last limit and stay empty
    padded = F.slice(F.concat("some", F.array_repeat(F.element_at("some", -1), n_positives)), 1, n_positives)
    padded = F.concat(padded, F.array("least"))
    sizes = [max(1, -(-x // y)) for x, y in ((anchors.count(), chunk), (rows.count(), part))]
    whole = {"block": F.lit(0).cast("long"), "n_chunks": F.lit(sizes[0]), "n_parts": F.lit(sizes[1])}
    ready = anchors.join(limits, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "v", padded.alias("limits")).withColumns(whole)
    found = stored(_meet(rows.withColumns(whole), ready, n_negatives, False), "slots")
    # at most n_positives * n_negatives rows an anchor, best first: from a positive's limit downwards these are its suffix of slots
    ranked = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "row"))).alias("best"))
    fits = F.filter("best", lambda c: (-c["minus"] <= F.col("upper")) & (-c["minus"] >= F.col("lower")))
    windows = wanted.join(ranked, "anchor").select("anchor", "positive_id", "positive_row", "positive_score",
                                                   F.posexplode(F.slice(fits, 1, n_negatives)).alias("place", "c"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return windows.join(names, "anchor").select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("c.vec_id").alias("negative_id"),
                                                "positive_score", (-F.col("c.minus")).alias("negative_score"))
