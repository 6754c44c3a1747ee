"""Centroid clustering of whole-number vectors with Ptolemaic pivot bounds.

For pivots s, t and any points x, c of Euclidean space, Ptolemy's inequality gives
|x-c| * |s-t| >= | |x-s| * |c-t| - |x-t| * |c-s| |. Distances of all vectors to a few fixed pivots are computed once and stored
beside the vectors; a round then bounds every distance to a centroid from cached numbers. Only centroids whose bound does
not exceed the best exact distance so far are measured, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import fresh_path, stored
from seriesloom.llm.vectors import component_limit, dense, usable, whole_numbers

#: Sixteen units in the last place: more than the roundings of one bound add up to.
SLACK = 2.0**-48
LONGEST = 2**63 - 1


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances in whole numbers."""
    gap = points - centre
    return np.einsum("ij,ij->i", gap, gap)


class Pivots:
    """Fixed reference points and the pairs of them that stand apart."""

    def __init__(self, points: np.ndarray):
        self.points = points
        spans = {(s, t): float(np.sqrt(squares(points[s:s + 1], points[t])[0])) for s, t in combinations(range(len(points)), 2)}
        self.pairs = [(s, t, span) for (s, t), span in spans.items() if span > 0]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([squares(vectors, p) for p in self.points], 1).astype(float))

    def lower_squares(self, cached: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """A number not above the squared distance of each vector to each centre, whatever the roundings."""
        own = self.distances(centres)
        bound = np.zeros((len(cached), len(centres)))
        for s, t, span in self.pairs:
            left, right = cached[:, s, None] * own[None, :, t], cached[:, t, None] * own[None, :, s]
            np.maximum(bound, (np.abs(left - right) - SLACK * (left + right)) / span, out=bound)
        return bound * bound * (1 - SLACK)


def nearest(vectors: np.ndarray, cached: np.ndarray, centres: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centre (ties: the smaller number), its squared distance, and how many distances were measured."""
    low = pivots.lower_squares(cached, centres)
    near = low.argmin(1)
    best = squares(vectors, centres[near])
    measured = len(vectors)
    for c in range(len(centres)):
        rows = np.flatnonzero((low[:, c] <= best) & (near != c))
        measured += len(rows)
        d = squares(vectors[rows], centres[c])
        won = (d < best[rows]) | ((d == best[rows]) & (c < near[rows]))
        near[rows[won]], best[rows[won]] = c, d[won]
    return near, best, measured


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, each next one as far as can be from those before."""
    chosen = [0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(np.min([squares(points, points[c]) for c in chosen], 0).argmax()))
    return points[chosen]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return dense(batch.column("v")), dense_floats(batch.column("near"))


def dense_floats(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _with_distances(pivots: Pivots):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pivots.distances(dense(batch.column("v")))
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), near.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "near"])

    return work


def _sums(centres: np.ndarray, pivots: Pivots):
    """Per task one row a non-empty cluster: its number of vectors, their sum, and the distances measured."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, measured = np.zeros_like(centres), np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, cached = _columns(batch)
                near, _, work_done = nearest(vectors, cached, centres, pivots)
                np.add.at(total, near, vectors)
                count += np.bincount(near, minlength=len(centres))
                measured[near[0]] += work_done
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), pa.array(measured[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "measured", "total"])

    return work


def _assigned(centres: np.ndarray, pivots: Pivots):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, best, _ = nearest(*_columns(batch), centres, pivots)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return work


def next_centres(table: DataFrame, centres: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, int]:
    """One Lloyd round: componentwise floor of the mean; empty clusters stay. Also the number of distances measured.

    Sums are formed in the tasks and added up by Spark per (cluster, component): the driver gets k x dims numbers.
    """
    parts = table.mapInArrow(_sums(centres, pivots), "cluster int, n long, measured long, total array<long>")
    cells = parts.select("cluster", "n", "measured", F.posexplode("total").alias("place", "value"))
    sums = cells.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), F.sum("value").alias("value"))
    out, measured = centres.copy(), 0
    for row in sums.collect():
        out[row.cluster, row.place] = row.value // row.n
        measured += row.measured if row.place == 0 else 0
    return out, measured


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, salt: int = 3, n_pivots: int = 4,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, all distances squared.

    Kept are vectors with `dims` components, none null or not finite; their components become floor(scale * x), held within
    +-component_limit(dims) (2^27 for 64), beyond which distances would not fit a long. The first centroids are the k
    kept vectors with the smallest sha256 of "salt:vec_id" (null ids last; rows that repeat an id by their components);
    with fewer vectors there are fewer centroids. Repeated rows each count. Empty tables give no rows. Inertias stop at
    2^63 - 1.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType.simpleString()
    base = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("e")).where(usable("e") & (F.size("e") == dims))
    base = base.select("vec_id", whole_numbers("e", scale, component_limit(dims)).alias("v"))
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = base.orderBy(key.asc_nulls_last(), "vec_id", "v").limit(k).collect()
    out_type = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out_type)
    centres = np.array([row.v for row in first], np.int64)
    pivots = Pivots(_spread(centres, n_pivots))
    path = fresh_path(spark, "pivot-distances")
    schema = f"vec_id {id_type}, v array<int>, near array<double>"
    base.mapInArrow(_with_distances(pivots), schema).write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    for _ in range(rounds):
        centres, _ = next_centres(table, centres, pivots)
    placed = stored(table.mapInArrow(_assigned(centres, pivots), f"vec_id {id_type}, cluster int, distance long"), "assigned")

    def held(amount: int) -> int:
        return min(int(amount), LONGEST)

    inertia = {row.cluster: row.s for row in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = held(sum(inertia.values()))
    digests = [hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest() for centre in centres]
    facts = spark.createDataFrame([(c, held(s), total, digests[c]) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
