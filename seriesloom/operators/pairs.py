"""Moments of all pairs of series by blocks of series, without a row per pair and slot."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.split import join_keys

#: Series in a block on average.
BLOCK_SERIES = 256
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def pair_moments(df: DataFrame, slot: Sequence[str], key: str, value: str, chunks: int | None = None) -> DataFrame:
    """key_a < key_b, n, sxx, syy and sxy over the slots that both series have; one row per (slot, key).

    Series are dealt into blocks of about `BLOCK_SERIES` and slots into chunks by hash. A value goes once to every block that
    its own meets, and a block pair of one chunk is a few matrix products; what is shuffled after that is one row per pair and
    chunk. Chunks default to the shuffle partitions; a task holds the values of two blocks in one chunk. NULL and NaN values
    are missing. Sums are taken from the least value of a series; a sum of squares below 1e-12 of its terms counts as 0.
    """
    spark, slot = df.sparkSession, list(slot)
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    x = F.col(value).cast("double")
    rows = df.select(*slot, F.col(key).alias("__key"), x.alias("__v")).where(F.col("__key").isNotNull() & F.col("__v").isNotNull() & ~F.isnan("__v"))
    low = rows.groupBy("__key").agg(F.min("__v").alias("__low"))
    blocks = low.agg(F.ceil(F.count(F.lit(1)) / BLOCK_SERIES).cast("int")).first()[0] or 1
    at = join_keys(rows, low, ["__key"]).select(
        F.xxhash64(*slot).alias("slot_hash"), F.struct(*slot).alias("slot"), F.col("__key").alias("key"), (F.col("__v") - F.col("__low")).alias("v"),
        F.pmod(F.xxhash64("__key"), F.lit(blocks)).cast("int").alias("own"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    at = at.select(F.pmod("slot_hash", F.lit(chunks)).alias("chunk"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                   "own", F.to_json("slot").alias("slot"), "key", "v")
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key_a", kind), T.StructField("key_b", kind), *[T.StructField(c, T.DoubleType()) for c in SUMS]])
    sums = at.groupBy("chunk", "a", "b").applyInPandas(_block_sums, schema)
    total = sums.groupBy("key_a", "key_b").agg(*[F.sum(c).alias(c) for c in SUMS])
    n = F.col("n")

    def centred(square: str, p: str, q: str, terms):
        s = F.col(square) - F.col(p) * F.col(q) / n
        return F.when(F.abs(s) <= 1e-12 * terms, 0.0).otherwise(s)

    return total.select("key_a", "key_b", n.cast("bigint").alias("n"), centred("xx", "x", "x", F.col("xx")).alias("sxx"),
                        centred("yy", "y", "y", F.col("yy")).alias("syy"), (F.col("xy") - F.col("x") * F.col("y") / n).alias("sxy"))


def _block_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of every pair of series with one in each of two blocks, or both in the one block."""
    slots = pd.factorize(pdf["slot"])[0]
    sides = []
    for block in (pdf["a"].iloc[0], pdf["b"].iloc[0]):
        mine = (pdf["own"] == block).to_numpy()
        place, keys = pd.factorize(pdf["key"][mine])
        x, held = np.zeros((slots.max() + 1, len(keys))), np.zeros((slots.max() + 1, len(keys)))
        x[slots[mine], place], held[slots[mine], place] = pdf["v"].to_numpy()[mine], 1.0
        sides.append((np.asarray(keys), x, held))
    (ka, xa, ha), (kb, xb, hb) = sides
    sums = [ha.T @ hb, xa.T @ hb, ha.T @ xb, (xa * xa).T @ hb, ha.T @ (xb * xb), xa.T @ xb]
    i, j = np.nonzero(sums[0])
    if pdf["a"].iloc[0] == pdf["b"].iloc[0]:
        i, j = i[ka[i] < kb[j]], j[ka[i] < kb[j]]
    first = ka[i] < kb[j]
    n, x, y, xx, yy, xy = (s[i, j] for s in sums)
    return pd.DataFrame({"key_a": np.where(first, ka[i], kb[j]), "key_b": np.where(first, kb[j], ka[i]), "n": n, "x": np.where(first, x, y),
                         "y": np.where(first, y, x), "xx": np.where(first, xx, yy), "yy": np.where(first, yy, xx), "xy": xy})
