"""Exact dedup against a persistent index of text digests, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import attach, fresh_path, packed, stored, whole


class DigestIndex:
    """Digests of all texts ever kept, in parquet buckets sorted by digest at `path`.

    The folder is the persistent state: another session opens it with the same path and number of buckets. A batch is
    reduced to one row per digest before anything moves, then anti-joined with the index by sort-merge; the index side
    is read in its buckets, without a shuffle. What the anti-join leaves is appended, one file a bucket, under the name of
    its batch. A batch that is run again appends nothing and finds its own digests under its own name, so that they count
    as fresh again: a job that failed before, during or after the append can simply be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path, id_type
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.table = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table, path=self.path))

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Append the digests of `groups` (digest, keep_id, keep_row, group_size) that are new; return them all with
        the id that stands in the index. keep_row stays where this batch brought the digest and is null elsewhere."""
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._append(stored(new.select("digest", "keep_id", F.lit(batch).alias("batch")), "new-digests"))
        old = self.read().select("digest", F.col("keep_id").alias("index_id"), F.col("batch") == batch)
        both = groups.join(old.toDF("digest", "index_id", "fresh").hint("merge"), "digest")
        return both.select("digest", F.col("index_id").alias("keep_id"), F.when(F.col("fresh"), F.col("keep_row")).alias("keep_row"), "group_size")

    def compacted(self, path: str) -> DigestIndex:
        """The same index at another path with one file a bucket, however many batches it had."""
        other = DigestIndex(self.spark, path, self.buckets, self.id_type)
        other._append(self.read())
        return other


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when identical; null is the empty text. Of equal texts in a batch the row with the largest id stays
    (a null id is smaller than any other; of rows that repeat an id, one); a text that the index already holds stays
    with its earlier id and all rows of the batch go. group_size counts rows of the batch. Empty tables give no rows.
    `batch` names the batch in the index; by default it is a hash of all its digests, ids and counts, so that a rerun of the
    same rows has the same name and the same result.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, fresh_path(spark, "digest-index"), id_type=docs.schema[doc_id].dataType.simpleString())
    digests = stored(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(whole(text), 256)).alias("digest"),
                                 F.monotonically_increasing_id().alias("row")), "digests")
    top = F.max(F.struct("doc_id", "row"))
    groups = stored(digests.groupBy("digest").agg(top.alias("top"), F.count("*").alias("group_size"))
                    .select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"),
                    "digest-groups")
    if batch is None:
        seen = groups.agg(F.count("*"), F.sum("group_size"), F.bit_xor(F.xxhash64("digest", "keep_id", "group_size")), F.bit_xor(F.xxhash64("group_size", "keep_id", "digest"))).first()
        batch = hashlib.sha256(repr(tuple(seen)).encode()).hexdigest()[:32]
    placed = stored(index.add(groups, batch), "digest-places")
    return attach(digests, placed, "digest", "group_size").select(
        "doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns. Rows that repeat both id and text become one."""
    kept = exact_dedup(docs, index, doc_id, text).where("kept").select(F.col("doc_id").alias("kept_id"), "digest")
    rows = packed(docs, F.col(doc_id).alias("own_id"), F.unhex(F.sha2(whole(text), 256)).alias("digest"))
    same = rows["own_id"].eqNullSafe(kept["kept_id"]) & (rows["digest"] == kept["digest"])
    return rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["own_id", "digest"]).select("row.*")
