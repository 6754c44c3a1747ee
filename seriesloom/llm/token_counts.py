"""Token counts by a two-tier lookup: a broadcast table of frequent pre-token lengths, then worker caches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import whole
from seriesloom.llm.pretokens import Cache, byte_pieces, library_tokenizer, piece_ids, special_splitter

#: Fixed value: the split pattern of the byte-level vocabulary, as Java reads it.
JAVA_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FREQUENT = 8192
TRACKED = 32768
CACHED = 300_000
LONGEST_FREQUENT = 64


def frequent_pieces(docs: DataFrame, text: str = "text", frequent: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """About the `frequent` most common pre-tokens of all texts.

    Every text is read, but no pre-token is shuffled: each task keeps one sketch of `tracked` items, sketches are merged
    in 64 groups and then once, and `frequent` items reach the driver. The table only saves work, so an approximate rank
    is enough. The last merge is grouped too, since an ungrouped one fails on a partition without a sketch.
    """
    pieces = docs.select(F.explode(F.regexp_extract_all(whole(text), F.lit(JAVA_PATTERN), F.lit(0))).alias("piece"))
    pieces = pieces.where(F.length("piece") <= LONGEST_FREQUENT)
    group = F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")
    top = (pieces.groupBy(group).agg(F.expr(f"approx_top_k_accumulate(piece, {tracked})").alias("sketch"))
           .groupBy(F.pmod("part", F.lit(1))).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
           .select(F.expr(f"approx_top_k_estimate(sketch, {frequent})").alias("top"))).first()
    return [x["item"] for x in (top["top"] or [])] if top else []


@lru_cache(maxsize=2)
def _misses(config: str) -> Cache:
    """Lengths of rarer pre-tokens met by this worker, `CACHED` of them at most."""
    ids = piece_ids(config)
    return Cache(lambda piece: len(ids(piece)), CACHED)


def token_counts(docs: DataFrame, config: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text, as the library's default settings count.

    Added strings inside a text are one token each. Null texts are empty and have 0 tokens; repeated rows are counted
    each; an empty table gives no rows. The broadcast table has at most 8,192 pieces of 64 letters or fewer, one
    megabyte whatever the input.
    """
    spark = docs.sparkSession
    ids = piece_ids(config)
    table = {p: len(ids(p)) for p in frequent_pieces(docs, text)}
    shared = spark.sparkContext.broadcast((config, table))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole(text)).cast("long").alias("n_bytes"), whole(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        config, table = shared.value
        split, library, misses = special_splitter(config), library_tokenizer(config), _misses(config)
        lookup = table.get
        for batch in batches:
            counts = []
            for value in batch.column("text").to_pylist():
                n = 0
                for part, token in split(value):
                    if token is not None:
                        n += 1
                        continue
                    for piece in byte_pieces(library, part):
                        n += lookup(piece) or misses[piece]
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    counted = base.mapInArrow(compute, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
