"""Token ids in canonical Huffman blocks: global counts, independent blocks, bit-offset checkpoints."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import fresh_path, stored, whole
from seriesloom.llm.pretokens import Cache, byte_pieces, library_tokenizer, piece_ids, special_splitter

LONGEST_CODE = 20
BLOCK_IDS = 1 << 16
STEP = 256
CACHED = 500_000
#: Bytes of text encoded at one time.
SPAN = 1 << 23


# ---- ids -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _cache(config: str, width: str) -> Cache:
    """The ids of a pre-token, as bytes."""
    ids, kind = piece_ids(config), {"<u2": "H", "<u4": "I"}[width]

    def entry(piece: str) -> bytes:
        found = ids(piece)
        return struct.pack(f"<{len(found)}{kind}", *found)

    return Cache(entry, CACHED)


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most SPAN bytes, a longer row alone."""
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > SPAN:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def encoded(texts: pa.Array, config: str, width: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, `end_id` behind each, and how many each text has.

    A byte-level vocabulary cuts a text before a space that has no white space on either side, whatever stands further
    off. So texts are cut there by column and each different part is encoded once. Texts with other white space beside a
    space, and those with added strings, are encoded whole.
    """
    entry, split, library = _cache(config, width).__getitem__, special_splitter(config), library_tokenizer(config)

    def alone(text: str) -> bytes:
        return b"".join(np.array([token], width).tobytes() if token is not None else b"".join(map(entry, byte_pieces(library, part))) for part, token in split(text))

    values, n = texts.to_pylist(), len(texts)
    cut = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(cut).to_numpy()
    first = np.cumsum(counts) - counts
    coded = cut.flatten().dictionary_encode()
    part, parts = coded.indices.to_numpy(), coded.dictionary
    words = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), " ")[0].as_py().split(" ")
    odd = np.array([not w or len(w.strip()) < len(w) for w in words])
    whole_text = np.logical_or.reduceat(odd[part], first) | np.array([next(split(v)) != (v, None) for v in values])
    # A part has no space of its own, so that it begins with its only pre-token with a space.
    pieces = byte_pieces(library, "".join(f" {w}" for w, o in zip(words, odd.tolist()) if not o))
    found = list(map(entry, pieces))
    lengths = np.zeros(len(words), np.int64)
    if pieces:
        lengths[~odd] = np.add.reduceat(np.fromiter(map(len, found), np.int64, len(found)), np.flatnonzero([p[0] == " " for p in pieces]))
    end, nothing, heads = len(words), len(words) + 1, len(words) + 2
    others = [np.array([end_id], width).tobytes(), b""]
    others += [alone(v) if w else b"".join(map(entry, byte_pieces(library, v.partition(" ")[0]))) for v, w in zip(values, whole_text.tolist())]
    # The parts of each text in order, its first part as an entry of its own as no space is ahead of it, then the end id.
    row = np.repeat(np.arange(n), counts)
    order = np.full(len(part) + n, end)
    order[np.arange(len(part)) + row] = np.where(whole_text[row], nothing, part)
    order[first + np.arange(n)] = heads + np.arange(n)
    sizes = np.append(lengths, list(map(len, others))) // int(width[-1])
    starts, size = np.cumsum(sizes) - sizes, sizes[order]
    stops = np.cumsum(size)
    ids = np.frombuffer(b"".join(found + others), width)[np.repeat(starts[order] - stops + size, size) + np.arange(stops[-1])]
    return ids, np.add.reduceat(size, first + np.arange(n))


def encode_ids(docs: DataFrame, config: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", tally: bool = False) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned, two bytes while the vocabulary permits) with `end_id` appended.

    With `tally` every task adds a last row with n = -1: the ids it wrote, and in `times` how often, as 64-bit numbers. It is a
    row of the task's own output, so it is written or lost with the ids that it counts.
    """
    width = "<u2" if library_tokenizer(config).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(config)
    base = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, id_type = np.zeros(0, np.int64), None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            texts = batch.column("text")
            for start, stop in _spans(pc.binary_length(texts).to_numpy()):
                ids, counts = encoded(texts.slice(start, stop - start), shared.value, width, end_id)
                if tally:
                    more = np.bincount(ids, minlength=len(total))
                    more[: len(total)] += total
                    total = more
                data, ends = ids.tobytes(), np.cumsum(counts) * ids.itemsize
                out = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), pa.array(counts, pa.int64()), pa.array(out, pa.binary()),
                                                  pa.nulls(len(out), pa.binary())], names=["doc_id", "n", "ids", "times"])
        seen = np.flatnonzero(total)
        if len(seen):
            last = [pa.nulls(1, id_type), pa.array([-1], pa.int64()), pa.array([seen.astype(width).tobytes()], pa.binary()), pa.array([total[seen].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(last, names=["doc_id", "n", "ids", "times"])

    rows = base.mapInArrow(compute, f"doc_id {kind}, n bigint, ids binary, times binary")
    return rows if tally else rows.drop("times")


def id_counts(encoded: DataFrame, width: str) -> dict[int, int]:
    """How often each id occurs in all documents: the tasks' tallies summed by id; one row an id reaches the driver."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, times in zip(batch.column("ids").to_pylist(), batch.column("times").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, width).astype(np.int64)), pa.array(np.frombuffer(times, np.int64))], names=["id", "n"])

    rows = encoded.where("n = -1").select("ids", "times").mapInArrow(unfold, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


# ---- codes ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits for positive counts, by package-merge.

    Each level merges the counts with the sums of adjacent pairs of the level below. From the top, the first 2n - 2
    items say how many of the rarest ids get one more bit, and how many pairs to open on the level below.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, from_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        even = len(level) // 2 * 2
        pairs = level[0:even:2] + level[1:even:2]
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        from_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for mask in reversed(from_leaf):
        leaves_taken = int(mask[:take].sum())
        lengths[order[:leaves_taken]] += 1
        take = 2 * (take - leaves_taken)
    return lengths


@dataclass(frozen=True)
class CodeBook:
    """Canonical codes: ids by (length, id), numbered in order. Only ids and lengths need to be kept."""

    ids: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int], longest: int = LONGEST_CODE) -> CodeBook:
        ids = np.array(sorted(counts), np.int64)
        lengths = code_lengths(np.array([counts[i] for i in ids.tolist()], np.int64), longest)
        by = np.lexsort((ids, lengths))
        return cls(ids[by], lengths[by])

    @property
    def bits(self) -> int:
        return int(self.lengths.max(initial=1))

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max(initial=0)) + 1
        codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        spans = np.left_shift(np.int64(1), self.bits - self.lengths)
        first = np.cumsum(spans) - spans
        codes[self.ids] = (first >> (self.bits - self.lengths)).astype(np.uint64)
        lengths[self.ids] = self.lengths
        return codes, lengths

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables over all `bits`-wide windows: the id whose code begins the window, and its length."""
        spans = np.left_shift(np.int64(1), self.bits - self.lengths)
        ids, lengths = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.int64)
        filled = int(spans.sum())
        ids[:filled], lengths[:filled] = np.repeat(self.ids, spans), np.repeat(self.lengths, spans)
        return ids, lengths


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids' codes, most significant first, and the bit offset of every `STEP`-th id."""
    size = lengths[ids]
    stop = np.cumsum(size)
    start = stop - size
    word = start >> 5
    wide = codes[ids] << (64 - size - (start & 31)).astype(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros(int(stop[-1] >> 5) + 2, np.uint64)
    out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: int(stop[-1] + 7) // 8], start[::STEP]


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, book_bits: int, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The n ids from the first checkpoint on. All stretches between checkpoints advance together, one id at a time."""
    raw = bits + bytes(STEP * book_bits // 8 + 8)
    # four bytes from any byte on, read in place: only the windows that are asked for are ever formed
    window = np.ndarray((len(raw) - 3,), ">u4", raw, strides=(1,))
    at, mask = checkpoints.astype(np.int64), np.uint32((1 << book_bits) - 1)
    out = np.empty((len(at), STEP), np.uint32)
    for k in range(min(STEP, n)):
        code = (window[at >> 3].astype(np.uint32) >> (32 - book_bits - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = ids[code]
        at = at + lengths[code]
    return out.reshape(-1)[:n]


# ---- files ---------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, config: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
                 longest: int = LONGEST_CODE, block_ids: int = BLOCK_IDS) -> None:
    """Write `path`/blocks, `path`/parts and `path`/codes.

    Ids are written once, unordered, and counted; then rows are range-partitioned by doc_id (a hot id spreads by row), so
    part k holds the documents just before part k + 1's. Each part is a run of blocks of about `block_ids` ids in whole
    documents. A block has its documents' ids and lengths, the bits, and a checkpoint every 256 ids, so that it decodes
    alone, and from any checkpoint. `parts` has the ids before each part, `codes` the length of each id's code.
    Memory is bounded by a block, or by the longest document. Null ids come first; equal ids stay side by side.
    """
    spark = docs.sparkSession
    width = "<u2" if library_tokenizer(config).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    encoded = stored(encode_ids(docs, config, end_id, doc_id, text, tally=True).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    book = CodeBook.of(id_counts(encoded, width), longest)
    spark.createDataFrame(pa.table({"id": book.ids, "bits": book.lengths})).coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(book)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = encoded.where("n >= 0").select("doc_id", "row", "n", "ids").repartitionByRange(partitions, "doc_id", "row").sortWithinPartitions("doc_id", "row")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value.encoder()
        part, before = TaskContext.get().partitionId(), 0
        names: list = []
        counts: list[int] = []
        pending: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal before, names, counts, pending
            bits, checkpoints = pack(np.frombuffer(b"".join(pending), width), codes, lengths)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([sum(counts)], pa.int64()),
                 pa.array([names], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([bits], pa.binary()), pa.array([checkpoints], pa.list_(pa.int64()))],
                names=["part", "before", "n", "doc_ids", "counts", "bits", "checkpoints"])
            before += sum(counts)
            names, counts, pending = [], [], []
            return out

        held = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for name, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                names.append(name)
                counts.append(n)
                pending.append(ids)
                held += n
                if held >= block_ids:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    schema = f"part int, before bigint, n bigint, doc_ids array<{kind}>, counts array<bigint>, bits binary, checkpoints array<bigint>"
    ordered.select("doc_id", "n", "ids").mapInArrow(blocks, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (array) of each document, decoded block by block."""
    codes = spark.read.parquet(f"{path}/codes").collect()
    book = CodeBook(np.array([r["id"] for r in codes], np.int64), np.array([r["bits"] for r in codes], np.int64))
    by = np.lexsort((book.ids, book.lengths))
    shared = spark.sparkContext.broadcast(CodeBook(book.ids[by], book.lengths[by]))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: CodeBook = shared.value
        ids, lengths = book.decoder()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("part", "before", "n", "counts", "bits", "checkpoints")}
                counts = np.array(row["counts"].values)
                found = unpack(row["bits"].as_py(), np.array(row["checkpoints"].values), row["n"].as_py(), book.bits, ids, lengths)
                stops = np.cumsum(counts)
                starts = stops - counts
                view = memoryview(found.astype("<u4").tobytes())
                sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                columns = [batch.column("doc_ids")[k].values, pa.array(np.full(len(counts), row["part"].as_py(), np.int32)),
                           pa.array(starts + row["before"].as_py()), pa.array(counts), pa.array(sums, pa.int64())]
                names = ["doc_id", "part", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(found.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, part int, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    read = blocks.mapInArrow(decode, schema).join(spark.read.parquet(f"{path}/parts"), "part")
    return read.select("doc_id", (F.col("inside") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_round_trip(docs: DataFrame, config: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a token file to the shared folder and read it back. Null and empty texts are the end id alone; an empty
    table gives no rows."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-file")
    write_tokens(docs, path, config, doc_id=doc_id, text=text)
    return read_tokens(spark, path, with_ids)
