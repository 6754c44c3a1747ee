"""SimHash near-dedup: fingerprints, BK-trees over pigeonhole shards, and components of linked fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import attach, checkpointed, packed, stored, whole

RADIUS = 4
SHINGLE = 4
#: Widths of the six blocks of a fingerprint. Four differing bits touch four blocks at most, so two blocks stay equal.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints in one tree; a larger shard is split into trees, each of which all parts of the shard search.
TREE_SIZE = 4096
QUERY_CHUNK = 512
#: Rows of whole trees that a task searches at one time.
HELD_ROWS = 1 << 19


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is 1 where more than half of the shingle hashes have it; shingles repeat; no words give 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1:].tolist()
    starts = [0] + (ends[:len(words) - k] + 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    hashes = np.fromiter((digest(view[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops))
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row; null texts are empty."""
    base = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits)], names=["doc_id", "fp"])

    return base.mapInArrow(compute, f"doc_id {kind}, fp bigint")


# ---- BK-trees as arrays --------------------------------------------------------------------------------------


class Forest:
    """BK-trees of many shards side by side. A child hangs under its parent by their Hamming distance.

    All items descend together: in each round every item meets its current node, items at the same distance from it
    form one group, whose first item becomes the child on that edge while the others move on to it. The trees are those
    that inserting item by item would give.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        order = np.argsort(shard, kind="stable")
        self.shards, first = np.unique(shard[order], return_index=True)
        self.roots = order[first]
        self.level = np.zeros(n, np.int64)
        at = np.repeat(self.roots, np.diff(np.append(first, n)))
        item = order[order != at]
        at = at[order != at]
        depth = 0
        while len(item):
            depth += 1
            gap = np.bitwise_count(fp[item] ^ fp[at]).astype(np.int64)
            key = at * 65 + gap
            by = np.argsort(key, kind="stable")
            item, key = item[by], key[by]
            new = np.append(True, key[1:] != key[:-1])
            child = item[new]
            self.parent[child], self.edge[child], self.level[child] = key[new] // 65, key[new] % 65, depth
            at = child[np.cumsum(new) - 1][~new]
            item = item[~new]
        self.depth = depth
        nodes = np.flatnonzero(self.parent >= 0)
        key = self.parent[nodes] * 65 + self.edge[nodes]
        by = np.argsort(key, kind="stable")
        self.child, self.child_key = nodes[by], key[by]

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """The one label of each node's whole subtree, or -1 where labels differ."""
        low, high = label.copy(), label.copy()
        for depth in range(self.depth, 0, -1):
            nodes = np.flatnonzero(self.level == depth)
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return np.where(low == high, low, -1)

    def links(self, shard: np.ndarray, query: np.ndarray, radius: int, own: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) within the radius, following only edges d - radius to d + radius.

        A subtree whose members all carry the label of the query (`own`) already belongs to its component: no link into
        it can join anything, so it is skipped.
        """
        spot = np.searchsorted(self.shards, shard)
        spot[spot == len(self.shards)] = 0
        at = np.flatnonzero(self.shards[spot] == shard) if len(self.shards) else np.zeros(0, np.int64)
        node = self.roots[spot[at]] if len(at) else at
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            open_ = settled[node] != own[at]
            at, node = at[open_], node[open_]
            gap = np.bitwise_count(query[at] ^ self.fp[node]).astype(np.int64)
            near = gap <= radius
            found.append((at[near], node[near]))
            low = np.searchsorted(self.child_key, node * 65 + np.maximum(gap - radius, 0), "left")
            high = np.searchsorted(self.child_key, node * 65 + np.minimum(gap + radius, 64), "right")
            many = high - low
            at = np.repeat(at, many)
            node = self.child[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(at))] if len(at) else at
        if not found:
            return at, at
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component after the links a-b join theirs; labels point to members."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for x in (a, b):
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, x, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label


def shard_links(task: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fingerprint, smallest linked fingerprint) of the shards in one stretch of a partition.

    role: 0 in the tree only, 1 searching only, 2 both.
    """
    values, which = np.unique(fp, return_inverse=True)
    label = np.arange(len(values))
    held, asking = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    forest = Forest(task[held], fp[held])
    under = np.flatnonzero((forest.parent >= 0) & (forest.edge <= radius))
    label = merge_labels(label, which[held[under]], which[held[forest.parent[under]]])
    settled = forest.uniform(label[which[held]])
    fresh, due = False, 1
    for step, start in enumerate(range(0, len(asking), QUERY_CHUNK)):
        part = asking[start:start + QUERY_CHUNK]
        if fresh and step >= due:
            settled, fresh, due = forest.uniform(label[which[held]]), False, step + max(1, step // 2)
        own = label[which[part]]
        a, b = forest.links(task[part], fp[part], radius, own, settled)
        a, b = which[part[a]], which[held[b]]
        new = label[a] != label[b]
        if new.any():
            label, fresh = merge_labels(label, a[new], b[new]), True
    joined = np.flatnonzero(label != np.arange(len(values)))
    return values[joined], values[label[joined]]


# ---- the distributed job -------------------------------------------------------------------------------------


def _shard_keys(fp):
    """One key for each pair of blocks: the pair's number and the bits of both blocks."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    parts = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS)]
    return F.array(*[F.shiftleft(F.shiftleft(parts[i], 11).bitwiseOR(parts[j]), 4).bitwiseOR(F.lit(n))
                     for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def linked(prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, held_rows: int = HELD_ROWS) -> DataFrame:
    """Star edges (a, b) whose components are those of all pairs of distinct fingerprints within the radius.

    A shard is the set of fingerprints equal in two given blocks. Its tree goes to every task that searches it: one task
    for most shards; a shard above `tree_size` is dealt into trees of about that size and every tree is sent to each of
    the shard's query parts, so no task ever holds more than two parts and no pair of parts is left out. Trees are never
    broadcast to tasks of other shards, as all trees together grow with the data. A partition is sorted by tree and searched
    in stretches of whole trees of about `held_rows` rows, so that its memory does not grow with the partition.
    """
    if not 0 <= radius <= len(BLOCKS) - 2:
        raise ValueError(f"radius {radius}: {len(BLOCKS)} blocks leave two equal for at most {len(BLOCKS) - 2} bits")
    keyed = prints.select("fp", F.explode(_shard_keys(F.col("fp"))).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    large = stored(sizes.where(F.col("size") > tree_size).select("shard", F.ceil(F.col("size") / tree_size).cast("int").alias("parts")), "large-shards")
    placed = keyed.join(large, "shard", "left").select(
        "fp", "shard", F.coalesce("parts", F.lit(1)).alias("parts"))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = placed.select("fp", "shard", own.alias("own"), F.explode(every).alias("other")).select(
        "fp", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("role"))

    def found(table: pa.Table) -> pa.RecordBatch:
        task, fp, role = (table.column(c).to_numpy() for c in ("task", "fp", "role"))
        a, b = shard_links(task, fp.view(np.uint64), role, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        limit = held_rows
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < limit:
                continue
            table = pa.Table.from_batches(held)
            task = table.column("task").to_numpy()
            cut = int(np.searchsorted(task, task[-1], "left"))
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            limit = max(held_rows, 2 * (len(task) - cut))
        if any(b.num_rows for b in held):
            yield found(pa.Table.from_batches(held))

    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = dealt.repartition(partitions, "task").sortWithinPartitions("task")
    return ordered.mapInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b): root is the same for all nodes of a component.

    Rounds over (node, parent) rows: a node and its parent take the smallest parent among the node's neighbours, then
    parents are followed once. Each round is one written checkpoint; the rounds end when no parent changes. A hub's
    edges meet its parent in an equi-join, which Spark splits, and minima are taken before the shuffle.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")))
    while True:
        near = both.join(parents.select(F.col("node").alias("b"), F.col("parent").alias("offer")), "b")
        best = near.groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        hooks = best.join(parents, "node")
        offers = hooks.select(F.explode(F.array(F.struct("node", F.least("offer", "parent").alias("parent")),
                                                F.struct(F.col("parent").alias("node"), F.least("offer", "parent").alias("parent")))).alias("x")).select("x.*")
        hooked = offers.groupBy("node").agg(F.min("parent").alias("parent"))
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = hooked.join(up, "parent").select("node", F.col("above").alias("parent"))
        fresh = checkpointed(jumped.join(parents.withColumnRenamed("parent", "was"), "node").select("node", "parent", "was"))
        if fresh.where("parent <> was").isEmpty():
            return fresh.select("node", F.col("parent").alias("root"))
        parents = fresh.select("node", "parent")


def near_dedup(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row: the smallest id reachable over links of `radius` differing bits or fewer.

    Rows with equal fingerprints are one class and meet the search as one fingerprint, so exact copies cost nothing
    there. Texts without words have fingerprint 0 and are linked like any other; null ids are ignored as smallest id
    unless a component has no other; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "classes")
    roots = components(stored(linked(classes, radius), "links"))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", "size", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    many = stored(smallest.where("members > 1").select("root", "component_id"), "component-ids")
    named = stored(placed.join(many, "root", "left").select("fp", "size", F.coalesce("component_id", "first").alias("component_id")), "named")
    return attach(rows, named, "fp", "size").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id is their component's, with their columns: one document of each group."""
    kept = near_dedup(docs, radius, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    rows = packed(docs, F.col(doc_id).alias("own_id"))
    return rows.join(kept, rows["own_id"].eqNullSafe(kept["doc_id"]), "left_semi").select("row.*")
