"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line without surrounding white space and with A-Z lower-cased; its hash is the first half of the key's
SHA-256. A run is a table of hashes in buckets sorted by hash, so that merge joins read it without a shuffle. A batch of
documents is reduced to one row a hash, merge-anti-joined with the settled hashes of every run, joined with their open counts,
and what is left becomes its own run: settled where the count reaches the limit, open otherwise. Runs of a level are
compacted into one of the next level as soon as there are `fanout` of them.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import SPACES, fresh_path, packed, stored, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MANIFEST = "seq long, run string, level int, batch string, replaces array<string>"


def lines(text: Column) -> Column:
    """The lines of a text, split at line feeds only; null and empty texts have one empty line."""
    return F.split(text, "\n", -1)


def line_hashes(text: Column, min_chars: int = 1) -> Column:
    """One 16-byte hash a line, null for keys shorter than `min_chars` code points."""
    bare = F.transform(lines(text), lambda x: F.btrim(x, F.lit(SPACES)))
    # lower() is A-Z only on ASCII, where it is much the faster
    keys = F.transform(bare, lambda x: F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))
    return F.transform(keys, lambda x: F.when(F.length(x) >= max(min_chars, 0), F.unhex(F.substring(F.sha2(x, 256), 1, 32))))


class LineIndex:
    """Counts of line hashes over all batches added, kept as levelled sorted runs at `path`.

    The folder is the state; another session opens it with the same path, limit and number of buckets. A batch has a name: a
    name that the manifest holds already is not added again, and a run whose job failed before its manifest row was
    written is overwritten by the next attempt, so a job can be repeated at any point. Replaced runs stay readable until
    `drop_tables`.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, max(fanout, 2)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self._prefix = f"line_run_{hashlib.sha256(path.encode()).hexdigest()[:12]}"
        self._records: list | None = None

    def records(self) -> list:
        """Manifest rows in order: one a run ever written, so a few hundred a year of daily batches."""
        if self._records is None:
            folder = self.spark.read.format("parquet").schema(MANIFEST)
            try:
                self._records = folder.load(f"{self.path}/manifest").orderBy("seq").collect()
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                self._records = []
        return self._records

    def live(self) -> list:
        gone = {run for record in self.records() for run in record.replaces}
        return [record for record in self.records() if record.run not in gone]

    def _table(self, run: str) -> str:
        return f"{self._prefix}_{run}"

    def read(self, run: str) -> DataFrame:
        table = self._table(run)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (hash BINARY, n BIGINT, settled BOOLEAN) USING parquet "
                           f"CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame, run: str, level: int, batch: str, replaces: list[str]) -> None:
        (rows.select("hash", "n", "settled").repartition(self.buckets, "hash").write.mode("overwrite").format("parquet")
            .bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(self._table(run), path=f"{self.path}/{run}"))
        record = self.spark.createDataFrame([(len(self.records()), run, level, batch, replaces)], MANIFEST)
        record.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._records = None

    def add(self, counts: DataFrame, batch: str) -> None:
        """Add one batch: `counts` has hash and n, its number of documents with the line, one row a hash."""
        if any(record.batch == batch for record in self.records()):
            return
        rest = counts.select("hash", "n", F.col("n").alias("total"))
        for record in self.live():
            run = self.read(record.run)
            rest = rest.join(run.where("settled").select("hash").hint("merge"), "hash", "left_anti")
            open_ = run.where("not settled").select("hash", F.col("n").alias("before"))
            rest = rest.join(open_.hint("merge"), "hash", "left").select("hash", "n", (F.col("total") + F.coalesce("before", F.lit(0))).alias("total"))
        rows = rest.select("hash", "n", (F.col("total") >= self.min_docs).alias("settled"))
        name = hashlib.sha256(batch.encode()).hexdigest()[:16]
        self._write(rows, f"0_{name}", 0, batch, [])
        self._compact()

    def _compact(self) -> None:
        level = 0
        while True:
            runs = [record.run for record in self.live() if record.level == level]
            if len(runs) < self.fanout:
                if not any(record.level > level for record in self.live()):
                    return
                level += 1
                continue
            merged = reduce(_merge, [self.read(run) for run in runs])
            name = hashlib.sha256(",".join(runs).encode()).hexdigest()[:16]
            self._write(merged, f"{level + 1}_{name}", level + 1, "", runs)

    def settled(self) -> DataFrame:
        """Hashes found in at least `min_docs` documents, each once: a key is settled in one run only.

        They are written as a table of their own: Spark takes a union of bucketed scans for partitioned by their key, though
        it lists their buckets one after the other, so nothing may be joined or grouped on that union.
        """
        parts = [self.read(record.run).where("settled").select("hash") for record in self.live()]
        return stored(reduce(DataFrame.unionByName, parts), "settled-lines") if parts else self.spark.createDataFrame([], "hash binary")

    def drop_tables(self) -> None:
        """Forget the catalog entries; the files stay."""
        for record in self.records():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(record.run)}")


def _merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join of their buckets."""
    other = right.withColumnsRenamed({"n": "other_n", "settled": "other_settled"}).hint("merge")
    return left.join(other, "hash", "full").select(
        "hash", (F.coalesce("n", F.lit(0)) + F.coalesce("other_n", F.lit(0))).alias("n"),
        (F.coalesce("settled", F.lit(False)) | F.coalesce("other_settled", F.lit(False))).alias("settled"))


def _tagged(docs: DataFrame, doc_id: str, text: str, *columns: Column) -> DataFrame:
    """A row is named by its id and a hash of its text: rows that share both have the same result."""
    rows = packed(docs, F.col(f"`{doc_id}`").alias("doc_id"), whole(f"`{text}`").alias("text"))
    return rows.select("doc_id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("tag"), *columns)


def _kept_lines(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int, index: LineIndex | None, doc_id: str, text: str) -> DataFrame:
    """row (the input row), doc_id, text, n_lines, n_dropped."""
    spark = docs.sparkSession
    own = index is None
    index = index or LineIndex(spark, fresh_path(spark, "line-index"), min_docs, fanout)
    batch = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(batches)).cast("int")
    hashed = stored(_tagged(docs, doc_id, text, line_hashes(F.col("text"), min_chars).alias("hashes")), "line-hashes")
    known = F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull())))
    counts = hashed.select(batch.alias("batch"), known.alias("hash")).groupBy("batch", "hash").agg(F.count("*").alias("n"))
    counts = stored(counts, "line-counts")
    call = uuid.uuid4().hex
    for b in range(batches):
        index.add(counts.where(F.col("batch") == b).select("hash", "n"), f"{call}-{b}")
    settled = index.settled()
    if own:
        index.drop_tables()
    hits = _positions(hashed, counts, settled, batches).withColumnsRenamed({"doc_id": "hit_id", "tag": "hit_tag"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag"))
    body = _tagged(docs, doc_id, text, F.col("row"), F.col("text")).join(hits, same, "left")
    split = body.select("row", "doc_id", lines(F.col("text")).alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    joined = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return split.select("row", "doc_id", joined.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 4, index: LineIndex | None = None,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (the lines that stay), n_lines, n_dropped.

    Keys of at least `min_chars` code points found in at least `min_docs` rows lose all their lines; other lines stay, joined
    by line feeds. A null or empty text is one empty line. Every row is a document, rows that repeat an id too. Rows are
    added to the index in `batches` by their id and text; with `index`, lines that its earlier batches settled go as well,
    and its own limit holds. Empty tables give no rows.
    """
    return _kept_lines(docs.select(doc_id, text), min_docs, min_chars, batches, fanout, index, doc_id, text).drop("row")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 4, index: LineIndex | None = None,
                        doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns, their text as line_dedup leaves it."""
    kept = _kept_lines(docs, min_docs, min_chars, batches, fanout, index, doc_id, text)
    return kept.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def _positions(hashed: DataFrame, counts: DataFrame, settled: DataFrame, batches: int) -> DataFrame:
    """Per row with settled lines the places of these. Hashes above a set share of all lines number fewer than that many
    per batch, whatever the data; they are looked up by broadcast, all others by a merge join of small keys."""
    shares = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    limit = max((counts.agg(F.sum("n")).first()[0] or 0) // (shares * batches), 1)
    frequent = counts.where(F.col("n") > limit).select("hash").distinct()
    hot = stored(settled.join(frequent, "hash", "left_semi"), "hot-lines")
    found = hashed.select("doc_id", "tag", F.posexplode("hashes").alias("place", "hash")).where(F.col("hash").isNotNull())
    cold = settled.join(F.broadcast(hot), "hash", "left_anti").hint("merge")
    rest = found.join(F.broadcast(hot), "hash", "left_anti").join(cold, "hash", "left_semi")
    places = found.join(F.broadcast(hot), "hash", "left_semi").unionByName(rest)
    return places.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("drops"))

