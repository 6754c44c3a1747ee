"""Readers for the JSON, CSV and XML shapes of the tools' data files, and the result writer.

All readers take an explicit schema or column list, so no pass over the data infers types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = ("", "null", "NaN", "nan", "None")


def read_columnar_json(spark: SparkSession, path: str, block: str, columns: dict[str, str], whole_file: bool = True) -> DataFrame:
    """One row per position of parallel arrays in an object: {block: {time: [...], value: [...]}}.

    `columns` maps array names to element types. The file name stays as `source` so sites remain apart.
    """
    fields = ", ".join(f"`{c}`: array<{t}>" for c, t in columns.items())
    raw = spark.read.schema(f"`{block}` struct<{fields}>").option("multiLine", str(whole_file).lower()).json(path)
    arrays = F.arrays_zip(*[F.col(f"{block}.{c}").alias(c) for c in columns])
    return raw.select(F.input_file_name().alias("source"), F.inline(arrays))


def read_records_json(spark: SparkSession, path: str, header: dict[str, str], records: str, columns: dict[str, str],
                      whole_file: bool = True) -> DataFrame:
    """One row per record of a nested list, with the header fields repeated."""
    fields = ", ".join(f"`{c}`: {t}" for c, t in columns.items())
    schema = ", ".join([f"`{c}` {t}" for c, t in header.items()] + [f"`{records}` array<struct<{fields}>>"])
    raw = spark.read.schema(schema).option("multiLine", str(whole_file).lower()).json(path)
    return raw.select(*header, F.inline(records))


def typed(column: str, kind: str) -> Column:
    """Text to a type; empty, 'null' and malformed texts become NULL."""
    x = F.trim(F.col(column))
    return F.when(~x.isin(*MISSING), x).try_cast(kind)


def read_catalog_csv(spark: SparkSession, path: str, columns: dict[str, str], header_lines: int = 1) -> DataFrame:
    """CSV of texts to typed columns. With two header lines the units line below the names is dropped."""
    raw = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    out = raw.select(*[typed(c, t).alias(c) for c, t in columns.items()])
    if header_lines == 2:
        out = out.filter(F.coalesce(*[F.col(c).cast("string") for c, t in columns.items() if t != "string"]).isNotNull())
    return out


def read_facets(spark: SparkSession, path: str, dim: str, whole_file: bool = True) -> DataFrame:
    """List of (key, count) pairs to rows (dim, key, n)."""
    raw = spark.read.schema("counts array<struct<key: string, count: bigint>>").option("multiLine", str(whole_file).lower()).json(path)
    return raw.select(F.inline("counts")).select(F.lit(dim).alias("dim"), "key", F.col("count").alias("n"))


def parse_facets(df: DataFrame, pairs: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (key, n) of a column with a JSON list of [key, count] pairs."""
    arr = F.from_json(F.col(pairs), "array<array<string>>")
    one = df.select(*keep, F.explode(arr).alias("p"))
    return one.select(*keep, F.get("p", F.lit(0)).alias("key"), F.get("p", F.lit(1)).try_cast("bigint").alias("n"))


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_table(spark: SparkSession, path: str, cpu_heavy: bool = False) -> DataFrame:
    """A parquet table; with `cpu_heavy` a scan of fewer splits than cores is spread over all cores once.

    Large tables have more splits than cores and are read as they are, so the extra exchange only appears on small
    inputs, where the work per row outweighs moving it.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if cpu_heavy and df.rdd.getNumPartitions() < cores else df


# ---- papers --------------------------------------------------------------------------------------------------

PAPER_COLUMNS = ["title", "authors", "year", "abstract", "doi", "source_ids", "cited_by_count", "venue", "publication_type", "url", "pdf_url"]


def rebuild_abstract(inverted: Column) -> Column:
    """Text of a word -> positions map: words placed at their positions, joined by blanks, within the row; empty without words."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " ")


def inverted_index(docs: DataFrame, row_id: str, text: str, name: str = "inverted", every_row: bool = False) -> DataFrame:
    """word -> positions map of every text with a word (the inverse of rebuild_abstract).

    With `every_row` texts without a word have an empty map and NULL texts have NULL. A vertical tab is part of a word. Words
    are sorted with their positions inside their row, where a word is a run, so nothing is shuffled.
    """
    words = F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda w: w != "")
    rows = docs.select(row_id, F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p")))).alias("__w"))
    if not every_row:
        rows = rows.filter(F.size("__w") > 0)
    size = F.size("__w")
    rows = rows.withColumn("__at", F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("__w", i)["w"] != F.get("__w", i - 1)["w"])))
    ends = F.concat(F.slice("__at", F.lit(2), F.size("__at")), F.array(size))
    spots = F.zip_with("__at", ends, lambda i, j: F.struct(F.get("__w", i)["w"].alias("w"), F.transform(F.slice("__w", i + 1, j - i), lambda s: s["p"]).alias("ps")))
    none = F.when(F.col("__w").isNotNull(), F.create_map().cast("map<string, array<int>>"))
    return rows.select(row_id, F.when(size > 0, F.map_from_entries(spots)).otherwise(none).alias(name))


WORK_SCHEMAS = {
    "graph": """title string, authorships array<struct<author: struct<display_name: string>>>, publication_year int, doi string, id string,
        abstract_inverted_index map<string, array<int>>, cited_by_count bigint, type string,
        primary_location struct<source: struct<display_name: string>>, open_access struct<oa_url: string>""",
    "registry": """title array<string>, author array<struct<given: string, family: string>>, published struct<`date-parts`: array<array<int>>>,
        abstract string, DOI string, `is-referenced-by-count` bigint, type string, `container-title` array<string>, URL string""",
    "scholar": """title string, authors array<struct<name: string>>, year int, abstract string, externalIds struct<DOI: string>, paperId string,
        citationCount bigint, venue string, publicationTypes array<string>, openAccessPdf struct<url: string>""",
}


def normalise_works(df: DataFrame, payload: str, shape: str) -> DataFrame:
    """JSON payloads of one of three public work shapes to the common paper columns."""
    w = df.select(F.from_json(F.col(payload), WORK_SCHEMAS[shape]).alias("w")).select("w.*")
    none = F.lit(None).cast("string")
    if shape == "graph":
        names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
        cols = dict(title=F.coalesce("title", F.lit("")), authors=names, year=F.col("publication_year"), abstract=rebuild_abstract(F.col("abstract_inverted_index")),
                    doi=F.regexp_replace("doi", "^https://doi.org/", ""), source_ids=F.create_map(F.lit("graph"), F.coalesce("id", F.lit(""))), cited_by_count=F.col("cited_by_count"),
                    venue=F.col("primary_location.source.display_name"), publication_type=F.col("type"), url=none, pdf_url=F.col("open_access.oa_url"))
    elif shape == "registry":
        full = F.transform("author", lambda a: F.when(a["given"].isNotNull() & (a["given"] != "") & (a["family"] != ""), F.concat_ws(" ", a["given"], a["family"]))
                           .when(a["family"] != "", a["family"]))
        plain = F.nullif(F.trim(F.regexp_replace("abstract", "<[^>]+>", "")), F.lit(""))
        cols = dict(title=F.coalesce(F.get("title", F.lit(0)), F.lit("")), authors=F.array_compact(full), year=F.get(F.get("published.date-parts", F.lit(0)), F.lit(0)),
                    abstract=plain, doi=F.col("DOI"), source_ids=F.create_map(F.lit("registry"), F.coalesce("DOI", F.lit(""))), cited_by_count=F.col("is-referenced-by-count"),
                    venue=F.get("container-title", F.lit(0)), publication_type=F.col("type"), url=F.col("URL"), pdf_url=none)
    else:
        names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
        ids = F.when(F.col("paperId").isNotNull(), F.create_map(F.lit("scholar"), F.col("paperId"))).otherwise(F.create_map().cast("map<string,string>"))
        cols = dict(title=F.coalesce("title", F.lit("")), authors=names, year=F.col("year"), abstract=F.col("abstract"), doi=F.col("externalIds.DOI"), source_ids=ids,
                    cited_by_count=F.col("citationCount"), venue=F.nullif("venue", F.lit("")), publication_type=F.get("publicationTypes", F.lit(0)), url=none,
                    pdf_url=F.col("openAccessPdf.url"))
    return w.select(*[cols[c].alias(c) for c in PAPER_COLUMNS])


FEED_SCHEMA = """id string, title string, summary string, published string, `arxiv:doi` string, author array<struct<name: string>>,
    link array<struct<_href: string, _title: string>>"""


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Atom feed entries to paper columns; entries are split by Spark's XML source, so one file may hold many."""
    e = spark.read.format("xml").option("rowTag", "entry").schema(FEED_SCHEMA).load(path)
    squeeze = F.regexp_replace(F.trim("summary"), r"\s+", " ")
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    short = F.regexp_replace(F.regexp_extract("id", r"/abs/(.+)$", 1), r"v\d+$", "")
    cols = dict(title=F.coalesce(F.trim("title"), F.lit("")), authors=F.transform("author", lambda a: F.trim(a["name"])), year=F.substring("published", 1, 4).try_cast("int"),
                abstract=squeeze, doi=F.trim("arxiv:doi"), source_ids=F.create_map(F.lit("preprint"), short), cited_by_count=F.lit(None).cast("bigint"),
                venue=F.lit(None).cast("string"), publication_type=F.lit("preprint"), url=F.trim("id"), pdf_url=pdf)
    return e.filter(F.col("id").isNotNull()).select(*[cols[c].alias(c) for c in PAPER_COLUMNS])


# ---- results -------------------------------------------------------------------------------------------------

def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become NULL."""
    fixes = {}
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            x = F.col(f"`{f.name}`")
            fixes[f.name] = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return df.withColumns(fixes) if fixes else df


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a result table with finite numbers. Tasks write their own files; nothing passes through the driver."""
    finite(df).write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)
