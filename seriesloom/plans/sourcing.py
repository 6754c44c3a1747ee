"""Reader, writer and streaming queries. Files are written from the test tables first and read back."""

import uuid

from pyspark.sql import functions as F

from seriesloom.operators.evidence import fresh_rows, latest_per_key
from seriesloom.operators.joins import box_join, first_box
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import rounded
from seriesloom.plans.inputs import DAILY, daily
from seriesloom.session import shared_folder
from seriesloom.sources import dimensions as D
from seriesloom.sources import readers as R
from seriesloom.streaming.incremental import load_new_files, newest_table, newest_wins


def scratch(t) -> str:
    """A new folder under the folder that driver and executors share."""
    return f"{shared_folder(t.spark)}/scratch-{uuid.uuid4().hex}"


@query("a01_columnar_json", f"WITH {DAILY} SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, min(day) AS first_day FROM daily GROUP BY 1")
def _(t):
    path = scratch(t)
    d = daily(t).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "value", F.col("event_type").alias("kind")))).alias("a"))
    d.select(F.struct(*[F.col(f"a.{c}").alias(c) for c in ("day", "value", "kind")]).alias("daily")).write.json(path)
    rows = R.read_columnar_json(t.spark, path, "daily", {"day": "string", "value": "double", "kind": "string"}, whole_file=False)
    return rows.groupBy(F.col("kind").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("day").alias("first_day"))


@query("a02_records_json", """
SELECT o_orderpriority AS site, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def _(t):
    path = scratch(t)
    (t.orders.groupBy(F.col("o_orderpriority").alias("site"), F.floor(F.col("o_orderkey") / 500).alias("block"))
     .agg(F.collect_list(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("flow"))).alias("records")).drop("block").write.json(path))
    rows = R.read_records_json(t.spark, path, {"site": "string"}, "records", {"date": "date", "flow": "double"}, whole_file=False)
    return rows.groupBy("site", F.year("date").cast("bigint").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("flow"), 2).alias("total"))


@query("a03_catalog_csv", """
SELECT p_type, count(*) AS n, count(*) FILTER (p_size % 5 <> 0 AND p_size % 7 <> 0) AS n_size, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1""")
def _(t):
    path = scratch(t)
    size = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 == 0, "null").otherwise(F.col("p_size").cast("string"))
    t.part.select("p_name", "p_type", size.alias("pl_rade"), F.col("p_retailprice").cast("string").alias("price")).write.option("header", "true").csv(path)
    rows = R.read_catalog_csv(t.spark, path, {"p_type": "string", "pl_rade": "double", "price": "double"})
    return rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count("pl_rade").alias("n_size"), F.round(F.sum("price"), 2).alias("total"))


@query("a04_parse_facets", """
SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    counts = t.events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    facet = counts.groupBy("day").agg(F.to_json(F.collect_list(F.array("event_type", F.col("n").cast("string")))).alias("pairs"))
    return R.parse_facets(facet, "pairs").groupBy("key").agg(F.sum("n").alias("n"))


@query("a05_read_feed", """
SELECT CAST(doc_id AS VARCHAR) AS paper, CAST(1990 + doc_id % 30 AS INTEGER) AS year, concat('Title ', doc_id) AS title, CAST(1 + doc_id % 3 AS BIGINT) AS n_authors, doc_id % 2 = 0 AS has_doi FROM documents""")
def _(t):
    path = scratch(t)
    i = F.col("doc_id")
    authors = F.array_join(F.transform(F.sequence(F.lit(0), i % 3), lambda k: F.concat(F.lit("<author><name>A"), k.cast("string"), F.lit(" B</name></author>"))), "")
    entry = F.concat(F.lit("<entry><id>http://host/abs/"), i.cast("string"), F.lit("v1</id><title> Title "), i.cast("string"), F.lit(" </title><summary> a  b </summary><published>"),
                     (1990 + i % 30).cast("string"), F.lit("-01-02T00:00:00Z</published>"), authors, F.when(i % 2 == 0, "<arxiv:doi>10.1/x</arxiv:doi>").otherwise(""),
                     F.lit('<link href="http://host/pdf" title="pdf"/><link href="http://host/x" title="x"/></entry>'))
    # one feed file per 200 papers
    feeds = t.documents.select(F.floor(i / 200).alias("part"), entry.alias("e")).groupBy("part").agg(F.array_join(F.collect_list("e"), "\n").alias("es"))
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'), F.col("es"), F.lit("</feed>"))
    feeds.select("part", feed.alias("value")).write.partitionBy("part").text(path)
    p = R.read_feed_xml(t.spark, path)
    return p.select(F.col("source_ids")["preprint"].alias("paper"), "year", "title", F.size("authors").cast("bigint").alias("n_authors"), F.col("doi").isNotNull().alias("has_doi"))


@query("a06_normalise_works", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS abstract, CAST(1990 + doc_id % 30 AS INTEGER) AS year, concat('10.1/', doc_id) AS doi, CAST(doc_id % 7 AS BIGINT) AS cited FROM documents""")
def _(t):
    i = F.col("doc_id")
    w = F.to_json(F.struct(F.lit("T").alias("title"), F.concat(F.lit("https://doi.org/10.1/"), i.cast("string")).alias("doi"), (1990 + i % 30).cast("int").alias("publication_year"),
                           F.col("inverted").alias("abstract_inverted_index"), (i % 7).alias("cited_by_count"), i.cast("string").alias("id")))
    p = R.normalise_works(R.inverted_index(t.documents, "doc_id", "text", every_row=True).select(w.alias("payload")), "payload", "graph")
    return p.select(F.col("source_ids")["graph"].cast("bigint").alias("doc_id"), F.md5("abstract").alias("abstract"), "year", "doi", F.col("cited_by_count").alias("cited"))


@query("a06_registry_works", """
SELECT p_partkey, p_name AS title, concat('Ann ', split_part(p_name, ' ', 2)) AS first_author, CAST(1970 + p_size AS INTEGER) AS year, concat('About ', p_name) AS abstract FROM part""")
def _(t):
    last = F.split_part("p_name", F.lit(" "), F.lit(2))
    w = F.to_json(F.struct(F.array("p_name").alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), last.alias("family"))).alias("author"),
                           F.struct(F.array(F.array((1970 + F.col("p_size")).cast("int"))).alias("date-parts")).alias("published"),
                           F.concat(F.lit("<jats:p>About "), F.col("p_name"), F.lit("</jats:p>")).alias("abstract"), F.col("p_partkey").cast("string").alias("DOI")))
    p = R.normalise_works(t.part.select(w.alias("payload")), "payload", "registry")
    return p.select(F.col("doi").cast("bigint").alias("p_partkey"), "title", F.get("authors", F.lit(0)).alias("first_author"), "year", "abstract")


@query("a07_write_result", """
SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 10 <> 0) AS n_finite FROM orders GROUP BY 1""")
def _(t):
    path = scratch(t)
    x = F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    R.write_result(t.orders.select("o_orderstatus", x.alias("x")), path, partition_by=["o_orderstatus"])
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_finite"))


REGION_CASE = "CASE " + " ".join(f"WHEN la BETWEEN {a} AND {b} AND lo BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in D.SEISMIC_REGIONS) + " ELSE 'intraplate' END"


@query("a08_dimension_regions", f"""
WITH p AS (SELECT (user_id * 7919) % 1400 / 10.0 - 70 AS la, (user_id * 104729) % 3600 / 10.0 - 180 AS lo FROM events) SELECT {REGION_CASE} AS region, count(*) AS n FROM p GROUP BY 1""")
def _(t):
    la, lo = (F.col("user_id") * 7919) % 1400 / 10.0 - 70, (F.col("user_id") * 104729) % 3600 / 10.0 - 180
    return t.events.groupBy(first_box(la, lo, D.SEISMIC_REGIONS, "intraplate").alias("region")).agg(F.count(F.lit(1)).alias("n"))


CURRENCY_VALUES = ", ".join(f"({i}, '{c}', '{r}', '{m}')" for i, (c, r, m) in enumerate(D.CURRENCIES))


@query("a08_currency_markets", f"""
WITH c(position, ccy, region, market) AS (VALUES {CURRENCY_VALUES}), o AS (SELECT c_nationkey % 20 AS position, year(o_orderdate) AS yr, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT market, region, CAST(yr AS BIGINT) AS yr, count(*) AS n, count(DISTINCT ccy) AS n_currencies, round(sum(o_totalprice), 2) AS total FROM o JOIN c USING (position) GROUP BY 1, 2, 3""")
def _(t):
    """Order value by market type and region, each nation taken to trade in one of the currencies."""
    ccy = D.currencies(t.spark)
    c = t.customer.select("c_custkey", (F.col("c_nationkey") % 20).cast("int").alias("position"))
    o = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("position", F.year("o_orderdate").cast("bigint").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return o.join(ccy, "position").groupBy("market", "region", "yr").agg(
        F.sum("n").alias("n"), F.count_distinct("ccy").alias("n_currencies"), F.round(F.sum("total"), 2).alias("total"))


CRISIS_VALUES = ", ".join(f"({i}, '{n}', DATE '{a}', DATE '{b}')" for i, (n, a, b) in enumerate(D.KNOWN_CRISES))


@query("a08_known_crises", f"""
WITH k(i, crisis, first_day, last_day) AS (VALUES {CRISIS_VALUES}), w AS (SELECT date_trunc('week', o_orderdate)::DATE AS day, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT coalesce(crisis, 'none') AS crisis, count(*) AS n_weeks, CAST(sum(n) AS BIGINT) AS n, round(sum(v), 2) AS total FROM (
  SELECT n, v, (SELECT crisis FROM k WHERE first_day <= day + 6 AND day <= last_day ORDER BY i LIMIT 1) AS crisis FROM w) GROUP BY 1""")
def _(t):
    """Weeks of orders under the first known crisis that they touch."""
    w = t.orders.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    name = F.coalesce(*[F.when((F.date_add("day", 6) >= F.lit(a).cast("date")) & (F.col("day") <= F.lit(b).cast("date")), n) for n, a, b in D.KNOWN_CRISES], F.lit("none"))
    return w.groupBy(name.alias("crisis")).agg(F.count(F.lit(1)).alias("n_weeks"), F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("total"))


BASIN_VALUES = ", ".join(str(b) for b in D.OCEAN_BASINS)


@query("a08_dimension_basins", f"""
WITH p AS (SELECT DISTINCT user_id, (user_id * 7919) % 1400 / 10.0 - 70 AS la, (user_id * 104729) % 3600 / 10.0 - 180 AS lo FROM events), m AS (SELECT DISTINCT user_id, basin FROM p JOIN (VALUES {BASIN_VALUES}) b(basin, a, b, c, d) ON la BETWEEN a AND b AND lo BETWEEN c AND d)
SELECT basin, count(*) AS n, round(sum(cos(radians((user_id * 7919) % 1400 / 10.0 - 70)) * value) / sum(cos(radians((user_id * 7919) % 1400 / 10.0 - 70))), 6) AS area_mean FROM events JOIN m USING (user_id) GROUP BY 1""")
def _(t):
    la, lo = (F.col("user_id") * 7919) % 1400 / 10.0 - 70, (F.col("user_id") * 104729) % 3600 / 10.0 - 180
    cells = t.events.select("user_id", la.alias("la"), lo.alias("lo")).distinct()
    m = box_join(cells, "la", "lo", D.OCEAN_BASINS, "basin")
    w = F.cos(F.radians("la"))
    out = t.events.join(m, "user_id").groupBy("basin").agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col("value")) / F.sum(w)).alias("area_mean"))
    return rounded(out, 6, "area_mean")


@query("s01_incremental_load", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def _(t):
    base = scratch(t)
    for _run in range(2):  # the second run finds nothing new
        load_new_files(t.spark, t.folder, t.events.schema, base + "/sink", base + "/checkpoint", glob="events.parquet")
    out = t.spark.read.parquet(base + "/sink")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s02_ttl_latest", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY) WHERE r = 1""")
def _(t):
    live = fresh_rows(t.events, "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 10 * 86400)
    return latest_per_key(live, F.col("user_id"), [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")], "k").select("user_id", "event_id", "value")


@query("s02_newest_stream", """
SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events)
WHERE r = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY""")
def _(t):
    """The events as a stream of one file a week, after which the first two weeks come a second time with other values: rows
    behind the watermark, and older rows of keys that are still held, change nothing."""
    base = scratch(t)
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    e = t.events.select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), week.alias("week"))
    weeks = sorted(r.week for r in e.select("week").distinct().collect())
    parts = [e.filter(F.col("week") == w) for w in weeks] + [e.filter(F.col("week") < 2).withColumn("value", F.col("value") + 1000)]
    for k, part in enumerate(parts):
        part.drop("week").coalesce(1).write.parquet(f"{base}/in/part={k:04d}")
    source = t.spark.readStream.schema(e.drop("week").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    out = newest_table(newest_wins(source, ["user_id"], "ts", "10 days"), ["user_id"], "ts", base + "/newest", base + "/marks")
    newest = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("m")).scalar()
    live = out.filter(F.col("ts") >= newest - F.expr("INTERVAL 10 DAYS"))
    return live.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
