"""Scalar function queries."""

from pyspark.sql import functions as F

from seriesloom.functions import scalars as K
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import SEASON
from seriesloom.plans.inputs import MONTHLY, monthly


@query("k01_calendar_parts", f"""
SELECT o_orderkey, {SEASON} AS season, quarter(o_orderdate) AS qtr, CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade,
  CASE WHEN o_custkey % 180 - 90 >= 0 THEN 'north' ELSE 'south' END AS hemisphere FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", K.season(d).alias("season"), F.quarter(d).cast("bigint").alias("qtr"), K.decade(F.year(d)).alias("decade"),
                           K.hemisphere(F.col("o_custkey") % 180 - 90).alias("hemisphere"))


@query("k02_fractional_year", """
SELECT l_orderkey, l_linenumber, CAST(list_extract([0,31,59,90,120,151,181,212,243,273,304,334], month(l_shipdate)) + day(l_shipdate) AS INTEGER) AS doy,
  round(year(l_shipdate) + (month(l_shipdate) - 0.5) / 12, 8) AS t_frac, round(year(l_shipdate) + (month(l_shipdate) - 0.5) / 12 + (day(l_shipdate) - 15) / 365.25, 8) AS t_day FROM lineitem""")
def _(t):
    d = F.col("l_shipdate")
    return t.lineitem.select("l_orderkey", "l_linenumber", K.day_of_year_365(d).alias("doy"), F.round(K.fractional_year(d), 8).alias("t_frac"),
                             F.round(K.fractional_year(d) + (F.dayofmonth(d) - 15) / 365.25, 8).alias("t_day"))


@query("k03_haversine", """
WITH p AS (SELECT event_id, (user_id * 7919) % 1400 / 10.0 - 70 AS la, (user_id * 104729) % 3600 / 10.0 - 180 AS lo FROM events)
SELECT event_id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(40.0 - la) / 2), 2) + cos(radians(la)) * cos(radians(40.0)) * pow(sin(radians(-75.0 - lo) / 2), 2)))), 4) AS km FROM p""")
def _(t):
    la, lo = (F.col("user_id") * 7919) % 1400 / 10.0 - 70, (F.col("user_id") * 104729) % 3600 / 10.0 - 180
    return t.events.select("event_id", F.round(K.haversine_km(la, lo, F.lit(40.0), F.lit(-75.0)), 4).alias("km"))


@query("k04_range_classes", """
WITH e AS (SELECT event_id, value, value / 10 AS r, value * 20 AS teff FROM events)
SELECT event_id, CASE WHEN r < 0.8 THEN 'sub-Earth' WHEN r < 1.25 THEN 'Earth-like' WHEN r < 2 THEN 'super-Earth' WHEN r < 3.5 THEN 'sub-Neptune' WHEN r < 6 THEN 'Neptune' WHEN r < 10 THEN 'sub-Saturn'
  WHEN r < 25 THEN 'gas giant' WHEN r < 100 THEN 'super-Jupiter' END AS planet, CASE WHEN value < 1 THEN 'ultra-short (P<1d)' WHEN value < 10 THEN 'short (1-10d)' WHEN value < 100 THEN 'moderate (10-100d)'
  WHEN value < 1000 THEN 'long (100-1000d)' ELSE 'very long (>1000d)' END AS period, CASE WHEN teff >= 6000 THEN 'F' WHEN teff >= 5200 THEN 'G' WHEN teff >= 3700 THEN 'K' WHEN teff >= 2400 THEN 'M' ELSE 'Other' END AS star,
  CASE WHEN value < 30 THEN 'shallow' WHEN value < 300 THEN 'intermediate' ELSE 'deep' END AS depth, CASE WHEN r < 0.8 THEN 'sub-Earth' WHEN r < 1.25 THEN 'Earth-like' WHEN r < 2 THEN 'super-Earth' WHEN r < 3.5 THEN 'sub-Neptune' WHEN r < 6 THEN 'Neptune' WHEN r < 1000 THEN 'giant' END AS size,
  CASE WHEN value - 50 > 50 THEN 'retained' WHEN value - 50 > 10 THEN 'partially_retained' WHEN value - 50 >= -10 THEN 'snapped_back' ELSE 'declined' END AS attention,
  CASE WHEN value > 20 AND r > 20 THEN 'permanent_shift' WHEN value > 20 THEN 'science_continues' WHEN r > 20 THEN 'lingering_interest' ELSE 'flash_event' END AS alignment FROM e""")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", K.planet_type(v / 10).alias("planet"), K.period_bin(v).alias("period"), K.star_class(v * 20).alias("star"),
                           K.depth_class(v).alias("depth"), K.size_category(v / 10).alias("size"), K.attention_class(v - 50).alias("attention"), K.alignment_class(v, v / 10).alias("alignment"))


@query("k05_zone", """
WITH e AS (SELECT event_id, value * 30 + 2000 AS teff, value / 40 + 0.01 AS lum, value / 60 + 0.05 AS d FROM events),
f AS (SELECT *, CASE WHEN teff BETWEEN 2600 AND 7200 THEN 1.0385 + 1.2456e-4 * (teff - 5780) + 1.4612e-8 * pow(teff - 5780, 2) - 7.6345e-12 * pow(teff - 5780, 3) - 1.7511e-15 * pow(teff - 5780, 4) END AS fi,
  CASE WHEN teff BETWEEN 2600 AND 7200 THEN 0.3507 + 5.9578e-5 * (teff - 5780) + 1.6707e-9 * pow(teff - 5780, 2) - 3.0058e-12 * pow(teff - 5780, 3) - 5.1925e-16 * pow(teff - 5780, 4) END AS fo FROM e)
SELECT event_id, round(sqrt(lum / fi), 6) AS inner_au, round(sqrt(lum / fo), 6) AS outer_au, CASE WHEN d < sqrt(lum / fi) THEN 'too_hot' WHEN d > sqrt(lum / fo) THEN 'too_cold' WHEN fi IS NOT NULL THEN 'inside' END AS zone FROM f""")
def _(t):
    teff, lum, d = F.col("value") * 30 + 2000, F.col("value") / 40 + 0.01, F.col("value") / 60 + 0.05
    a, b = (K.zone_distance(lum, K.zone_flux(teff, n)) for n in ("runaway_greenhouse", "maximum_greenhouse"))
    return t.events.select("event_id", F.round(a, 6).alias("inner_au"), F.round(b, 6).alias("outer_au"), K.zone_class(d, a, b).alias("zone"))


@query("k06_coast_region", """
WITH s AS (SELECT s_suppkey, list_extract(['MI', 'PA', 'FL', 'TX', 'CA', 'AK', 'HI', 'GU', 'NY', 'MARSHALL ISLANDS', 'ZZ'], CAST(s_suppkey % 11 + 1 AS BIGINT)) AS st, s_acctbal / 200 AS la, -s_acctbal / 60 AS lo FROM supplier)
SELECT s_suppkey, CASE WHEN st = 'MI' OR (st = 'PA' AND la > 41.5) THEN 'Great Lakes' WHEN st = 'PA' THEN 'Atlantic' WHEN st = 'AK' THEN 'Alaska' WHEN st = 'HI' THEN 'Hawaii/Pacific Islands'
  WHEN st = 'FL' AND lo < -82 THEN 'Gulf' WHEN st = 'FL' THEN 'Atlantic' WHEN st = 'GU' THEN 'Territories' WHEN st LIKE '%MARSHALL%' THEN 'Pacific Islands' WHEN st = 'NY' THEN 'Atlantic' WHEN st = 'TX' THEN 'Gulf' WHEN st = 'CA' THEN 'Pacific'
  WHEN lo > 100 THEN 'Pacific Islands' WHEN lo > -67 AND lo < 0 AND la > 24 THEN 'Atlantic' WHEN lo < -80 AND la > 24 AND la < 31 THEN 'Gulf' ELSE 'Other' END AS coast FROM s""")
def _(t):
    codes = F.array(*[F.lit(c) for c in ["MI", "PA", "FL", "TX", "CA", "AK", "HI", "GU", "NY", "MARSHALL ISLANDS", "ZZ"]])
    state = F.element_at(codes, (F.col("s_suppkey") % 11 + 1).cast("int"))
    return t.supplier.select("s_suppkey", K.coast_region(state, F.col("s_acctbal") / 200, -F.col("s_acctbal") / 60).alias("coast"))


@query("k07_growth_class", """
WITH y AS (SELECT o_custkey, count(*) FILTER (year(o_orderdate) = 1995) AS a, count(*) FILTER (year(o_orderdate) = 2000) AS b FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a < 2 AND b >= 2 THEN 'emerged' WHEN a >= 2 AND b < 2 THEN 'disappeared' WHEN a > 0 AND b > 0 AND pow(b * 1.0 / a, 0.2) - 1 > 0.02 THEN 'growing'
  WHEN a > 0 AND b > 0 AND pow(b * 1.0 / a, 0.2) - 1 < -0.02 THEN 'declining' ELSE 'stable' END AS growth FROM y""")
def _(t):
    y = t.orders.groupBy("o_custkey").agg(F.count_if(F.year("o_orderdate") == 1995).alias("a"), F.count_if(F.year("o_orderdate") == 2000).alias("b"))
    return y.select("o_custkey", K.growth_class(F.col("a"), F.col("b"), 5, 2).alias("growth"))


@query("k08_identifiers", r"""
SELECT page_id, CASE WHEN url LIKE 'https://%' THEN split_part(url, 'example.net/', -1) ELSE url END AS short_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?!]', '', 'g'),
   '\b(what|how|why|when|where|which|is|are|the|a|an|of|in|on|for|to)\b', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  translate(lower(split_part(html, '</title>', 1)), 'áàâäãéèêëíìîïóòôöõúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn') AS folded FROM pages""")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", K.short_id(u, "example.net/").alias("short_id"), K.slug(u).alias("slug"), K.ascii_fold(F.lower(F.split_part("html", F.lit("</title>"), F.lit(1)))).alias("folded"))


@query("k09_stars_missing", """
SELECT event_id, CASE WHEN value / 300 < 0.001 THEN '***' WHEN value / 300 < 0.01 THEN '**' WHEN value / 300 < 0.05 THEN '*' ELSE '' END AS stars, value IS NULL OR isnan(value) AS missing FROM events""")
def _(t):
    return t.events.select("event_id", K.stars(F.col("value") / 300).alias("stars"), K.is_missing(F.col("value")).alias("missing"))


@query("k10_request_key", """
SELECT event_id, sha256(concat_ws('&', 'https://api.example.org/items', concat('k=', json_extract_string(props, '$.k')), concat('type=', event_type), concat('user=', user_id))) AS request_key FROM events""")
def _(t):
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return t.events.select("event_id", K.request_key(F.lit("https://api.example.org/items"), params).alias("request_key"))


@query("k11_parse_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.date_format(d, "d MMM yyyy"))
            .when(k == 3, F.date_format(d, "yyyy/MM/dd")).when(k == 4, F.concat(F.lit("updated on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" at noon")))
            .otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return t.orders.select("o_orderkey", F.date_format(K.parse_any_date(text), "yyyy-MM-dd").alias("day"))


@query("k12_month_key", """
SELECT month, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT strftime(ts, '%Y-%m') AS month, value FROM events) GROUP BY 1""")
def _(t):
    stamp = F.date_format("ts", "yyyyMMddHH")
    return t.events.groupBy(K.month_key(stamp).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("k13_scenario_grid", f"""
WITH {MONTHLY}, b AS (SELECT nation, round(sum(value) / 1e6, 4) AS base FROM monthly WHERE yr = 2000 GROUP BY 1), sc(name, delta) AS (VALUES ('down', -1.0), ('unchanged', 0.0), ('up', 1.0)),
y AS (SELECT unnest(range(2025, 2036)) AS yr)
SELECT nation, name AS scenario, yr, round(base * greatest(13 - greatest((yr - 2021) + 13 - 10, 0), 0) / 10.0 * (1.5 + delta) / 100, 8) AS cost
FROM b, sc, y""")
def _(t):
    from seriesloom.operators.portfolio import scenario_grid
    base = monthly(t).filter("yr = 2000").groupBy("nation").agg(F.round(F.sum("value") / 1e6, 4).alias("base"))
    out = scenario_grid(base, "base", F.lit(1.5), 10, [("down", -1.0), ("unchanged", 0.0), ("up", 1.0)], range(2025, 2036), 2021, 13)
    return out.select("nation", "scenario", F.col("yr").cast("bigint").alias("yr"), F.round("cost", 8).alias("cost"))
