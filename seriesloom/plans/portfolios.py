"""Portfolio queries."""

from pyspark.sql import functions as F

from seriesloom.operators import portfolio as P
from seriesloom.plans.catalog import query
from seriesloom.plans.grouping import rounded
from seriesloom.plans.inputs import MONTHLY, monthly
from seriesloom.plans.windowing import long_cols

DATES = list(range(9500, 11500, 250))
SIGNAL = """sc AS (SELECT o_custkey AS k, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d, o_orderpriority AS kind, o_totalprice / 1000 AS s FROM orders),
dt AS (SELECT unnest(range(9500, 11500, 250)) AS as_of),
pk AS (SELECT as_of, k, kind, sum(s * exp(-ln(2) * (as_of - d - 2) / 90.0)) / sum(exp(-ln(2) * (as_of - d - 2) / 90.0)) AS sig FROM sc JOIN dt ON d + 2 <= as_of GROUP BY 1, 2, 3),
sg AS (SELECT as_of, k, round(avg(sig), 8) AS composite, count(*) AS n_kinds FROM pk GROUP BY 1, 2)"""


def signals(t):
    sc = t.orders.select(F.col("o_custkey").alias("k"), F.unix_date(F.col("o_orderdate").cast("date")).alias("d"), F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice") / 1000).alias("s"))
    return rounded(P.signals_as_of(sc, "k", "d", "kind", "s", DATES), 8, "composite")


@query("p01_signals", f"WITH {SIGNAL} SELECT as_of, k, composite, n_kinds FROM sg")
def _(t):
    return long_cols(signals(t), "as_of")


@query("p02_quantile_buckets", f"""
WITH {SIGNAL} SELECT as_of, k, CAST(ntile(5) OVER (PARTITION BY as_of ORDER BY composite DESC, k) AS INTEGER) AS bucket FROM sg""")
def _(t):
    return long_cols(P.quantile_buckets(signals(t), ["as_of"], "composite", "k"), "as_of").select("as_of", "k", "bucket")


#: The first month that the orders do not cover to its last day.
LAST_SQL = "(SELECT (year(max(o_orderdate) + INTERVAL 1 DAY) - 1995) * 12 + month(max(o_orderdate) + INTERVAL 1 DAY) - 1 FROM orders)"
MRETN = f"""{MONTHLY}, rt AS (SELECT nation, mi, value / lag(value) OVER (PARTITION BY nation ORDER BY mi) - 1 AS r FROM monthly WHERE mi < {LAST_SQL}),
ew AS (SELECT mi, avg(r) AS ew_return, count(r) AS n_members FROM rt WHERE r IS NOT NULL GROUP BY 1)"""


def nation_returns(t):
    from seriesloom.operators.windows import by_time
    after = F.date_add(F.max("o_orderdate"), 1)
    open_month = t.orders.agg(((F.year(after) - 1995) * 12 + F.month(after) - 1).alias("m")).scalar()
    m = monthly(t).filter(F.col("mi") < open_month)
    return m.select("nation", "mi", (F.col("value") / F.lag("value").over(by_time(["nation"], "mi")) - 1).alias("r")).filter("r is not null")


@query("p03_benchmark", f"""
WITH {MRETN} SELECT count(*) AS n, round(sum(ln(1 + ew_return)), 8) AS log_total, round(pow(exp(sum(ln(1 + ew_return))), 12.0 / count(*)) - 1, 6) AS annualised,
  round(avg(ew_return) / stddev_samp(ew_return) * sqrt(12), 6) AS sharpe FROM ew""")
def _(t):
    ew = P.equal_weight(nation_returns(t), "mi", "r")
    perf = P.performance(ew, [], "ew_return", F.col("n") / 12).withColumn("log_total", F.log1p("total_return")).drop("total_return")
    return rounded(rounded(perf, 6, "annualised", "sharpe"), 8, "log_total")


@query("p04_comparison", f"""
WITH {MRETN}, st AS (SELECT mi, avg(r) AS s FROM rt WHERE r IS NOT NULL AND nation < 5 GROUP BY 1)
SELECT mi, round(s, 8) AS strategy, round(ew_return, 8) AS benchmark, s > ew_return AS won, round(ln(10000) + sum(ln(1 + s)) OVER (ORDER BY mi), 8) AS log_equity,
  round(ln(10000) + sum(ln(1 + ew_return)) OVER (ORDER BY mi), 8) AS log_benchmark FROM st JOIN ew USING (mi)""")
def _(t):
    r = nation_returns(t)
    out = P.comparison(P.equal_weight(r.filter("nation < 5"), "mi", "r"), P.equal_weight(r, "mi", "r"), "mi", "ew_return", "ew_return")
    out = out.withColumns({"log_equity": F.log("equity"), "log_benchmark": F.log("benchmark_equity")}).drop("equity", "benchmark_equity")
    return long_cols(rounded(out, 8, "strategy", "benchmark", "log_equity", "log_benchmark"), "mi")


@query("p04_drawdown", f"""
WITH {MRETN}, e AS (SELECT mi, exp(sum(ln(1 + ew_return)) OVER (ORDER BY mi)) AS q FROM ew)
SELECT round(min(q / m - 1), 8) AS max_drawdown FROM (SELECT q, max(q) OVER (ORDER BY mi) AS m FROM e)""")
def _(t):
    ew = P.equal_weight(nation_returns(t), "mi", "r")
    eq = P.comparison(ew, ew, "mi", "ew_return", "ew_return")
    return rounded(P.drawdown(eq, "mi", "equity"), 8, "max_drawdown")


@query("p05_config_grid", f"""
WITH {MONTHLY}, rt AS (SELECT c_mktsegment AS seg, o_orderpriority AS pri, o_orderstatus AS st, strftime(o_orderdate, '%Y-%m') AS ym, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
g AS (SELECT seg, pri, st, round(avg(v) / stddev_samp(v) * sqrt(12), 8) AS sharpe FROM rt GROUP BY 1, 2, 3)
SELECT seg, pri, st, round(avg(sharpe), 6) AS mean_sharpe, count(*) AS n FROM g GROUP BY GROUPING SETS ((seg), (pri), (st))""")
def _(t):
    ym = F.date_format("o_orderdate", "yyyy-MM").alias("ym")
    rt = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("st"), ym).agg(F.sum("o_totalprice").alias("v"))
    g = rt.groupBy("seg", "pri", "st").agg(F.round(F.avg("v") / F.stddev_samp("v") * F.sqrt(F.lit(12.0)), 8).alias("sharpe"))
    return rounded(P.grid_summary(g, ["seg", "pri", "st"], "sharpe"), 6, "mean_sharpe")


@query("p06_signal_ranks", f"""
WITH {SIGNAL}, r AS (SELECT as_of, k, row_number() OVER (PARTITION BY as_of ORDER BY composite DESC, k) AS rank FROM sg) SELECT as_of, k, rank, as_of = (SELECT max(as_of) FROM sg) AS latest FROM r""")
def _(t):
    sg = signals(t)
    ranked = P.signal_ranks(sg, ["as_of"], "composite", "k")
    latest = sg.agg(F.max("as_of")).scalar()
    return long_cols(ranked.withColumn("latest", F.col("as_of") == latest).select("as_of", "k", "rank", "latest"), "as_of", "rank")


@query("p07_debt_projection", f"""
WITH {MONTHLY}, b AS (SELECT nation, round(sum(value) FILTER (yr = 2000), 2) AS debt, pow(round(sum(value) FILTER (yr = 2000), 2) / round(sum(value) FILTER (yr = 1996), 2), 0.25) - 1 AS g FROM monthly GROUP BY 1)
SELECT nation, y AS yr, round(debt * pow(1 + g, y - 2025), 3) AS projected_debt, round(least(3.1::DOUBLE + 0.15 * (y - 2025), 4.5), 6) AS projected_rate,
  round(debt * pow(1 + g, y - 2025) * least(3.1::DOUBLE + 0.15 * (y - 2025), 4.5) / 100, 3) AS projected_interest FROM b, (SELECT unnest(range(2026, 2036)) AS y)""")
def _(t):
    at = {y: F.round(F.sum(F.when(F.col("yr") == y, F.col("value"))), 2) for y in (1996, 2000)}
    b = monthly(t).groupBy("nation").agg(at[2000].alias("debt"), (F.pow(at[2000] / at[1996], F.lit(0.25)) - 1).alias("g")).withColumn("rate", F.lit(3.1))
    out = P.debt_projection(b, "debt", "g", "rate", range(2026, 2036), 2025).select("nation", "yr", "projected_debt", "projected_rate", "projected_interest")
    return long_cols(rounded(rounded(out, 3, "projected_debt", "projected_interest"), 6, "projected_rate"), "yr")
