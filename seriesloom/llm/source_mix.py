"""Mixing sources to target weights with Efraimidis-Spirakis keys and word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import SPACES, WORD, packed, stored, whole

SIGNS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
REPEAT_LIMIT = 3
LEVEL = 1024


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """0.5 to 1.5: half plus the share of characters in words that are no ASCII digits or signs."""
    chars = F.char_length(F.translate(text, SPACES, ""))
    return F.lit(0.5) + F.char_length(F.translate(text, SPACES + SIGNS, "")) / F.greatest(chars, F.lit(1))


def sampling_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """An exponential variable of rate `quality`, from a digest of seed and id: the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(uniform) / quality


def targets(sizes: DataFrame, limit: int = REPEAT_LIMIT) -> DataFrame:
    """source, source_size, mean_quality -> with target: words by weight, at most `limit` times the source.

    Sources in code point order (null last) weigh 1, 2, 3, 1, ... Ordered by limit over weight, a source is capped when
    the level at its place, what is left for the uncapped over their weights, exceeds that ratio. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cap = F.lit(float(limit)) * F.col("source_size")
    ranked = sizes.withColumn("weight", 1 + (place - 1) % 3).withColumn("cap", cap).withColumn("ratio", cap / F.col("weight"))
    everything = Window.partitionBy()
    here = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(here), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(here), F.lit(0))
    level = ranked.withColumn("level", left / weights).withColumn("capped", F.col("level") > F.col("ratio"))
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return level.select("source", "source_size", "mean_quality",
                        F.when(F.col("capped"), F.col("cap")).otherwise(common * F.col("weight")).alias("target"))


def _boundary(rows: DataFrame, plan: DataFrame, bucket: str) -> DataFrame:
    """Per source, the bucket in which the running size passes the budget, and the size before it.

    At most 1,024 rows a source reach the window: sizes are summed by bucket first.
    """
    sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("in_bucket"))
    run = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)))
    p = plan.select(F.col("source").alias("of"), "budget", F.col("ahead").alias("start"))
    joined = base.join(p, base["source"].eqNullSafe(p["of"])).withColumn("ahead", F.col("start") + F.col("ahead"))
    hit = (F.col("ahead") <= F.col("budget")) & (F.col("budget") < F.col("ahead") + F.col("in_bucket"))
    return joined.where(hit).select("source", F.col(bucket).alias("stop"), "ahead")


def mixing_plan(docs: DataFrame, seed: int = 17, limit: int = REPEAT_LIMIT) -> DataFrame:
    """source, source_size, target, epochs and the cut of the fractional pass for each source.

    `docs` has source, doc_id, size, quality. Complete epochs precede the fractional pass, which takes documents in key
    order while each brings the total nearer to the budget. A key is placed by two bucket levels of 1,024; only the
    bucket in which the budget ends, about a millionth of a source, is sorted. Rows with equal key, id and size are
    taken or left together.
    """
    slim = docs.select("source", "doc_id", "size", "quality", sampling_key(F.col("doc_id"), F.col("quality"), seed).alias("key"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("quality").alias("mean_quality"))
    plan = targets(sizes, limit)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
                  .withColumn("ahead", F.lit(0).cast("long")), "mix-plan")
    mean = plan.select(F.col("source").alias("of"), "mean_quality")
    scaled = F.col("key") * F.col("mean_quality")
    spot = F.floor(scaled / (1 + scaled) * (LEVEL * LEVEL)).cast("long")
    spots = slim.join(mean, slim["source"].eqNullSafe(mean["of"])).select(
        "source", "doc_id", "size", "key", F.floor(spot / LEVEL).alias("coarse"), (spot % LEVEL).alias("fine"))
    first = stored(_boundary(spots, plan, "coarse"), "mix-coarse")

    def inside(rows: DataFrame, edge: DataFrame, bucket: str) -> DataFrame:
        e = edge.select(F.col("source").alias("of"), F.col("stop"))
        return rows.join(e, rows["source"].eqNullSafe(e["of"]) & (rows[bucket] == e["stop"])).drop("of", "stop")

    budgets = plan.select(F.col("source").alias("of"), "budget")
    near = stored(inside(spots, first, "coarse"), "mix-near")
    step = first.join(budgets, first["source"].eqNullSafe(budgets["of"])).drop("of")
    second = stored(_boundary(near, step, "fine"), "mix-fine")
    last = inside(near, second, "fine").groupBy("source", "key", "doc_id", "size").agg(F.sum("size").alias("group_size"))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    tail = second.join(budgets, second["source"].eqNullSafe(budgets["of"])).select("of", "budget", "ahead")
    chosen = last.withColumn("before", F.coalesce(F.sum("group_size").over(run), F.lit(0))).join(
        tail, F.col("source").eqNullSafe(F.col("of"))).where(
        2 * (F.col("ahead") + F.col("before")) + F.col("group_size") <= 2 * F.col("budget"))
    cut = chosen.groupBy(F.col("source").alias("of")).agg(F.max(F.struct("key", "doc_id", "size")).alias("cut"))
    edge = first.select(F.col("source").alias("of1"), F.col("stop").alias("coarse_stop"))
    fine = second.select(F.col("source").alias("of2"), F.col("stop").alias("fine_stop"))
    out = (plan.join(edge, plan["source"].eqNullSafe(edge["of1"]), "left").join(fine, plan["source"].eqNullSafe(fine["of2"]), "left")
           .join(cut, plan["source"].eqNullSafe(cut["of"]), "left"))
    return out.select(F.col("source").alias("of"), "source_size", "mean_quality", "target", "epochs", "coarse_stop", "fine_stop", "cut")


def mixed(docs: DataFrame, seed: int = 17, limit: int = REPEAT_LIMIT, doc_id: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """row (the input row), doc_id, size, source_size, target, copies, taken for each row of `docs`.

    Null texts have size 0; a null source is a source of its own. Whole documents are taken, each `copies` times, so a
    source misses its target by half a document at most, and no document exceeds `limit` times its size. Identical runs
    agree. The plan has a row per source, and Spark broadcasts it only while its stored size permits.
    """
    slim = stored(docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"),
                              size_of(whole(text)).alias("size"), quality_of(whole(text)).alias("quality")), "mix-rows")
    plan = stored(mixing_plan(slim, seed, limit), "mix-cuts")
    rows = packed(docs, F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), whole(text).alias("body"))
    rows = rows.select("row", "source", "doc_id", size_of(F.col("body")).alias("size"),
                       sampling_key(F.col("doc_id"), quality_of(F.col("body")), seed).alias("key"))
    return taken(rows, plan, "row")


def taken(rows: DataFrame, plan: DataFrame, *keep: str) -> DataFrame:
    scaled = F.col("key") * F.col("mean_quality")
    spot = F.floor(scaled / (1 + scaled) * (LEVEL * LEVEL)).cast("long")
    coarse, fine = F.floor(spot / LEVEL), spot % LEVEL
    edge = F.col("coarse_stop").isNotNull() & (coarse == F.col("coarse_stop"))
    inner = edge & F.col("fine_stop").isNotNull() & (fine == F.col("fine_stop"))
    chosen = (F.when(F.col("coarse_stop").isNull(), False).when(~edge, coarse < F.col("coarse_stop"))
              .when(~inner, fine < F.coalesce(F.col("fine_stop"), F.lit(LEVEL)))
              .otherwise(F.coalesce(F.struct("key", "doc_id", "size") <= F.col("cut"), F.lit(False))))
    copies = F.col("epochs") + chosen.cast("long")
    return rows.join(plan, rows["source"].eqNullSafe(plan["of"])).select(
        *keep, "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_report(docs: DataFrame, seed: int = 17, limit: int = REPEAT_LIMIT, doc_id: str = "doc_id", text: str = "text",
               source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row, as `mixed`, reading each text once."""
    slim = stored(docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"),
                              size_of(whole(text)).alias("size"), quality_of(whole(text)).alias("quality")), "mix-rows")
    plan = stored(mixing_plan(slim, seed, limit), "mix-cuts")
    rows = slim.withColumn("key", sampling_key(F.col("doc_id"), F.col("quality"), seed))
    return taken(rows, plan)


def mix_rows(docs: DataFrame, seed: int = 17, limit: int = REPEAT_LIMIT) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as its copies, with its columns."""
    rows = mixed(docs, seed, limit).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select("row.*")
