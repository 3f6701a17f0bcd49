"""How far indicators hold when effort or images are fewer, and change against the same season of earlier years."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.functions.random import uniform
from ecoframe.operators.skew import PIECE, rank_by_uniform

#: Up to so many rows a rank Spark limits groups before it shuffles them (spark.sql.optimizer.windowGroupLimitThreshold).
MOST_LIMITED = 1000
#: Shares of the observations that stay.
LEVELS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)


def jaccard_at_effort(minutes: DataFrame, detections: DataFrame, reference: DataFrame, keys: Sequence[str], m: int, replicates: int,
                      seed="effort", portable: bool = False, pieces: int = 64) -> DataFrame:
    """Mean Jaccard distance of lists made of ``m`` minutes to a reference list, over ``replicates`` sub-samples.

    ``minutes`` has keys and minute (one row each), ``detections`` keys, minute and species, ``reference`` species (a list that is
    broadcast). In a replicate each minute has a draw, a hash of its coordinates, and the m smallest draws are the sub-sample. Minutes
    and detections meet in one shuffle by their keys, and the draws, one for each minute and replicate, are made and ranked there, as
    an array for one replicate at a time, so they are neither sorted nor shuffled. Keys with over ``PIECE`` minutes are dealt in pieces,
    and the m least draws of each piece are ranked together. Keys with fewer than ``m`` minutes can't reach the effort: their
    distance is NULL.
    """
    keys, every_replicate = list(keys), F.sequence(F.lit(0), F.lit(replicates - 1))
    known = reference.select("species").distinct()
    size = known.agg(F.count(F.lit(1)).alias("_reference"))
    large = minutes.groupBy(*keys).agg(F.count(F.lit(1)).alias("minutes")).where(F.col("minutes") > PIECE)
    listed = large.select(*[F.col(k).alias(f"_large_{k}") for k in keys], F.ceil(F.col("minutes") / PIECE).cast("int").alias("_large"))

    # Both kinds of rows under one exchange; a key or minute that is null has no detections.
    types = {f.name: f.dataType for f in minutes.select(*keys, "minute").schema}
    same = [F.col(c).isNotNull() if detections.schema[c].dataType == t else F.col(c).try_cast(t) == F.col(c) for c, t in types.items()]
    heard = detections.where(reduce(and_, same)).join(
        F.broadcast(known.withColumnRenamed("species", "_known")), F.col("species") == F.col("_known"), "left")
    rows = minutes.select(*keys, "minute", F.lit(1).alias("_n"), F.lit(None).cast(known.schema["species"].dataType).alias("_known"),
                          F.lit(None).cast(detections.schema["species"].dataType).alias("_other"), F.lit(0).alias("_unnamed")).unionByName(
        heard.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()], F.lit(0).alias("_n"), "_known",
                     F.when(F.col("_known").isNull(), F.col("species")).alias("_other"), F.col("species").isNull().cast("int").alias("_unnamed")))
    here = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys], F.lit(True))
    rows = rows.join(F.broadcast(listed), here, "left").withColumn("_pieces", F.coalesce("_large", F.lit(1))).select(
        *rows.columns, "_pieces", F.pmod(F.xxhash64("minute"), F.col("_pieces")).alias("_piece"))
    # The number of pieces is an aggregate so that neither use of this is filtered below the exchange, which both read.
    own = rows.repartition(*keys, "_piece").groupBy(*keys, "_piece", "minute").agg(
        F.max("_pieces").alias("_pieces"), F.collect_set("_known").alias("_known"), F.collect_set("_other").alias("_other"),
        F.max("_unnamed").alias("_unnamed"), F.sum("_n").cast("int").alias("_n")).select("*", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy"))

    def least(of: DataFrame) -> DataFrame:
        """For each piece the least m draws of all replicates, as places in its list of minutes."""
        lists = of.groupBy(*keys, "_piece").agg(F.collect_list(F.struct("minute", "_known", "_other", "_unnamed")).alias("_minutes"))
        draw = lambda r, x: uniform(seed, *[F.col(k) for k in keys], r, x["minute"], portable=portable)
        ranked = lambda r: F.slice(F.array_sort(F.transform("_minutes", lambda x, i: F.struct(
            draw(r, x).alias("_u"), x["minute"].alias("minute"), i.alias("_at")))), 1, m)
        return lists.select("*", F.posexplode(F.transform(every_replicate, ranked)).alias("_place", "_least")).withColumn(
            "replicate", F.get(every_replicate, F.col("_place")))

    at = lambda y: F.get("_minutes", y["_at"])
    distinct = lambda name: F.size(F.array_distinct(F.flatten(F.transform("_least", lambda y: at(y)[name]))))
    one = least(own.where(F.col("_pieces") == 1)).select(
        *keys, F.size("_minutes").cast("bigint").alias("minutes"), distinct("_known").alias("_common"),
        (distinct("_known") + distinct("_other") + F.exists("_least", lambda y: at(y)["_unnamed"] == 1).cast("int")).alias("_own"))

    drawn = least(own.where(F.col("_pieces") > 1)).select(*keys, "replicate", F.inline(F.transform("_least", lambda y: F.struct(
        y["_u"].alias("_u"), y["minute"].alias("minute"), at(y).alias("_heard")))))
    if m <= MOST_LIMITED:
        order = Window.partitionBy(*keys, "replicate").orderBy("_u", "minute")
        chosen = drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= m)
    else:
        chosen = rank_by_uniform(drawn, [*keys, "replicate"], "_u", ["minute"], "_rank", pieces).where(F.col("_rank") < m)
    named = lambda name, is_known: F.transform(f"_heard.{name}", lambda s: F.struct(s.alias("species"), F.lit(is_known).alias("_in")))
    unnamed = F.array_repeat(F.struct(F.lit(None).cast(detections.schema["species"].dataType).alias("species"), F.lit(0).alias("_in")), F.col("_heard._unnamed"))
    counts = chosen.select(*keys, "replicate", F.inline(F.concat(named("_known", 1), named("_other", 0), unnamed))).distinct().groupBy(
        *keys, "replicate").agg(F.sum("_in").alias("_common"), F.count(F.lit(1)).alias("_own"))
    many = large.withColumn("replicate", F.explode(every_replicate)).join(counts.hint("merge"), [*keys, "replicate"], "left").select(
        *keys, "minutes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_common", "_own")])

    every = one.unionByName(many).join(F.broadcast(size))
    union = F.col("_own") + F.col("_reference") - F.col("_common")
    distance = F.when(union == 0, 0.0).otherwise(1 - F.col("_common") / union)
    return every.groupBy(*keys).agg(
        F.max("minutes").alias("minutes"), F.when(F.max("minutes") >= m, F.avg(distance)).alias("distance"),
        F.when(F.max("minutes") >= m, F.stddev_pop(distance)).alias("spread"))


def gap_levels(series: DataFrame, keys: Sequence[str], value: str, quarter: str, tie: Sequence[str], levels: Sequence[float] = LEVELS,
               seed="gaps", portable: bool = False) -> DataFrame:
    """Median and robust amplitude of a series when images get lost, at random and by whole quarters, for all levels in one pass.

    Thinning is nested: an observation has one draw, and stays at a level if the draw is below the share that stays; likewise a
    quarter of a series. A series is bounded by its window of time, so its quantiles are plain aggregates of one group.
    """
    keys = list(keys)
    coordinates = [F.col(k) for k in keys]
    rows = series.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), uniform(seed, F.lit("random"), *coordinates, *[F.col(t) for t in tie], portable=portable).alias("_one"),
        uniform(seed, F.lit("quarter"), *coordinates, F.col(quarter), portable=portable).alias("_all"))
    modes = {"random": "_one", "quarter": "_all"}
    stays = {(mode, level): F.when(F.col(draw) < level, F.col("_v")) for mode, draw in modes.items() for level in levels}
    counted = rows.groupBy(*keys).agg(*[
        F.struct(F.lit(mode).alias("mode"), F.lit(float(level)).alias("level"), F.count(v).alias("n"),
                 F.percentile(v, 0.5).alias("median"), (F.percentile(v, 0.9) - F.percentile(v, 0.1)).alias("amplitude")).alias(f"_{i}")
        for i, ((mode, level), v) in enumerate(stays.items())])
    return counted.select(*keys, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(stays))])))


def quarter_anomaly(series: DataFrame, keys: Sequence[str], value: str, year: str, quarter: str) -> DataFrame:
    """Median of each quarter and its difference to the mean of the same quarter in earlier years and in all other years.

    One row per key, year and quarter with an observation; without earlier (other) years the anomaly is NULL. The climatology
    never holds the year that it judges.
    """
    keys = list(keys)
    medians = series.where(F.col(value).isNotNull()).groupBy(*keys, year, quarter).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(value, 0.5).alias("median"))
    by_year = Window.partitionBy(*keys, quarter).orderBy(year)
    before, after = by_year.rangeBetween(Window.unboundedPreceding, -1), by_year.rangeBetween(1, Window.unboundedFollowing)
    n = lambda w: F.count("median").over(w)
    total = lambda w: F.coalesce(F.sum("median").over(w), F.lit(0.0))
    return medians.select(
        *keys, year, quarter, "n", "median", n(before).alias("earlier_years"),
        (F.col("median") - F.avg("median").over(before)).alias("anomaly"),
        (F.col("median") - F.try_divide(total(before) + total(after), n(before) + n(after))).alias("anomaly_all_years"))
