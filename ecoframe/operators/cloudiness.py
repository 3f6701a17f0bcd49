"""Cloudiness of points and landscapes: coverage per point, summaries by slice, clean observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions.scalars import period_index, scl_valid, year_month
from ecoframe.operators.quantiles import Quantile, exact_quantiles
from ecoframe.operators.raster import BLOCK_SIZE, sample

RULES = tuple(C.RULE_LABELS)


def by_rule(series: DataFrame, rules=RULES) -> DataFrame:
    """The boolean rule columns as rows (rule, ok): all rules are then summarised in one pass."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(False)).alias("ok")) for r in rules])
    return series.withColumn("_r", F.explode(pairs)).select("_r.rule", "_r.ok", *[
        c for c in series.columns if c not in rules])


def _quarter_bits(ok, quarter):
    return F.coalesce(F.bit_count(F.bit_or(F.when(ok, F.pow(F.lit(2), quarter - 1).cast("int")))),
                      F.lit(0)).cast("int")


def point_coverage(series: DataFrame, rules=RULES) -> DataFrame:
    """Valid composites and distinct calendar quarters per point, and whether the coverage rule passes.

    This variant judges the point's own pixel and uses calendar quarters of the observation date.
    """
    grouped = by_rule(series, rules).groupBy("rule", "landscape", "point").agg(
        F.count_if("ok").alias("valid_n"),
        _quarter_bits(F.col("ok"), F.quarter("observation_date")).alias("quarters_with_valid"))
    return grouped.withColumn("passes", (F.col("valid_n") >= C.MIN_VALID_COMPOSITES)
                              & (F.col("quarters_with_valid") == C.QUARTERS))


def cloudiness_summary(series: DataFrame, rules=RULES) -> DataFrame:
    """Per rule: each landscape, all points, and each quarter (by composite start; fraction only)."""
    labels = F.create_map(*[F.lit(x) for pair in C.RULE_LABELS.items() for x in pair])
    quartered = by_rule(series, rules).withColumn("quarter", F.quarter("composite_start"))
    sets = [["rule", "landscape"], ["rule"], ["rule", "quarter"]]
    fractions = quartered.groupingSets(
        [[F.col(c) for c in s] for s in sets], "rule", "landscape", "quarter").agg(
        F.avg(F.col("ok").cast("int")).alias("valid_fraction"),
        F.grouping("landscape").alias("_gl"), F.grouping("quarter").alias("_gq"))
    slice_ = (F.when(F.col("_gl") == 0, F.col("landscape"))
              .when(F.col("_gq") == 0, F.concat(F.lit(C.SLICE_QUARTER + " "), F.col("quarter")))
              .otherwise(C.SLICE_ALL))

    # the counts of the points, once per landscape and once for all
    points = point_coverage(series, rules)
    sliced = points.withColumn("slice", F.explode(F.array(F.col("landscape"), F.lit(C.SLICE_ALL))))
    counts = sliced.groupBy("rule", "slice").agg(
        F.min("valid_n").alias("valid_min"), F.max("valid_n").alias("valid_max"),
        F.concat(F.count_if("passes").cast("string"), F.lit(C.PASS_SEPARATOR),
                 F.count(F.lit(1)).cast("string")).alias("points_passing"))
    medians = exact_quantiles(sliced, ["rule", "slice"], [Quantile("valid_median", F.col("valid_n"), 0.5)])
    return (fractions.withColumn("slice", slice_)
            .join(counts.join(medians, ["rule", "slice"]), ["rule", "slice"], "left")
            .select(labels[F.col("rule")].alias("rule"), "slice", "valid_fraction", "valid_median", "valid_min",
                    "valid_max", "points_passing"))


def scene_readings(found: DataFrame, points: DataFrame, rasters: DataFrame, blocks: DataFrame,
                   block_size: int = BLOCK_SIZE) -> DataFrame:
    """Class of every point in every scene found over its area; NULL outside the scene's raster and where it is 0 or nodata.

    ``found`` has area, item_id, day, scene_cloud_pct and href (of the class raster), as
    :func:`ecoframe.operators.raster.items_over_areas` gives them; ``points`` has area, point and x, y in the rasters' system.
    """
    pairs = found.select("area", "item_id", "day", "scene_cloud_pct", "href").join(
        points.select("area", "point", "x", "y"), "area")
    return sample(pairs, rasters, blocks, block_size).select(
        "item_id", "point", "day", "scene_cloud_pct", F.col("value").cast("int").alias("scl"))


def scene_counts(found: DataFrame) -> DataFrame:
    """One row: distinct scenes found, and the median of their cloud shares."""
    scenes = found.groupBy("item_id").agg(F.min("scene_cloud_pct").alias("scene_cloud_pct"))
    return exact_quantiles(scenes.withColumn("_one", F.lit(1)), ["_one"], [
        Quantile("scene_cloud_median", F.col("scene_cloud_pct"), 0.5)], others=[F.count(F.lit(1)).alias("scenes")])


def daily_observations(readings: DataFrame, first_day: str) -> DataFrame:
    """One observation per point and day, valid if any reading is; readings without a class are dropped.

    Neighbouring tiles and reprocessings repeat a pass: a group is these few readings, so its median is a plain one, and
    where nobody reads it, it isn't computed. Adds the 16-day period index and the month.
    """
    daily = readings.where(F.col("scl").isNotNull()).groupBy("point", "day").agg(
        F.bool_or(scl_valid(F.col("scl"))).alias("valid"), F.median("scene_cloud_pct").alias("scene_cloud_pct"))
    return daily.select(
        "point", "day", "valid", "scene_cloud_pct",
        period_index(F.col("day"), F.to_date(F.lit(first_day))).alias("period16"), year_month(F.col("day")).alias("month"))


def clean_per_point(daily: DataFrame) -> DataFrame:
    """Observations, clean ones and periods with a clean one, per point."""
    per_period = daily.groupBy("point", "period16").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("valid").alias("_clean"))
    return per_period.groupBy("point").agg(
        F.sum("_n").alias("observations"), F.sum("_clean").alias("clean"),
        F.count_if(F.col("_clean") > 0).alias("periods_with_clean"))


def clean_per_month(daily: DataFrame) -> DataFrame:
    return daily.groupBy("month").agg(F.count_if("valid").alias("clean"))


def observation_summary(daily: DataFrame, first_day: str, last_day: str, found: DataFrame | None = None) -> DataFrame:
    """One row: clean fraction, spread of clean counts and periods over the points, months without a clean one.

    With ``found``, the scenes behind the observations, also their number and the median of their cloud shares.
    """
    points = clean_per_point(daily)
    one = F.lit(1).alias("_one")
    quantiles = exact_quantiles(points.select("*", one), ["_one"], [
        Quantile("clean_median", F.col("clean"), 0.5), Quantile("periods_median", F.col("periods_with_clean"), 0.5)])
    ranges = points.groupBy(one).agg(
        F.min("clean").alias("clean_min"), F.max("clean").alias("clean_max"),
        F.min("periods_with_clean").alias("periods_min"), F.max("periods_with_clean").alias("periods_max"))
    fraction = daily.groupBy(one).agg(F.avg(F.col("valid").cast("int")).alias("clean_fraction"))
    months = clean_per_month(daily).groupBy(one).agg(F.array_join(F.array_sort(F.collect_list(
        F.when(F.col("clean") == 0, F.col("month")))), ",").alias("months_without_clean"))
    total = F.floor((F.datediff(F.to_date(F.lit(last_day)), F.to_date(F.lit(first_day))) + 1) / C.COMPOSITE_DAYS)
    row = fraction.join(ranges, "_one").join(quantiles, "_one").join(months, "_one")
    if found is not None:
        row = row.join(scene_counts(found), "_one")
    return row.select(
        *(["scenes", "scene_cloud_median"] if found is not None else []), "clean_fraction", "clean_median", "clean_min", "clean_max", total.cast("int").alias("periods_total"),
        "periods_median", "periods_min", "periods_max", "months_without_clean")


def status_table(rows: DataFrame) -> DataFrame:
    """Site × status counts with every status as a column."""
    return rows.groupBy("site").agg(*[F.count_if(F.col("status") == s).alias(s) for s in C.STATUSES])
