"""Readings and summaries of simulated repetitions: coverage per interval method, and one row per study cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions.scalars import interval_covers, interval_reading


def with_readings(out: DataFrame, method: str = C.ADOPTED_METHOD, reachable: bool = True) -> DataFrame:
    """Coverage of both estimands per method, and the adopted interval with its reading."""
    for m in C.INTERVAL_METHODS:
        low, high = F.col(f"lower_{m}"), F.col(f"upper_{m}")
        covers = interval_covers(F.col("reachable_gain"), low, high) if reachable else F.lit(None).cast("boolean")
        out = out.withColumn(f"covers_population_{m}", interval_covers(F.col("true_gain"), low, high)).withColumn(
            f"covers_reachable_{m}", covers)
    estimate = F.col("gain_cv" if method == "cv_corrigido" else "gain_m3_m2b")
    low, high = F.col(f"lower_{method}"), F.col(f"upper_{method}")
    return (out.withColumn("method", F.lit(method)).withColumn("lower", low).withColumn("upper", high)
            .withColumn("width", high - low).withColumn("reading", interval_reading(estimate, low, high)))


CELL = ["block", "structure", "scenario", "n_properties"]


def summarise_cells(repetitions: DataFrame, by: list[str] = CELL) -> DataFrame:
    """One row per cell: mean gains, interval width and bias, coverage, rejection rate and reading shares.

    A cell's repetitions are bounded by the study design, so its exact medians are plain aggregates.
    """
    measures = [
        F.avg("true_gain").alias("true_gain_mean"), F.avg("true_gain_mse").alias("true_gain_mse_mean"),
        F.avg("reachable_gain").alias("reachable_gain_mean"), F.avg("gain_m3_m2b").alias("gain_mean"),
        F.stddev_samp("gain_m3_m2b").alias("gain_sd"), F.median("width").alias("width_median"),
        F.avg((F.col("lower") > 0).cast("int")).alias("lower_above_zero"),
        F.avg(F.coalesce(F.col("p_value") <= 0.05, F.lit(False)).cast("int")).alias("permutation_rejection_5pct"),
        F.median("mae_M2b").alias("mae_m2b_median")]
    for m in C.INTERVAL_METHODS:
        low, high = F.col(f"lower_{m}"), F.col(f"upper_{m}")
        measures += [F.avg((high + low) / 2 - F.col("reachable_gain")).alias(f"centre_bias_{m}"),
                     F.avg(F.col(f"covers_reachable_{m}").cast("int")).alias(f"coverage_reachable_{m}"),
                     F.avg(F.col(f"covers_population_{m}").cast("int")).alias(f"coverage_population_{m}"),
                     F.median(high - low).alias(f"width_median_{m}")]
    measures.append(F.sqrt(F.lit(0.9 * 0.1) / F.count(F.lit(1))).alias("coverage_se"))
    measures += [(F.count_if(F.col("reading") == r) / F.count(F.lit(1))).alias(r) for r in C.READINGS]
    return repetitions.groupBy(*by).agg(*measures)


def overall_coverage(repetitions: DataFrame) -> DataFrame:
    """Share of repetitions whose interval covers the reachable gain, per method."""
    return repetitions.agg(*[F.avg(F.col(f"covers_reachable_{m}").cast("int")).alias(m) for m in C.INTERVAL_METHODS])
