"""Optical descriptors per site × campaign, with the minimum-coverage rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions.scalars import relative_quarter
from ecoframe.operators.quantiles import Quantile, exact_quantiles
from ecoframe.operators.skew import shared

KEYS = ["site", "campaign_id"]


def optical_descriptors(series: DataFrame) -> DataFrame:
    """One row per site × campaign from the composite series.

    ``series`` needs site, campaign_id, cut, composite_start, window_n_valid, window_ndvi_median,
    window_ndmi_median and optionally observation_date. A composite counts when most of its pixel window is
    valid. Without coverage (at least ten used composites and one in each quarter of the year before the cut)
    the descriptors are NULL.
    """
    observed = F.col("observation_date") if "observation_date" in series.columns else F.lit(None).cast("date")
    day = F.coalesce(observed, F.date_add("composite_start", C.HALF_COMPOSITE_DAYS))
    rows = shared(series.select(
        *KEYS, "cut",
        (F.coalesce(F.col("window_n_valid"), F.lit(0)) >= C.MIN_VALID_WINDOW_PIXELS).alias("used"),
        relative_quarter(day, F.col("cut")).alias("quarter"),
        F.nanvl("window_ndvi_median", F.lit(None).cast("double")).alias("ndvi"),
        F.nanvl("window_ndmi_median", F.lit(None).cast("double")).alias("ndmi")), *KEYS, "quarter", "ndvi", "ndmi")

    used, last = F.col("used"), F.col("quarter") == C.QUARTERS - 1
    counts = [
        F.min("cut").alias("cut"),
        F.count(F.lit(1)).alias("composites"),
        F.count_if(used).alias("composites_used"),
        # which quarters are covered, as four bits: no second shuffle for a distinct count
        F.coalesce(F.bit_count(F.bit_or(F.when(used, F.expr("shiftleft(1, quarter)")))),
                   F.lit(0)).cast("int").alias("quarters_covered"),
        F.count_if(used & last).alias("n_last_quarter")]
    ndvi, ndmi = F.when(used, F.col("ndvi")), F.when(used, F.col("ndmi"))
    described = exact_quantiles(rows, KEYS, [
        Quantile("_ndvi", ndvi, 0.5), Quantile("_ndmi", ndmi, 0.5), Quantile("_p90", ndvi, 0.9), Quantile("_p10", ndvi, 0.1),
        Quantile("_ndmi_last", F.when(last, ndmi), 0.5)], others=counts)

    ok = (F.col("composites_used") >= C.MIN_VALID_COMPOSITES) & (F.col("quarters_covered") == C.QUARTERS)
    enough_last = F.col("n_last_quarter") >= C.MIN_LAST_QUARTER_COMPOSITES
    return described.select(
        *KEYS, "cut", "composites", "composites_used", "quarters_covered", "n_last_quarter",
        ok.alias("coverage_ok"),
        F.when(ok, F.col("_ndvi")).alias("ndvi_median"),
        F.when(ok, F.col("_ndmi")).alias("ndmi_median"),
        F.when(ok, F.col("_p90") - F.col("_p10")).alias("ndvi_amplitude_p90_p10"),
        F.when(ok & enough_last, F.col("_ndmi_last") - F.col("_ndmi")).alias("ndmi_recent_change"))
