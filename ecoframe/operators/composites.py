"""From raw pixel windows to one row per composite: decoding, validity, source scenes and window statistics.

Pixels travel in long form, one row per composite × window pixel (offsets i, j; the point's own pixel is
i = j = 0). ``keys`` name a composite: by default site, campaign_id and item_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions import scalars as S

KEYS = ("site", "campaign_id", "item_id")


def checked_metadata(band: Column, nodata: Column, scale: Column, item: Column) -> Column:
    """struct(nodata, scale) of a band; a missing nodata, or a missing scale outside the quality bands, fails.

    A scale of 0 counts as 1, and so does a missing one on the quality bands.
    """
    quality = band.isin(C.QUALITY_BANDS)
    label = F.concat(item, F.lit("/"), band)
    checked_nodata = F.coalesce(nodata.cast("double"), F.raise_error(
        F.concat(label, F.lit(": metadata without nodata"))).cast("double"))
    checked_scale = F.when(~quality & scale.isNull(), F.raise_error(
        F.concat(label, F.lit(": metadata without scale"))).cast("double")).otherwise(
        F.coalesce(F.nullif(scale.cast("double"), F.lit(0.0)), F.lit(1.0)))
    return F.struct(checked_nodata.alias("nodata"), checked_scale.alias("scale"))


def decode(band_pixels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Physical values: long (keys, band, i, j, raw, nodata, scale) → one row per pixel, one column per band.

    Nodata becomes NULL; spectral and index bands are scaled, quality bands are not. NDMI is added.
    """
    item = F.concat_ws("/", *keys)
    meta = band_pixels.withColumn("_m", checked_metadata(F.col("band"), F.col("nodata"), F.col("scale"), item))
    scale = F.when(F.col("band").isin(C.QUALITY_BANDS), F.lit(1.0)).otherwise(F.col("_m.scale"))
    values = meta.withColumn("_value", S.physical(F.col("raw"), F.col("_m.nodata"), scale))
    wide = values.groupBy(*keys, "i", "j").agg(
        *[F.max(F.when(F.col("band") == b, F.col("_value"))).alias(b) for b in C.BANDS])
    return wide.withColumn("NDMI", S.finite(S.normalized_difference(F.col("B8A"), F.col("B11"))))


def quality_tests(pixels: DataFrame) -> DataFrame:
    """Observation date and the four pixel tests. ``pixels`` has the bands, composite_start and composite_end."""
    date = F.when(F.col("PROVENANCE").isNotNull(),
                  S.observation_date(F.col("composite_start"), F.col("PROVENANCE")))
    finite = [F.col(b).isNotNull() for b in C.SPECTRAL_BANDS + C.INDEX_BANDS]
    all_bands = finite[0]
    for test in finite[1:]:
        all_bands = all_bands & test
    return (pixels.withColumn("observation_date", date)
            .withColumn("test_cube_scl", S.scl_valid(F.col("SCL")))
            .withColumn("test_bands", all_bands)
            .withColumn("test_provenance", F.coalesce(
                F.col("observation_date").between(F.col("composite_start"), F.col("composite_end")), F.lit(False)))
            .withColumn("test_haze", F.coalesce(F.col("B02") <= C.HAZE_B02_MAX, F.lit(False))))


def choose_source_scene(pixels: DataFrame, readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The Sentinel scene each pixel came from, and whether the candidates disagree.

    ``readings`` holds one row per pixel × scene of its observation day: keys, i, j, scene_id, scl, b04_dn
    (scl NULL where the scene has no data at the pixel). Among scenes with data the one whose B04 is nearest
    to the cube's wins, the smallest id on ties. If candidates disagree on validity and even the best differs
    by more than the tolerance, the pixel is in conflict.
    """
    pixel = [*keys, "i", "j"]
    cube = pixels.select(*pixel, F.col("B04").alias("_cube"))
    b04 = S.finite(S.scene_reflectance(F.col("b04_dn"), F.col("scene_id")))
    difference = F.coalesce(F.abs(b04 - F.col("_cube")), F.lit(float("inf")))
    has_data = F.col("scl").isNotNull()
    rank = F.when(has_data, F.struct(difference.alias("d"), F.col("scene_id").alias("s")))
    best = readings.join(cube, pixel).groupBy(*pixel).agg(
        F.count(F.lit(1)).cast("int").alias("n_scenes"),
        F.count_if(has_data).cast("int").alias("n_scenes_with_data"),
        F.min_by(F.struct(F.col("scene_id").alias("id"), F.col("scl").cast("int").alias("scl"),
                          difference.alias("d")), rank).alias("_best"),
        F.bool_or(F.when(has_data, S.scl_valid(F.col("scl")))).alias("_any"),
        F.bool_and(F.when(has_data, S.scl_valid(F.col("scl")))).alias("_all"))
    chosen = best.select(
        *pixel, "n_scenes", "n_scenes_with_data",
        F.when(F.col("n_scenes_with_data") > 0, F.col("_best.id")).alias("source_scene"),
        F.when(F.col("n_scenes_with_data") > 0, F.col("_best.scl")).alias("source_scl"),
        F.when(F.col("n_scenes_with_data") > 0, S.finite(F.col("_best.d"))).alias("source_b04_difference"),
        F.coalesce((F.col("_any") != F.col("_all")) & (F.col("_best.d") > C.SOURCE_B04_TOLERANCE),
                   F.lit(False)).alias("source_conflict"))
    return (pixels.join(chosen, pixel, "left")
            .withColumn("n_scenes", F.coalesce("n_scenes", F.lit(0)))
            .withColumn("n_scenes_with_data", F.coalesce("n_scenes_with_data", F.lit(0)))
            .withColumn("source_conflict", F.coalesce("source_conflict", F.lit(False))))


def validity(pixels: DataFrame) -> DataFrame:
    """The main rule, its two cube-class variants, and the reasons in their fixed order."""
    source_ok = S.scl_valid(F.col("source_scl")) & ~F.col("source_conflict")
    common = F.col("test_bands") & F.col("test_provenance")
    no_source = (F.when(F.col("n_scenes") == 0, C.REASON_NO_SCENE)
                 .when(F.col("n_scenes_with_data") == 0, C.REASON_SCENE_WITHOUT_DATA)
                 .when(F.col("source_conflict"), C.REASON_SCENE_CONFLICT)
                 .otherwise(F.concat(F.lit(C.REASON_SOURCE_CLASS + " "), F.col("source_scl"), F.lit(" ("),
                                     S.scl_name(F.col("source_scl")), F.lit(")"))))
    provenance = F.when(F.col("observation_date").isNull(), C.REASON_PROVENANCE_MISSING).otherwise(
        F.concat(F.lit(C.REASON_PROVENANCE_OUTSIDE + " ("), F.col("observation_date"), F.lit(")")))
    haze = F.concat(F.lit(C.REASON_HAZE + " (B02 "), S.three_decimals(F.col("B02")),
                    F.lit(f" > {C.HAZE_B02_MAX})"))
    reason = S.join_messages(
        F.when(F.col("observation_date").isNotNull() & ~source_ok, no_source),
        F.when(~F.col("test_bands"), C.REASON_BAND_MISSING),
        F.when(~F.col("test_provenance"), provenance),
        F.when(F.col("test_bands") & ~F.col("test_haze"), haze))
    return (pixels.withColumn("valid", source_ok & F.col("test_haze") & common)
            .withColumn("valid_cube_scl_b02", F.col("test_cube_scl") & F.col("test_haze") & common)
            .withColumn("valid_cube_scl_only", F.col("test_cube_scl") & common)
            .withColumn("invalid_reason", reason))


CENTRE = [*C.BANDS, "NDMI", "source_scl", "source_scene", "n_scenes", "source_conflict", "source_b04_difference",
          "observation_date", "valid", "invalid_reason", "valid_cube_scl_b02", "valid_cube_scl_only"]


def composite_rows(pixels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per composite: the point's own pixel and the statistics of the valid window pixels.

    A window has (2·radius+1)² pixels, so the group, its median and its scene set are small by construction.
    """
    centre = F.max_by(F.struct(*CENTRE), F.when((F.col("i") == 0) & (F.col("j") == 0), F.lit(1)))
    measures = [centre.alias("_centre"), F.count(F.lit(1)).cast("int").alias("window_n_pixels"),
                F.count_if("valid").cast("int").alias("window_n_valid"),
                F.collect_set("source_scene").alias("_scenes")]
    for index in ("NDVI", "EVI", "NDMI"):
        value = F.when(F.col("valid"), F.col(index))
        name = index.lower()
        measures += [F.median(value).alias(f"window_{name}_median"),
                     F.when(F.count_if("valid") >= 2, F.stddev_pop(value)).alias(f"window_{name}_sd")]
    grouped = pixels.groupBy(*keys).agg(*measures)
    scenes = F.nullif(F.array_join(F.array_sort("_scenes"), ";"), F.lit(""))
    quality = [F.col(f"_centre.{b}").cast("int").alias(b) for b in C.QUALITY_BANDS]
    kept = [F.col(f"_centre.{c}").alias(c) for c in CENTRE if c not in C.QUALITY_BANDS]
    return grouped.select(*keys, *kept, *quality, scenes.alias("window_source_scenes"), "window_n_pixels",
                          "window_n_valid", *[f"window_{n}_{s}" for n in ("ndvi", "evi", "ndmi")
                                              for s in ("median", "sd")])


def outside_raster_rows(items: DataFrame, schema_of: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows for periods whose rasters do not hold the point: everything missing, invalid, with that reason."""
    fixed = {"n_scenes": F.lit(0), "source_conflict": F.lit(False), "valid": F.lit(False),
             "valid_cube_scl_b02": F.lit(False), "valid_cube_scl_only": F.lit(False),
             "invalid_reason": F.lit(C.REASON_OUTSIDE_RASTER), "window_n_pixels": F.lit(0),
             "window_n_valid": F.lit(0)}
    columns = [fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
               for f in schema_of.schema if f.name not in keys]
    return items.select(*keys, *columns)
