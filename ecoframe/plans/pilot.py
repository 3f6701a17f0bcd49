"""The pilot end to end: ingest, optical series and the analytical table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions import scalars as S
from ecoframe.operators import acoustic, composites, raster
from ecoframe.operators.descriptors import optical_descriptors
from ecoframe.operators.quality import quality_report
from ecoframe.sources import audio, items as catalogue_items, tables
from ecoframe.sources.projection import transform_points

LON_LAT = "EPSG:4326"
KEYS = ["site", "campaign_id", "item_id"]


def ingest(spark: SparkSession, audio_path: str, metadata_csv: str, annotations_csv: str,
           sites: list[str]) -> dict[str, DataFrame]:
    """points, detections, recordings, campaigns and quality_report from the source files."""
    points = tables.points_from_source(tables.scan_text_csv(spark, metadata_csv), sites)
    detections = tables.detections_from_source(tables.scan_text_csv(spark, annotations_csv), sites)
    recordings = audio.recording_table(audio.scan_wavs(spark, audio_path))
    report = quality_report(recordings, detections, points, detection_order=tuple(detections.columns),
                            point_order=tuple(points.columns))
    return {"points": points, "detections": detections, "recordings": recordings,
            "campaigns": acoustic.campaign_table(recordings), "quality_report": report}


def image_targets(campaigns: DataFrame, points: DataFrame, days: int = C.SERIES_DAYS) -> DataFrame:
    """site, campaign_id, lon, lat and the image window that ends on the eve of the first recording."""
    place = points.select("site", F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat"))
    return campaigns.join(place, "site").select(
        "site", "campaign_id", "lon", "lat", S.window_cut(F.col("clock_start")).alias("cut"),
        S.window_start(F.col("clock_start"), days).alias("window_start"))


def _in_system(df: DataFrame, x: str, y: str, source, target) -> DataFrame:
    moved = df.withColumn("_xy", transform_points(F.col(x), F.col(y), source, target))
    return moved.withColumn("x", F.col("_xy.x")).withColumn("y", F.col("_xy.y")).drop("_xy")


def choose_items(targets: DataFrame, items: DataFrame, rasters: DataFrame) -> DataFrame:
    """One composite item per target and period, located in its class raster (NULL position if outside)."""
    candidates = raster.items_over_points(targets, items).withColumn("href", F.col("assets")["SCL"]["href"])
    systems = candidates.join(rasters.select("href", "crs"), "href")
    placed = raster.locate(_in_system(systems, "lon", "lat", F.lit(LON_LAT), F.col("crs")).drop("crs"), rasters, strict=False)
    return raster.one_item_per_period(placed.drop("href", "nodata", "x0", "y0", "width", "height"))


def read_composites(chosen: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """Tested window pixels of the chosen items, every band decoded with the item's own metadata."""
    inside = chosen.where(F.col("pixel_row").isNotNull())
    bands = catalogue_items.item_bands(inside.select(*KEYS, "pixel_row", "pixel_col", "assets"))
    raw = raster.read_window(bands, blocks, block_size=block_size)
    period = inside.select(*KEYS, "lon", "lat", "crs", "x_centre", "y_centre", "res",
                           F.to_date("start").alias("composite_start"), F.to_date("end").alias("composite_end"))
    return composites.quality_tests(composites.decode(raw).join(period, KEYS))


def read_scenes(pixels: DataFrame, scenes: DataFrame, rasters: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """Class and red band of every scene of the observation day, at the centre of each pixel."""
    x, y = raster.window_centres(F.col("x_centre"), F.col("y_centre"), F.col("res"))
    wanted = pixels.where(F.col("observation_date").isNotNull()).select(
        *KEYS, "i", "j", "lon", "lat", F.col("observation_date").alias("day"), "crs", x.alias("px"), y.alias("py"))
    found = catalogue_items.scenes_of_day(wanted, scenes)
    pairs = wanted.join(found.select("lon", "lat", "day", F.col("item_id").alias("scene_id"), "assets"), ["lon", "lat", "day"])
    key = [*KEYS, "i", "j", "scene_id"]
    reads = pairs.select(*key, "crs", "px", "py", F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col("assets")[b]["href"].alias("href")) for b in ("SCL", "B04")])).alias("_b")).select(
        *key, "crs", "px", "py", "_b.band", "_b.href")
    target = reads.join(rasters.select("href", F.col("crs").alias("_target")), "href")
    placed = _in_system(target, "px", "py", F.col("crs"), F.col("_target")).select(*key, "band", "href", "x", "y")
    sampled = raster.sample(placed, rasters, blocks, block_size)
    return sampled.groupBy(*key).agg(F.max(F.when(F.col("band") == "SCL", F.col("value"))).alias("scl"),
                                     F.max(F.when(F.col("band") == "B04", F.col("value"))).alias("b04_dn"))


def optical_series(targets: DataFrame, items: DataFrame, scenes: DataFrame, rasters: DataFrame, blocks: DataFrame,
                   block_size: int = raster.BLOCK_SIZE) -> DataFrame:
    """One row per site × campaign × composite, invalid ones with their reason.

    ``items`` and ``scenes`` come from :func:`ecoframe.sources.items.items_from_json`; ``rasters`` and
    ``blocks`` are the raster tables of :mod:`ecoframe.operators.raster`.
    """
    chosen = choose_items(targets, items, rasters)
    pixels = read_composites(chosen, blocks, block_size)
    sourced = composites.choose_source_scene(pixels, read_scenes(pixels, scenes, rasters, blocks, block_size))
    rows = composites.composite_rows(composites.validity(sourced))
    outside = composites.outside_raster_rows(chosen.where(F.col("pixel_row").isNull()), rows)
    inside = F.col("pixel_row").isNotNull()
    described = chosen.select(
        *KEYS, "cut", "item_updated", "tile", F.to_date("start").alias("composite_start"),
        F.to_date("end").alias("composite_end"), "item_cloud_pct", F.when(inside, F.col("x")).alias("x_cube"),
        F.when(inside, F.col("y")).alias("y_cube"), "pixel_row", "pixel_col")
    return described.join(rows.unionByName(outside), KEYS)


def series_coverage(series: DataFrame, days: int = C.SERIES_DAYS) -> DataFrame:
    """Periods found and expected per campaign, and the days from the first start to the last end."""
    return series.groupBy("site", "campaign_id").agg(
        F.count(F.lit(1)).alias("periods"), F.lit(days // C.COMPOSITE_DAYS).alias("periods_expected"),
        F.datediff(F.max("composite_end"), F.min("composite_start")).alias("covered_days"),
        F.count_if("valid").alias("valid"))


def integrate(recordings: DataFrame, detections: DataFrame, campaigns: DataFrame, points: DataFrame, series: DataFrame,
              standard_minutes: int | None = None) -> DataFrame:
    """The analytical table from the ingested tables and the optical series."""
    order = [c for c in ("ordinal", "clock_start", "campaign_id") if c in campaigns.columns]
    assigned = acoustic.assign_campaigns(recordings, campaigns, campaign_order=order)
    summary = acoustic.acoustic_summary(assigned, detections, campaigns, standard_minutes)
    located = points.withColumn("latitude", F.col("latitude").try_cast("double")).withColumn(
        "longitude", F.col("longitude").try_cast("double"))
    return acoustic.analytical_table(summary, optical_descriptors(series), located)
