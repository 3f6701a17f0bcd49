"""Image catalogue items: JSON features to rows, bands with their metadata, scenes of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.operators.raster import points_in_footprints

BAND = "struct<nodata: double, scale: double>"
FEATURE = ("id string, bbox array<double>, "
           "properties struct<`datetime`: string, start_datetime: string, end_datetime: string, updated: string, "
           "created: string, `eo:cloud_cover`: double, `bdc:tiles`: array<string>>, "
           f"assets map<string, struct<href: string, `checksum:multihash`: string, `eo:bands`: array<{BAND}>>>")


def items_from_json(features: DataFrame, column: str = "value") -> DataFrame:
    """One row per feature: id, period in UTC, footprint box, tiles, cloud cover and the assets map."""
    f = features.select(F.from_json(column, FEATURE).alias("f"))
    p = "f.properties."

    def instant(name: str):
        return F.try_to_timestamp(F.col(p + name)).alias(name.removesuffix("_datetime"))

    return f.select(
        F.col("f.id").alias("item_id"), instant("start_datetime"), instant("end_datetime"),
        F.try_to_timestamp(F.col(p + "`datetime`")).alias("acquired"),
        F.col("f.bbox")[0].alias("west"), F.col("f.bbox")[1].alias("south"), F.col("f.bbox")[2].alias("east"),
        F.col("f.bbox")[3].alias("north"), F.array_join(F.coalesce(p + "`bdc:tiles`", F.array().cast("array<string>")), ",").alias("tile"),
        F.col(p + "`eo:cloud_cover`").alias("item_cloud_pct"), F.col(p + "updated").alias("item_updated"),
        F.col(p + "created").alias("item_created"), F.col("f.assets").alias("assets"))


def item_bands(items: DataFrame, bands=tuple(C.BANDS)) -> DataFrame:
    """Long form: every column of the item plus band, href, nodata, scale and checksum of each wanted band."""
    exploded = items.select("*", F.explode("assets").alias("band", "_asset")).where(F.col("band").isin(list(bands)))
    return exploded.select(
        *[c for c in items.columns if c != "assets"], "band", F.col("_asset.href").alias("href"),
        F.col("_asset.`checksum:multihash`").alias("checksum"), F.try_element_at("_asset.`eo:bands`", F.lit(1)).alias("_b")
    ).withColumn("nodata", F.col("_b.nodata")).withColumn("scale", F.col("_b.scale")).drop("_b")


def scenes_of_day(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scenes over each (lon, lat, day), by footprint and acquisition day; one search per distinct request."""
    keyed = scenes.withColumn("_day", F.to_date("acquired"))
    wanted = requests.select("lon", "lat", "day").distinct()
    return points_in_footprints(wanted, keyed).where(F.col("day") == F.col("_day")).drop("_day")
