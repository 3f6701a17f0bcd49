"""Points and rasters: location, pixel windows and samples from blocked raster tables.

A raster is described by one row (href, x0, y0, res, width, height, nodata, crs), where (x0, y0) is its upper
left corner, and stored as rows of square blocks (href, block_row, block_col, values) in row-major order. A
read first finds the distinct blocks that hold a wanted pixel; only these leave the scan of the blocks. Then the pixels of a
window that lie in one block meet it as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C

BLOCK_SIZE = 256
#: Names of wanted blocks that are broadcast to the scan (some 60 MB); more of them are joined by a shuffle.
MOST_WANTED = 500_000


def locate(points: DataFrame, rasters: DataFrame, strict: bool = True) -> DataFrame:
    """Cell of each point (href, x, y in the raster's system) with its distance to the border in pixels.

    Adds pixel_row, pixel_col, border_px, x_centre, y_centre. A point outside its raster fails the job when
    ``strict``, else those columns are NULL.
    """
    joined = points.join(rasters, "href")
    row = F.floor((F.col("y0") - F.col("y")) / F.col("res")).cast("int")
    col = F.floor((F.col("x") - F.col("x0")) / F.col("res")).cast("int")
    inside = (row >= 0) & (row < F.col("height")) & (col >= 0) & (col < F.col("width"))
    outside_value = F.lit(None).cast("int")
    if strict:
        outside_value = F.raise_error(F.concat(F.lit("point outside raster "), F.col("href"))).cast("int")
    cell = F.when(inside, row).otherwise(outside_value)
    placed = joined.withColumn("pixel_row", cell).withColumn("pixel_col", F.when(inside, col))
    border = F.least(F.col("pixel_row"), F.col("pixel_col"), F.col("height") - 1 - F.col("pixel_row"),
                     F.col("width") - 1 - F.col("pixel_col"))
    return (placed
            .withColumn("border_px", F.when(F.col("pixel_row").isNotNull(), border))
            .withColumn("x_centre", F.col("x0") + (F.col("pixel_col") + 0.5) * F.col("res"))
            .withColumn("y_centre", F.col("y0") - (F.col("pixel_row") + 0.5) * F.col("res")))


def expand_window(points: DataFrame, radius: int = C.WINDOW_RADIUS_PX) -> DataFrame:
    """One row per pixel of the square window: offsets i (down) and j (right), centre first at (0, 0)."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    return points.withColumn("i", F.explode(span)).withColumn("j", F.explode(span))


def window_centres(x_centre: Column, y_centre: Column, res: Column) -> tuple[Column, Column]:
    """Centre of the pixel at offsets (i, j); y decreases as i grows."""
    return x_centre + F.col("j") * res, y_centre - F.col("i") * res


def wanted_blocks(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks named by `keys` (href, _br, _bc; repeats allowed) as _href, _block_row, _block_col, _values.

    The names are counted first: few are broadcast, so that no other block leaves its scan; a table of blocks that is
    partitioned by href is also pruned to the directories that are asked for.
    """
    names = keys.where("_br is not null and _bc is not null").distinct()
    side = F.broadcast(names) if names.limit(MOST_WANTED + 1).count() <= MOST_WANTED else names
    side = side.select(F.col("href").alias("_want"), "_br", "_bc")
    here = (F.col("href") == F.col("_want")) & (F.col("block_row") == F.col("_br")) & (F.col("block_col") == F.col("_bc"))
    return blocks.join(side, here, "left_semi").select(
        F.col("href").alias("_href"), F.col("block_row").alias("_block_row"), F.col("block_col").alias("_block_col"), F.col("values").alias("_values"))


def _in_block(row: Column, col: Column, block_size: int) -> tuple[Column, Column, Column]:
    """Block row, block column and 1-based place in the block."""
    br, bc = (F.floor(v / F.lit(float(block_size))).cast("int") for v in (row, col))
    return br, bc, ((row - br * block_size) * block_size + col - bc * block_size + 1).cast("int")


def _same_block() -> Column:
    return (F.col("href") == F.col("_href")) & (F.col("_br") == F.col("_block_row")) & (F.col("_bc") == F.col("_block_col"))


def read_pixels(cells: DataFrame, blocks: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Adds ``raw`` for each (href, row, col); NULL outside the raster or where no block is stored."""
    br, bc, place = _in_block(F.col("row"), F.col("col"), block_size)
    wanted = cells.withColumns({"_br": br, "_bc": bc, "_place": place})
    stored = wanted_blocks(wanted.select("href", "_br", "_bc"), blocks)
    joined = wanted.join(stored, _same_block(), "left")
    return joined.withColumn("raw", F.try_element_at("_values", F.col("_place")).cast("double")).drop(
        "_br", "_bc", "_place", "_href", "_block_row", "_block_col", "_values")


def read_window(points: DataFrame, blocks: DataFrame, radius: int = C.WINDOW_RADIUS_PX,
                block_size: int = BLOCK_SIZE) -> DataFrame:
    """Raw values of the window around each located point; outside the raster the window is filled with nodata.

    A point is one row for each block that its window touches (one to four), not one for each pixel.
    """
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    placed = [(i, j, *_in_block(F.col("pixel_row") + i, F.col("pixel_col") + j, block_size)) for i, j in steps]
    pixels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), br.alias("br"), bc.alias("bc"), place.alias("place"))
                       for i, j, br, bc, place in placed])
    touched = F.explode(F.array_distinct(F.transform("_pixels", lambda p: F.struct(p["br"].alias("br"), p["bc"].alias("bc")))))
    own = F.filter("_pixels", lambda p: p["br"].eqNullSafe(F.col("_br")) & p["bc"].eqNullSafe(F.col("_bc")))
    rows = points.withColumn("_pixels", pixels).withColumn("_t", touched).select(
        *points.columns, "_pixels", F.col("_t.br").alias("_br"), F.col("_t.bc").alias("_bc")).withColumn("_pixels", own)
    stored = wanted_blocks(rows.select("href", "_br", "_bc"), blocks)
    read = F.transform("_pixels", lambda p: F.struct(
        p["i"].alias("i"), p["j"].alias("j"), F.try_element_at("_values", p["place"]).cast("double").alias("raw")))
    met = rows.join(stored, _same_block(), "left").select(*points.columns, F.inline(read))
    return met.withColumn("raw", F.coalesce("raw", "nodata"))


def sample(points: DataFrame, rasters: DataFrame, blocks: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Value at each point (href, x, y); NULL outside the raster and where it is 0 or the raster's nodata."""
    placed = locate(points, rasters, strict=False).withColumn("row", F.col("pixel_row")).withColumn(
        "col", F.col("pixel_col"))
    read = read_pixels(placed, blocks, block_size)
    no_data = (F.col("raw") == 0) | F.coalesce(F.col("raw") == F.col("nodata"), F.lit(False))
    return read.withColumn("value", F.when(~no_data, F.col("raw"))).select(*points.columns, "value")


def _cells(low: Column, high: Column, cell_deg: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell_deg), F.floor(high / cell_deg)))


def points_in_footprints(points: DataFrame, footprints: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Pairs of a point (lon, lat) and a footprint box (west, south, east, north) that holds it.

    Both sides are keyed by grid cell, so the join is an equality join with the exact test as residual. Sizes are estimated
    without the copies of a row, one for each of its cells, so the side that looks small must not be broadcast.
    """
    boxes = footprints.withColumn("_cx", _cells(F.col("west"), F.col("east"), cell_deg)).withColumn(
        "_cy", _cells(F.col("south"), F.col("north"), cell_deg))
    placed = points.withColumn("_px", F.floor(F.col("lon") / cell_deg)).withColumn(
        "_py", F.floor(F.col("lat") / cell_deg))
    holds = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return placed.hint("merge").join(boxes, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & holds).drop(
        "_px", "_py", "_cx", "_cy")


def items_over_points(targets: DataFrame, items: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Composite items over each target point that lie wholly inside its window [window_start, cut].

    Targets are keyed by (grid cell, month) as well, so points that share one cell spread over the months.
    """
    months = F.sequence(F.trunc("window_start", "MM"), F.trunc("cut", "MM"), F.expr("interval 1 month"))
    spread = targets.withColumn("_month", F.explode(months))
    keyed = items.withColumn("_item_month", F.trunc(F.to_date("start"), "MM"))
    pairs = points_in_footprints(
        spread.withColumn("lon", F.col("lon").cast("double")), keyed, cell_deg).where(
        F.col("_month") == F.col("_item_month"))
    inside = (F.to_date("start") >= F.col("window_start")) & (F.to_date("end") <= F.col("cut"))
    return pairs.where(inside).drop("_month", "_item_month")


def items_over_areas(areas: DataFrame, items: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Items whose box overlaps the area's (area_west, area_south, area_east, area_north) and that start in [first, last].

    Both sides are keyed by (grid cell, month). A pair that shares several cells counts in the one that holds the south-west
    corner of the overlap, so nothing has to be made distinct. Neither side is broadcast: an area is one row for each of its
    months and cells, which estimates of its size leave out.
    """
    months = F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))
    wanted = areas.withColumn("_month", F.explode(months)).withColumn(
        "_ax", _cells(F.col("area_west"), F.col("area_east"), cell_deg)).withColumn(
        "_ay", _cells(F.col("area_south"), F.col("area_north"), cell_deg))
    keyed = items.withColumn("_item_month", F.trunc(F.to_date("start"), "MM")).withColumn(
        "_cx", _cells(F.col("west"), F.col("east"), cell_deg)).withColumn("_cy", _cells(F.col("south"), F.col("north"), cell_deg))
    same = (F.col("_month") == F.col("_item_month")) & (F.col("_ax") == F.col("_cx")) & (F.col("_ay") == F.col("_cy"))
    overlap = ((F.col("west") <= F.col("area_east")) & (F.col("area_west") <= F.col("east"))
               & (F.col("south") <= F.col("area_north")) & (F.col("area_south") <= F.col("north")))
    corner = ((F.floor(F.greatest("west", "area_west") / cell_deg) == F.col("_cx"))
              & (F.floor(F.greatest("south", "area_south") / cell_deg) == F.col("_cy")))
    inside = F.to_date("start").between(F.col("first"), F.col("last"))
    return wanted.hint("merge").join(keyed, same & overlap & corner & inside).drop("_month", "_item_month", "_ax", "_ay", "_cx", "_cy")


def one_item_per_period(candidates: DataFrame, keys: Sequence[str] = ("site", "campaign_id"),
                        period: str = "start", item_order: Sequence[str] = ("item_id",)) -> DataFrame:
    """One item per period: the one whose raster holds the point farthest from its border.

    The first item (by ``item_order``) wins ties; if no raster holds the point the first item stays, with a
    NULL position, so that the period becomes an invalid row instead of vanishing.
    """
    rest = [c for c in candidates.columns if c not in (*keys, period)]
    rank = F.struct(F.col("border_px").isNull().alias("a"), (-F.col("border_px")).alias("b"), *item_order)
    return (candidates.groupBy(*keys, period).agg(F.min_by(F.struct(*rest), rank).alias("_item"))
            .select(*keys, period, "_item.*"))


def point_grid(centres: DataFrame, dx: Sequence[float], dy: Sequence[float], step: float) -> DataFrame:
    """Grid points around each centre (landscape, x, y), numbered row by row from the smallest dy."""
    offsets = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a * step).alias("dx"), F.lit(b * step).alias("dy"))
                        for n, (b, a) in enumerate((b, a) for b in dy for a in dx)])
    grid = centres.withColumn("_o", F.explode(offsets))
    return grid.select(F.concat_ws("-", "landscape", F.lpad(F.col("_o.n").cast("string"), 2, "0")).alias("point"),
                       "landscape", (F.col("x") + F.col("_o.dx")).alias("x"), (F.col("y") + F.col("_o.dy")).alias("y"))


def lat_lon_grid(df: DataFrame, lats: Sequence[float], lons: Sequence[float]) -> DataFrame:
    """Each row of ``df`` with every grid point P0, P1, … (latitudes outer, longitudes inner)."""
    grid = F.array(*[F.struct(F.lit(f"P{n}").alias("point"), F.lit(float(lon)).alias("longitude"),
                              F.lit(float(lat)).alias("latitude"))
                     for n, (lat, lon) in enumerate((a, o) for a in lats for o in lons)])
    return df.withColumn("_g", F.explode(grid)).select(*df.columns, "_g.*")
