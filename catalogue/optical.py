"""Pixel windows, decoding, validity, source scenes, window statistics and cloudiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import shapes as T
from ecoframe import constants as C
from ecoframe.functions import scalars as S
from ecoframe.operators import cloudiness as K
from ecoframe.operators import composites as P
from ecoframe.operators import raster as R
from ecoframe.operators import zonal as Z

BLOCK = 4  # embeddings are 8×8 rasters stored as four 4×4 blocks


# --- rasters ------------------------------------------------------------------------------------------------

def _rasters(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("href"), F.lit(100.0).alias("x0"), F.lit(200.0).alias("y0"),
                       F.lit(10.0).alias("res"), F.lit(8).alias("width"), F.lit(8).alias("height"),
                       F.lit(-9999.0).alias("nodata"))


def _blocks(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("href"), "embedding")
    span = F.sequence(F.lit(0), F.lit(8 // BLOCK - 1))
    placed = rows.withColumn("block_row", F.explode(span)).withColumn("block_col", F.explode(span))
    inner = F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1))
    values = F.transform(inner, lambda k: F.element_at(
        "embedding", ((F.col("block_row") * BLOCK + F.floor(k / BLOCK)) * 8 + F.col("block_col") * BLOCK
                      + k % BLOCK + 1).cast("int")).cast("double"))
    return placed.select("href", "block_row", "block_col", values.alias("values"))


def _points(spark, sf_dir):
    """A point per raster, placed by its label; large values of the first element push it outside."""
    rows = T.table(spark, sf_dir, "embeddings")
    x = 100.0 + (F.col("label") % 8) * 10.0 + 5.0 + F.when(F.element_at("embedding", 1) > 0.2, 80.0).otherwise(0.0)
    return rows.select(F.col("vec_id").cast("string").alias("href"), x.alias("x"),
                       (200.0 - (F.col("label") * 3 % 8) * 10.0 - 5.0).alias("y"))


POINTS = """
points AS (SELECT vec_id, embedding, label % 8 + CASE WHEN embedding[1] > 0.2 THEN 8 ELSE 0 END AS c, label * 3 % 8 AS r
           FROM embeddings)"""


def locate(spark, sf_dir):
    placed = R.locate(_points(spark, sf_dir), _rasters(spark, sf_dir), strict=False)
    return placed.select("href", "pixel_row", "pixel_col", "border_px", "x_centre", "y_centre")


LOCATE = "WITH" + POINTS + """
SELECT CAST(vec_id AS VARCHAR) AS href, CASE WHEN c < 8 THEN r END AS pixel_row, CASE WHEN c < 8 THEN c END AS pixel_col,
       CASE WHEN c < 8 THEN least(r, c, 7 - r, 7 - c) END AS border_px,
       CASE WHEN c < 8 THEN 100 + (c + 0.5) * 10 END::DOUBLE AS x_centre,
       CASE WHEN c < 8 THEN 200 - (r + 0.5) * 10 END::DOUBLE AS y_centre FROM points"""


def pixel_window(spark, sf_dir):
    """3×3 window around each point; pixels outside the raster carry its nodata."""
    placed = R.locate(_points(spark, sf_dir), _rasters(spark, sf_dir), strict=False).where(F.col("pixel_row").isNotNull())
    window = R.read_window(placed, _blocks(spark, sf_dir), block_size=BLOCK)
    x, y = R.window_centres(F.col("x_centre"), F.col("y_centre"), F.col("res"))
    return window.select("href", "i", "j", x.alias("pixel_x"), y.alias("pixel_y"), F.round("raw", 6).alias("raw"))


PIXEL_WINDOW = "WITH" + POINTS + """
SELECT CAST(vec_id AS VARCHAR) AS href, i, j, (100 + (c + j + 0.5) * 10)::DOUBLE AS pixel_x,
       (200 - (r + i + 0.5) * 10)::DOUBLE AS pixel_y,
       CASE WHEN r + i BETWEEN 0 AND 7 AND c + j BETWEEN 0 AND 7
            THEN round(embedding[CAST((r + i) * 8 + c + j + 1 AS INTEGER)]::DOUBLE, 6) ELSE -9999 END AS raw
FROM points, (SELECT CAST(range AS INTEGER) AS i FROM range(-1, 2)) a, (SELECT CAST(range AS INTEGER) AS j FROM range(-1, 2)) b
WHERE c < 8"""


def pixel_sample(spark, sf_dir):
    """Single-pixel sample; outside the raster there is no value."""
    out = R.sample(_points(spark, sf_dir), _rasters(spark, sf_dir), _blocks(spark, sf_dir), block_size=BLOCK)
    return out.select("href", F.round("value", 6).alias("value"))


PIXEL_SAMPLE = "WITH" + POINTS + """
SELECT CAST(vec_id AS VARCHAR) AS href,
       CASE WHEN c < 8 THEN round(nullif(embedding[CAST(r * 8 + c + 1 AS INTEGER)], 0)::DOUBLE, 6) END AS value FROM points"""


COVER_RADII = (12.0, 30.0, 100.0)


def zonal_cover(spark, sf_dir):
    """Native cover of the discs around each point, where the signs of the elements make two classes."""
    classes = F.transform("values", lambda v: F.when(v > 0.2, 3.0).when(v > 0, 2.0).when(v > -0.2, 1.0).otherwise(-9999.0))
    out = Z.zonal_cover(_points(spark, sf_dir).withColumn("point", F.lit("P")), _rasters(spark, sf_dir),
                        _blocks(spark, sf_dir).withColumn("values", classes), (3.0, 2.0), COVER_RADII, BLOCK)
    return out.select("href", "radius", "n", "native", F.round("cover", 6).alias("cover"), F.round("nearest", 6).alias("nearest"))


ZONAL_COVER = "WITH" + POINTS + f""",
pixels AS (SELECT vec_id, c, r, k % 8 AS pc, k // 8 AS pr, embedding[CAST(k + 1 AS INTEGER)]::DOUBLE AS v FROM points, (SELECT range AS k FROM range(64)) x),
discs AS (SELECT *, radius, (10 * (pc - c))::DOUBLE ** 2 + (10 * (pr - r))::DOUBLE ** 2 AS d2
          FROM pixels, (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in COVER_RADII)}]) AS radius) y)
SELECT CAST(vec_id AS VARCHAR) AS href, radius, count(*) FILTER (d2 <= radius * radius AND v > -0.2) AS n,
       count(*) FILTER (d2 <= radius * radius AND v > 0) AS native,
       round(count(*) FILTER (d2 <= radius * radius AND v > 0) / nullif(count(*) FILTER (d2 <= radius * radius AND v > -0.2), 0)::DOUBLE, 6) AS cover,
       round(sqrt(min(d2) FILTER (d2 <= radius * radius AND v > 0)), 6) AS nearest
FROM discs GROUP BY vec_id, radius"""


# --- composites: nine pixels of seven bands per embedding, quality bands from its label --------------------------

def _raw(k):
    """Digital number of the k-th element (1-based): nodata where the element is very low."""
    e = F.element_at("embedding", k)
    return F.when(e < -0.25, F.lit(-9999.0)).otherwise(F.floor(F.abs(e.cast("double")) * 10000))


def _band_pixels(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(8))))
    bands = C.SPECTRAL_BANDS + C.INDEX_BANDS
    long = [F.struct(F.lit(b).alias("band"), _raw((F.col("p") * 7 + n + 1).cast("int")).alias("raw"),
                     F.lit(-9999.0).alias("nodata"), F.lit(0.0001).alias("scale")) for n, b in enumerate(bands)]
    quality = {"SCL": (F.col("label") + F.col("p")) % 12, "CLEAROB": F.col("p") + 1, "TOTALOB": F.col("p") + 3,
               "PROVENANCE": F.when((F.col("label") == 3) & (F.col("p") == 4), -1).otherwise(350 + F.col("p") * 3)}
    long += [F.struct(F.lit(b).alias("band"), v.cast("double").alias("raw"),
                      F.lit(-1.0 if b == "PROVENANCE" else 0.0).alias("nodata"), F.lit(None).cast("double").alias("scale"))
             for b, v in quality.items()]
    return rows.withColumn("_b", F.explode(F.array(*long))).select(
        F.col("vec_id").alias("item_id"), (F.floor(F.col("p") / 3) - 1).cast("int").alias("i"),
        (F.col("p") % 3 - 1).cast("int").alias("j"), "_b.*")


def _pixels(spark, sf_dir):
    decoded = P.decode(_band_pixels(spark, sf_dir), ["item_id"])
    period = decoded.withColumn("composite_start", F.to_date(F.lit("2022-12-19"))).withColumn(
        "composite_end", F.to_date(F.lit("2022-12-31")))
    return P.quality_tests(period)


def _readings(spark, sf_dir):
    """Two candidate scenes per pixel, before and after the offset baseline, read from the tail of the vector."""
    rows = T.table(spark, sf_dir, "embeddings").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(8))))
    near = F.floor(F.abs(F.element_at("embedding", (F.col("p") * 7 + 2).cast("int")).cast("double")) * 10000)
    far = F.floor(F.abs(F.element_at("embedding", (64 - F.col("p")).cast("int")).cast("double")) * 10000)
    scenes = F.array(
        F.struct(F.lit("S2A_N0400_A").alias("scene_id"), F.nullif((F.col("label") + F.col("p")) % 12, F.lit(0)).alias("scl"),
                 (far + 1000.0).alias("b04_dn")),
        F.struct(F.lit("S2B_N0301_B").alias("scene_id"), F.nullif((F.col("label") * 5 + F.col("p")) % 12, F.lit(0)).alias("scl"),
                 F.when(F.col("p") != 5, near + 90.0).alias("b04_dn")))
    return rows.where(F.col("label") != 7).withColumn("_s", F.explode(scenes)).select(
        F.col("vec_id").alias("item_id"), (F.floor(F.col("p") / 3) - 1).cast("int").alias("i"),
        (F.col("p") % 3 - 1).cast("int").alias("j"), "_s.*")


def _e(k: str) -> str:
    return f"embedding[CAST({k} AS INTEGER)]::DOUBLE"


def _phys(n: int) -> str:
    return (f"CASE WHEN {_e(f'p * 7 + {n + 1}')} >= -0.25 THEN floor(abs({_e(f'p * 7 + {n + 1}')}) * 10000) "
            "* 0.0001::DOUBLE END")


PIXELS = f"""
grid AS (SELECT e.*, p, CAST(p // 3 - 1 AS INTEGER) AS i, CAST(p % 3 - 1 AS INTEGER) AS j
         FROM embeddings e, (SELECT CAST(range AS INTEGER) AS p FROM range(0, 9)) g),
decoded AS (
  SELECT vec_id AS item_id, label, p, i, j, embedding, {", ".join(f'{_phys(n)} AS {b}' for n, b in enumerate(C.SPECTRAL_BANDS + C.INDEX_BANDS))},
         nullif((label + p) % 12, 0) AS SCL, p + 1 AS CLEAROB, p + 3 AS TOTALOB,
         CASE WHEN label = 3 AND p = 4 THEN NULL ELSE 350 + p * 3 END AS PROVENANCE
  FROM grid),
tested AS (
  SELECT *, CASE WHEN B8A + B11 <> 0 THEN (B8A - B11) / (B8A + B11) END AS NDMI,
         CASE WHEN PROVENANCE < 353 THEN DATE '2023-01-01' + (PROVENANCE - 1) ELSE DATE '2022-01-01' + (PROVENANCE - 1) END AS observation_date,
         coalesce(SCL IN (4, 5, 6), false) AS test_cube_scl,
         B02 + B04 + B08 + B8A + B11 + NDVI + EVI IS NOT NULL AS test_bands,
         coalesce(B02 <= 0.10, false) AS test_haze
  FROM decoded),
pixels AS (SELECT *, coalesce(observation_date BETWEEN DATE '2022-12-19' AND DATE '2022-12-31', false) AS test_provenance FROM tested)"""


def pixel_decode_tests(spark, sf_dir):
    """Physical band values, NDMI, observation date and the four quality tests of every window pixel."""
    return _pixels(spark, sf_dir).select(
        "item_id", "i", "j", *[F.round(b, 6).alias(b) for b in C.SPECTRAL_BANDS + C.INDEX_BANDS + ["NDMI"]],
        *[F.col(b).cast("int").alias(b) for b in C.QUALITY_BANDS], "observation_date", "test_cube_scl", "test_bands",
        "test_provenance", "test_haze")


PIXEL_DECODE = "WITH" + PIXELS + f"""
SELECT item_id, i, j, {", ".join(f'round({b}, 6) AS {b}' for b in C.SPECTRAL_BANDS + C.INDEX_BANDS + ["NDMI"])},
       {", ".join(f'{b}::INTEGER AS {b}' for b in C.QUALITY_BANDS)}, observation_date, test_cube_scl, test_bands, test_provenance, test_haze
FROM pixels"""


def _sourced(spark, sf_dir):
    return P.choose_source_scene(_pixels(spark, sf_dir), _readings(spark, sf_dir), ["item_id"])


# column names are case-insensitive in SQL: the scene's reflectance must not share a name with the band
SOURCED = f"""
candidates AS (
  SELECT item_id, i, j, B04 AS cube, 'S2A_N0400_A' AS scene_id, nullif((label + p) % 12, 0) AS scl,
         floor(abs({_e('64 - p')}) * 10000) * 0.0001::DOUBLE AS scene_value FROM pixels WHERE label <> 7
  UNION ALL
  SELECT item_id, i, j, B04, 'S2B_N0301_B', nullif((label * 5 + p) % 12, 0),
         CASE WHEN p <> 5 THEN (floor(abs({_e('p * 7 + 2')}) * 10000) + 90) * 0.0001::DOUBLE END FROM pixels WHERE label <> 7),
best AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, i, j ORDER BY d, scene_id) AS rn
  FROM (SELECT *, coalesce(abs(scene_value - cube), 'inf'::DOUBLE) AS d FROM candidates WHERE scl IS NOT NULL)),
validities AS (SELECT item_id, i, j, count(DISTINCT scl IN (4, 5, 6)) AS v, count(*) AS n FROM best GROUP BY ALL),
sourced AS (
  SELECT p.*, CASE WHEN label <> 7 THEN 2 ELSE 0 END AS n_scenes, coalesce(n, 0)::INTEGER AS n_scenes_with_data,
         b.scene_id AS source_scene, b.scl AS source_scl, CASE WHEN isfinite(b.d) THEN b.d END AS source_b04_difference,
         coalesce(v > 1 AND b.d > 0.01, false) AS source_conflict
  FROM pixels p LEFT JOIN best b ON p.item_id = b.item_id AND p.i = b.i AND p.j = b.j AND rn = 1
  LEFT JOIN validities q ON p.item_id = q.item_id AND p.i = q.i AND p.j = q.j)"""


def source_scene_argmin(spark, sf_dir):
    return _sourced(spark, sf_dir).select(
        "item_id", "i", "j", "n_scenes", "n_scenes_with_data", "source_scene", "source_scl", "source_conflict",
        F.round("source_b04_difference", 6).alias("source_b04_difference"))


SOURCE_SCENE = "WITH" + PIXELS + "," + SOURCED + """
SELECT item_id, i, j, n_scenes, n_scenes_with_data, source_scene, source_scl, source_conflict,
       round(source_b04_difference, 6) AS source_b04_difference FROM sourced"""


def invalid_reason(spark, sf_dir):
    """Main rule, cube-class variants and the ordered reasons of every window pixel."""
    return P.validity(_sourced(spark, sf_dir)).select(
        "item_id", "i", "j", "valid", "valid_cube_scl_b02", "valid_cube_scl_only", "invalid_reason")


SCL_CASE = "CASE source_scl " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in C.SCL_NAMES.items()) + " END"
VALIDITY = f"""
judged AS (
  SELECT *, coalesce(source_scl IN (4, 5, 6), false) AND NOT source_conflict AS source_ok FROM sourced),
ruled AS (
  SELECT *, source_ok AND test_haze AND test_bands AND test_provenance AS valid,
         test_cube_scl AND test_haze AND test_bands AND test_provenance AS valid_cube_scl_b02,
         test_cube_scl AND test_bands AND test_provenance AS valid_cube_scl_only,
         nullif(concat_ws('; ',
           CASE WHEN observation_date IS NOT NULL AND NOT source_ok THEN CASE
             WHEN n_scenes = 0 THEN '{C.REASON_NO_SCENE}' WHEN n_scenes_with_data = 0 THEN '{C.REASON_SCENE_WITHOUT_DATA}'
             WHEN source_conflict THEN '{C.REASON_SCENE_CONFLICT}'
             ELSE '{C.REASON_SOURCE_CLASS} ' || source_scl || ' (' || {SCL_CASE} || ')' END END,
           CASE WHEN NOT test_bands THEN '{C.REASON_BAND_MISSING}' END,
           CASE WHEN NOT test_provenance THEN CASE WHEN observation_date IS NULL THEN '{C.REASON_PROVENANCE_MISSING}'
             ELSE '{C.REASON_PROVENANCE_OUTSIDE} (' || observation_date || ')' END END,
           CASE WHEN test_bands AND NOT test_haze THEN '{C.REASON_HAZE} (B02 ' || printf('%.3f', B02) || ' > {C.HAZE_B02_MAX})' END),
         '') AS invalid_reason
  FROM judged)"""
INVALID_REASON = "WITH" + PIXELS + "," + SOURCED + "," + VALIDITY + """
SELECT item_id, i, j, valid, valid_cube_scl_b02, valid_cube_scl_only, invalid_reason FROM ruled"""


def _composites(spark, sf_dir):
    return P.composite_rows(P.validity(_sourced(spark, sf_dir)), ["item_id"])


def window_stats(spark, sf_dir):
    """One row per composite: centre pixel and the statistics of the valid window pixels."""
    rows = _composites(spark, sf_dir)
    return rows.select(
        "item_id", "SCL", "source_scl", "source_scene", "observation_date", "valid", "invalid_reason",
        F.round("B04", 6).alias("B04"), "window_source_scenes", "window_n_pixels", "window_n_valid",
        *[F.round(f"window_{n}_{s}", 6).alias(f"window_{n}_{s}") for n in ("ndvi", "evi", "ndmi") for s in ("median", "sd")])


WINDOW_STATS = "WITH" + PIXELS + "," + SOURCED + "," + VALIDITY + """,
centre AS (SELECT * FROM ruled WHERE i = 0 AND j = 0),
win AS (
  SELECT item_id, count(*)::INTEGER AS window_n_pixels, count(*) FILTER (valid)::INTEGER AS window_n_valid,
         string_agg(DISTINCT source_scene, ';' ORDER BY source_scene) AS window_source_scenes, """ + ", ".join(
    f"round(quantile_cont({b}, 0.5) FILTER (valid), 6) AS window_{b.lower()}_median, "
    f"CASE WHEN count(*) FILTER (valid) >= 2 THEN round(stddev_pop({b}) FILTER (valid), 6) END AS window_{b.lower()}_sd"
    for b in ("NDVI", "EVI", "NDMI")) + """ FROM ruled GROUP BY item_id)
SELECT c.item_id, SCL, source_scl, source_scene, observation_date, valid, invalid_reason, round(B04, 6) AS B04,
       window_source_scenes, window_n_pixels, window_n_valid, window_ndvi_median, window_ndvi_sd, window_evi_median,
       window_evi_sd, window_ndmi_median, window_ndmi_sd
FROM centre c JOIN win w ON c.item_id = w.item_id"""


def item_per_period(spark, sf_dir):
    """One line item per supplier and month: the largest quantity, then the smallest identity; none for returns."""
    rows = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.trunc("l_shipdate", "MM").alias("start"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int")).alias("border_px"),
        F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey",
                    T.cents("l_extendedprice")).alias("item_id"))
    return R.one_item_per_period(rows, keys=["site"])


ITEM_PER_PERIOD = """
SELECT site, start, border_px, item_id FROM (
  SELECT l_suppkey AS site, date_trunc('month', l_shipdate)::DATE AS start,
         CASE WHEN l_returnflag <> 'R' THEN l_quantity::INTEGER END AS border_px,
         lpad(l_orderkey::VARCHAR, 12, '0') || '|' || l_linenumber || '|' || l_partkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT) AS item_id
  FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY site, start ORDER BY border_px IS NULL, border_px DESC, item_id) = 1"""


def _footprints(spark, sf_dir):
    """Orders as image footprints."""
    o = T.table(spark, sf_dir, "orders")
    west, south = F.floor(F.col("o_totalprice") / 4000) - 60.0, F.col("o_custkey") % 97 - 50.0
    return o.select(F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("start"),
                    F.date_add("o_orderdate", 15).alias("end"), west.alias("west"), (west + 1.5).alias("east"),
                    south.alias("south"), (south + 1.5).alias("north"))


def items_over_points(spark, sf_dir):
    """Suppliers as points, each with a window of its own: footprints that hold the point inside its window."""
    cut = F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("s_suppkey") * 97 % 1400).cast("int"))
    targets = T.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site"), (F.col("s_acctbal") / 150).alias("lon"),
        (F.col("s_nationkey") - 12.25).alias("lat"),
        cut.alias("cut"), F.date_sub(cut, 1095).alias("window_start"))
    return R.items_over_points(targets, _footprints(spark, sf_dir)).select("site", "item_id", "start", "end")


ITEMS_OVER_POINTS = """
SELECT s_suppkey AS site, o_orderkey AS item_id, o_orderdate::DATE AS start, o_orderdate::DATE + 15 AS end
FROM (SELECT *, floor(o_totalprice / 4000) - 60.0 AS west, o_custkey % 97 - 50.0 AS south FROM orders) o
JOIN supplier ON s_acctbal / 150 BETWEEN west AND west + 1.5 AND s_nationkey - 12.25 BETWEEN south AND south + 1.5
WHERE o_orderdate::DATE >= DATE '1995-01-01' + (s_suppkey * 97 % 1400)::INT - 1095
  AND o_orderdate::DATE + 15 <= DATE '1995-01-01' + (s_suppkey * 97 % 1400)::INT"""


def items_over_areas(spark, sf_dir):
    """Suppliers as areas of 6 by 5 degrees, each with a range of its own: footprints that overlap the area and start in the range."""
    lon, lat = F.col("s_acctbal") / 150, F.col("s_nationkey") - 12.25
    first = F.date_add(F.to_date(F.lit("1992-01-01")), (F.col("s_suppkey") * 97 % 1400).cast("int"))
    areas = T.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("area"), (lon - 3).alias("area_west"), (lon + 3).alias("area_east"),
        (lat - 2.5).alias("area_south"), (lat + 2.5).alias("area_north"), first.alias("first"), F.date_add(first, 1095).alias("last"))
    return R.items_over_areas(areas, _footprints(spark, sf_dir)).select("area", "item_id", "start")


ITEMS_OVER_AREAS = """
SELECT s_suppkey AS area, o_orderkey AS item_id, o_orderdate::DATE AS start
FROM (SELECT *, floor(o_totalprice / 4000) - 60.0 AS west, o_custkey % 97 - 50.0 AS south FROM orders) o
JOIN supplier ON west <= s_acctbal / 150 + 3 AND s_acctbal / 150 - 3 <= west + 1.5
  AND south <= s_nationkey - 12.25 + 2.5 AND s_nationkey - 12.25 - 2.5 <= south + 1.5
WHERE o_orderdate::DATE BETWEEN DATE '1992-01-01' + (s_suppkey * 97 % 1400)::INT AND DATE '1992-01-01' + (s_suppkey * 97 % 1400)::INT + 1095"""


# --- cloudiness -----------------------------------------------------------------------------------------------------

def _cloud_series(spark, sf_dir):
    """Suppliers as points in the landscape of their region; two validity rules per shipment; a point is a supplier in one year."""
    context = T.table(spark, sf_dir, "supplier").join(
        T.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        T.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    rows = T.table(spark, sf_dir, "lineitem")
    return rows.join(context, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("r_name").alias("landscape"), F.concat_ws("/", "l_suppkey", F.year("l_shipdate")).alias("point"),
        F.to_date("l_shipdate").alias("composite_start"), F.date_add("l_shipdate", 8).alias("observation_date"),
        (F.col("l_returnflag") == "N").alias("valid"), (F.col("l_quantity") > 20).alias("valid_cube_scl_b02"))


CLOUD_SERIES = """
series AS (
  SELECT r_name AS landscape, l_suppkey || '/' || year(l_shipdate) AS point, l_shipdate::DATE AS composite_start,
         l_shipdate::DATE + 8 AS observation_date, l_returnflag = 'N' AS valid, l_quantity > 20 AS valid_cube_scl_b02
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
ruled AS (
  SELECT 'valid' AS rule, *, valid AS ok FROM series UNION ALL SELECT 'valid_cube_scl_b02', *, valid_cube_scl_b02 FROM series),
per_point AS (
  SELECT rule, landscape, point, count(*) FILTER (ok) AS valid_n,
         count(DISTINCT quarter(observation_date)) FILTER (ok) AS quarters_with_valid,
         count(*) FILTER (ok) >= 10 AND count(DISTINCT quarter(observation_date)) FILTER (ok) = 4 AS passes
  FROM ruled GROUP BY ALL)"""


def coverage_calendar(spark, sf_dir):
    return K.point_coverage(_cloud_series(spark, sf_dir))


COVERAGE_CALENDAR = "WITH" + CLOUD_SERIES + """
SELECT rule, landscape, point, valid_n, quarters_with_valid::INTEGER AS quarters_with_valid, passes FROM per_point"""


def cloudiness_summary(spark, sf_dir):
    out = K.cloudiness_summary(_cloud_series(spark, sf_dir))
    return out.withColumn("valid_fraction", F.round("valid_fraction", 6)).withColumn("valid_median", F.round("valid_median", 6))


CLOUDINESS_SUMMARY = "WITH" + CLOUD_SERIES + f""",
fractions AS (
  SELECT rule, landscape, quarter(composite_start) AS q, avg(ok::INTEGER) AS f, grouping(landscape, quarter(composite_start)) AS g
  FROM ruled GROUP BY GROUPING SETS ((rule, landscape), (rule), (rule, quarter(composite_start)))),
counts AS (
  SELECT rule, landscape, quantile_cont(valid_n, 0.5) AS med, min(valid_n) AS lo, max(valid_n) AS hi,
         count(*) FILTER (passes) || '{C.PASS_SEPARATOR}' || count(*) AS pass, grouping(landscape) AS gl
  FROM per_point GROUP BY GROUPING SETS ((rule, landscape), (rule)))
SELECT CASE f.rule {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RULE_LABELS.items())} END AS rule,
       CASE WHEN g = 1 THEN f.landscape WHEN g = 3 THEN '{C.SLICE_ALL}' ELSE '{C.SLICE_QUARTER} ' || q END AS slice,
       round(f, 6) AS valid_fraction, round(med, 6) AS valid_median, lo AS valid_min, hi AS valid_max, pass AS points_passing
FROM fractions f LEFT JOIN counts c ON f.rule = c.rule
  AND ((g = 1 AND gl = 0 AND f.landscape = c.landscape) OR (g = 3 AND gl = 1))"""


def _observations(spark, sf_dir):
    """Events as scene readings: user = point, day of the event, class from the value (0 = no data)."""
    return T.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("point"), F.to_date("ts").alias("day"), F.col("value").alias("scene_cloud_pct"),
        F.nullif(F.floor(F.col("value")).cast("int") % 12, F.lit(0)).alias("scl"))


DAILY = """
readings AS (SELECT user_id AS point, ts::DATE AS day, value AS scene_cloud_pct, nullif(CAST(floor(value) AS INTEGER) % 12, 0) AS scl FROM events),
daily AS (
  SELECT point, day, bool_or(scl IN (4, 5, 6)) AS valid, round(quantile_cont(scene_cloud_pct, 0.5), 6) AS scene_cloud_pct,
         CAST(floor((day - DATE '2024-01-01') / 16.0) AS INTEGER) AS period16, strftime(day, '%Y-%m') AS month
  FROM readings WHERE scl IS NOT NULL GROUP BY point, day)"""
FIRST_DAY = "2024-01-01"


def daily_any_valid(spark, sf_dir):
    out = K.daily_observations(_observations(spark, sf_dir), FIRST_DAY)
    return out.withColumn("scene_cloud_pct", F.round("scene_cloud_pct", 6))


DAILY_ANY_VALID = "WITH" + DAILY + " SELECT * FROM daily"


def clean_per_point(spark, sf_dir):
    return K.clean_per_point(K.daily_observations(_observations(spark, sf_dir), FIRST_DAY))


CLEAN_PER_POINT = "WITH" + DAILY + """
SELECT point, count(*) AS observations, count(*) FILTER (valid) AS clean,
       count(DISTINCT period16) FILTER (valid) AS periods_with_clean FROM daily GROUP BY point"""


def clean_per_month(spark, sf_dir):
    return K.clean_per_month(K.daily_observations(_observations(spark, sf_dir), FIRST_DAY))


CLEAN_PER_MONTH = "WITH" + DAILY + " SELECT month, count(*) FILTER (valid) AS clean FROM daily GROUP BY month"


def observation_summary(spark, sf_dir):
    daily = K.daily_observations(_observations(spark, sf_dir), FIRST_DAY)
    out = K.observation_summary(daily, FIRST_DAY, "2024-01-31")
    return out.withColumn("clean_fraction", F.round("clean_fraction", 6))


OBSERVATION_SUMMARY = "WITH" + DAILY + """,
pp AS (SELECT point, count(*) FILTER (valid) AS clean, count(DISTINCT period16) FILTER (valid) AS periods FROM daily GROUP BY point)
SELECT (SELECT round(avg(valid::INTEGER), 6) FROM daily) AS clean_fraction,
       quantile_cont(clean, 0.5) AS clean_median, min(clean) AS clean_min, max(clean) AS clean_max, 1 AS periods_total,
       quantile_cont(periods, 0.5) AS periods_median, min(periods) AS periods_min, max(periods) AS periods_max,
       coalesce((SELECT string_agg(month, ',' ORDER BY month) FROM (SELECT month FROM daily GROUP BY month HAVING count(*) FILTER (valid) = 0)), '') AS months_without_clean
FROM pp"""


# --- scenes over areas, read at the points of each area: embeddings are scenes, regions areas, nations points --------

def _found_scenes(spark, sf_dir):
    first = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("r_regionkey") * 3).cast("int"))
    areas = T.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("area"), (F.col("r_regionkey") * 3.0).alias("area_west"), (F.col("r_regionkey") * 3.0 + 2).alias("area_east"),
        F.lit(0.25).alias("area_south"), F.lit(0.75).alias("area_north"), first.alias("first"), F.date_add(first, 45).alias("last"))
    west = (F.col("vec_id") % 16).cast("double")
    scenes = T.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("vec_id").cast("string").alias("href"), west.alias("west"), (west + 1.5).alias("east"),
        F.lit(0.0).alias("south"), F.lit(1.0).alias("north"), (F.col("vec_id") * 7 % 101).cast("double").alias("scene_cloud_pct"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("vec_id") % 60).cast("int")).alias("start"))
    return R.items_over_areas(areas, scenes).withColumn("day", F.col("start"))


def _scene_readings(spark, sf_dir, found):
    points = T.table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("area"), F.col("n_name").alias("point"), (F.col("n_nationkey") % 9 * 10 + 105.0).alias("x"),
        (195.0 - F.col("n_nationkey") * 3 % 8 * 10).alias("y"))
    classes = _blocks(spark, sf_dir).withColumn("values", F.transform("values", lambda v: (F.floor(F.abs(v) * 40) % 12).cast("double")))
    return K.scene_readings(found, points, _rasters(spark, sf_dir), classes, BLOCK)


SCENES = """
found AS (
  SELECT r_regionkey AS area, vec_id, DATE '2024-01-01' + (vec_id % 60)::INT AS day, (vec_id * 7 % 101)::DOUBLE AS cloud, embedding
  FROM embeddings JOIN region ON vec_id % 16 <= r_regionkey * 3 + 2 AND r_regionkey * 3 <= vec_id % 16 + 1.5
  WHERE vec_id % 60 BETWEEN r_regionkey * 3 AND r_regionkey * 3 + 45),
readings AS (
  SELECT n_name AS point, day, cloud, CASE WHEN n_nationkey % 9 < 8 THEN nullif(CAST(floor(abs(
           embedding[CAST(n_nationkey * 3 % 8 * 8 + n_nationkey % 9 + 1 AS INTEGER)]::DOUBLE) * 40) AS INTEGER) % 12, 0) END AS scl
  FROM found JOIN nation ON n_regionkey = area),
daily AS (
  SELECT point, day, bool_or(scl IN (4, 5, 6)) AS valid, quantile_cont(cloud, 0.5) AS scene_cloud_pct,
         CAST(floor((day - DATE '2024-01-01') / 16.0) AS INTEGER) AS period16, strftime(day, '%Y-%m') AS month
  FROM readings WHERE scl IS NOT NULL GROUP BY point, day)"""


def scene_observations(spark, sf_dir):
    """Scenes that overlap an area in its range, read at the area's points, as one observation per point and day."""
    found = _found_scenes(spark, sf_dir)
    return K.daily_observations(_scene_readings(spark, sf_dir, found), FIRST_DAY)


SCENE_OBSERVATIONS = "WITH" + SCENES + " SELECT * FROM daily"


def scene_summary(spark, sf_dir):
    """The same observations summarised, with the number of scenes and the median of their cloud shares."""
    found = _found_scenes(spark, sf_dir)
    daily = K.daily_observations(_scene_readings(spark, sf_dir, found), FIRST_DAY)
    return K.observation_summary(daily, FIRST_DAY, "2024-02-29", found).withColumn("clean_fraction", F.round("clean_fraction", 6))


SCENE_SUMMARY = "WITH" + SCENES + """,
pp AS (SELECT point, count(*) FILTER (valid) AS clean, count(DISTINCT period16) FILTER (valid) AS periods FROM daily GROUP BY point),
scenes AS (SELECT DISTINCT vec_id, cloud FROM found)
SELECT (SELECT count(*) FROM scenes) AS scenes, (SELECT quantile_cont(cloud, 0.5) FROM scenes) AS scene_cloud_median,
       (SELECT round(avg(valid::INTEGER), 6) FROM daily) AS clean_fraction,
       quantile_cont(clean, 0.5) AS clean_median, min(clean) AS clean_min, max(clean) AS clean_max, 3 AS periods_total,
       quantile_cont(periods, 0.5) AS periods_median, min(periods) AS periods_min, max(periods) AS periods_max,
       coalesce((SELECT string_agg(month, ',' ORDER BY month) FROM (SELECT month FROM daily GROUP BY month HAVING count(*) FILTER (valid) = 0)), '') AS months_without_clean
FROM pp"""


def status_contingency(spark, sf_dir):
    """Composites per supplier and status, zero where a status never occurs."""
    rows = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        S.composite_status(F.col("l_returnflag") == "N", F.col("l_quantity").cast("int") % 12,
                           F.when(F.col("l_tax") > 0.04, f"{C.REASON_HAZE} (B02)")).alias("status"))
    return K.status_table(rows)


STATUS_CONTINGENCY = f"""
WITH s AS (
  SELECT l_suppkey AS site, CASE WHEN l_returnflag = 'N' THEN '{C.STATUS_VALID}'
    WHEN l_quantity::INTEGER % 12 IN (8, 9, 10) THEN '{C.STATUS_CLOUD}' WHEN l_quantity::INTEGER % 12 = 3 THEN '{C.STATUS_SHADOW}'
    WHEN l_quantity::INTEGER % 12 IN (4, 5, 6) AND l_tax > 0.04 THEN '{C.STATUS_HAZE}' ELSE '{C.STATUS_OTHER}' END AS status FROM lineitem)
SELECT site, {", ".join(f'''count(*) FILTER (status = '{v}') AS "{v}"''' for v in C.STATUSES)} FROM s GROUP BY site"""


def clock_hours(spark, sf_dir):
    """Events per type with the spread of their fractional clock hour."""
    hour = S.fractional_hour(F.col("ts"))
    return T.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.min(hour), 6).alias("first_hour"),
        F.round(F.max(hour), 6).alias("last_hour"), F.round(F.avg(hour), 6).alias("mean_hour"))


CLOCK_HOURS = """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(min(h), 6) AS first_hour, round(max(h), 6) AS last_hour,
       round(avg(h), 6) AS mean_hour FROM (SELECT *, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM events) GROUP BY event_type"""


def grid_points(spark, sf_dir):
    """A 2×5 grid around every supplier taken as a landscape centre."""
    centres = T.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("landscape"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 1000.0).alias("y"))
    return R.point_grid(centres, dx=(-2, -1, 0, 1, 2), dy=(-0.5, 0.5), step=2000)


GRID_POINTS = """
SELECT s_suppkey || '-' || lpad((k * 5 + m)::VARCHAR, 2, '0') AS point, CAST(s_suppkey AS VARCHAR) AS landscape,
       s_acctbal + (m - 2) * 2000 AS x, (s_nationkey * 1000 + (k - 0.5) * 2000)::DOUBLE AS y
FROM supplier, (SELECT range AS k FROM range(2)) a, (SELECT range AS m FROM range(5)) b"""


QUERIES = {f.__name__: f for f in [
    locate, pixel_window, pixel_sample, zonal_cover, pixel_decode_tests, source_scene_argmin, invalid_reason, window_stats, item_per_period,
    items_over_points, items_over_areas, coverage_calendar, cloudiness_summary, daily_any_valid, clean_per_point, clean_per_month,
    observation_summary, scene_observations, scene_summary, status_contingency, clock_hours, grid_points]}
ORACLE = {
    "locate": LOCATE, "pixel_window": PIXEL_WINDOW, "pixel_sample": PIXEL_SAMPLE, "zonal_cover": ZONAL_COVER, "pixel_decode_tests": PIXEL_DECODE,
    "source_scene_argmin": SOURCE_SCENE, "invalid_reason": INVALID_REASON, "window_stats": WINDOW_STATS,
    "item_per_period": ITEM_PER_PERIOD, "items_over_points": ITEMS_OVER_POINTS, "coverage_calendar": COVERAGE_CALENDAR,
    "cloudiness_summary": CLOUDINESS_SUMMARY, "items_over_areas": ITEMS_OVER_AREAS, "daily_any_valid": DAILY_ANY_VALID, "clean_per_point": CLEAN_PER_POINT,
    "clean_per_month": CLEAN_PER_MONTH, "observation_summary": OBSERVATION_SUMMARY, "scene_observations": SCENE_OBSERVATIONS, "scene_summary": SCENE_SUMMARY,
    "status_contingency": STATUS_CONTINGENCY,
    "clock_hours": CLOCK_HOURS, "grid_points": GRID_POINTS}
