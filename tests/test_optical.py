import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.operators import cloudiness as K
from ecoframe.operators import composites as P
from ecoframe.operators import raster as R
from ecoframe.operators.descriptors import optical_descriptors

CUT = dt.date(2022, 12, 31)


# --- descriptors --------------------------------------------------------------------------------------------

def series(spark, n, step, first=dt.date(2022, 1, 5), valid=9, observed=None):
    rows = []
    for i in range(n):
        start = first + dt.timedelta(days=i * step)
        rows.append(("A", "A-1", CUT, start, valid if i else (3 if valid == 9 and step == 16 else valid), 0.70 + 0.01 * i,
                     0.3 if i < 18 else 0.2, observed.get(i) if observed else None))
    frame = spark.createDataFrame(rows, "site string, campaign_id string, cut date, composite_start date, window_n_valid int, "
                                        "window_ndvi_median double, window_ndmi_median double, observation_date date")
    return frame if observed is not None else frame.drop("observation_date")


def test_uncovered_series_has_no_descriptors(spark):
    row = optical_descriptors(series(spark, 12, 14)).first()
    assert not row.coverage_ok and row.quarters_covered < 4
    assert (row.ndvi_median, row.ndmi_median, row.ndvi_amplitude_p90_p10, row.ndmi_recent_change) == (None,) * 4


def test_covered_series(spark):
    row = optical_descriptors(series(spark, 22, 16)).first()
    ndvi = [0.70 + 0.01 * i for i in range(1, 22)]
    assert (row.composites, row.composites_used, row.coverage_ok) == (22, 21, True)
    assert row.ndvi_median == pytest.approx(np.median(ndvi))
    assert row.ndvi_amplitude_p90_p10 == pytest.approx(np.percentile(ndvi, 90) - np.percentile(ndvi, 10))
    assert row.ndmi_recent_change < 0


def test_recent_change_needs_two_in_the_last_quarter(spark):
    only_one = series(spark, 22, 16).where((F.col("composite_start") < "2022-09-15") | (F.col("composite_start") > "2022-12-01"))
    row = optical_descriptors(only_one).first()
    assert row.coverage_ok and row.n_last_quarter == 1 and row.ndmi_recent_change is None


def test_observation_date_decides_the_quarter(spark):
    without = optical_descriptors(series(spark, 22, 16)).first().n_last_quarter
    moved = optical_descriptors(series(spark, 22, 16, observed={21: dt.date(2022, 9, 1)})).first().n_last_quarter
    assert moved == without - 1


# --- composites ------------------------------------------------------------------------------------------------

RAW = {"B02": 350, "B04": 510, "B08": 2650, "B8A": 2400, "B11": 800, "NDVI": 6770, "EVI": 3900, "SCL": 5, "CLEAROB": 1, "TOTALOB": 4, "PROVENANCE": 170}
NODATA = {"NDVI": -9999.0, "EVI": -9999.0, "PROVENANCE": -1.0}
READING = "item_id string, i int, j int, scene_id string, scl int, b04_dn double"


def composite(spark, changes=None, source=4, readings=None, pixel_changes=None, drop_scale=None, drop_nodata=None):
    rows = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            for band, raw in {**RAW, **(changes or {}), **(pixel_changes or {}).get((i, j), {})}.items():
                rows.append(("it", band, i, j, float(raw), None if band == drop_nodata else NODATA.get(band, 0.0),
                             None if band in C.QUALITY_BANDS or band == drop_scale else 1e-4))
    long = spark.createDataFrame(rows, "item_id string, band string, i int, j int, raw double, nodata double, scale double")
    pixels = P.quality_tests(P.decode(long, ["item_id"]).withColumn("composite_start", F.to_date(F.lit("2019-06-10"))).withColumn(
        "composite_end", F.to_date(F.lit("2019-06-25"))))
    if readings is None:
        scl = source if isinstance(source, dict) else {(i, j): source for i in (-1, 0, 1) for j in (-1, 0, 1)}
        readings = [("it", i, j, "S2A_N0301_A", v, float(RAW["B04"])) for (i, j), v in scl.items()]
    sourced = P.choose_source_scene(pixels, spark.createDataFrame(readings, READING), ["item_id"])
    return P.composite_rows(P.validity(sourced), ["item_id"]).first()


def test_valid_composite(spark):
    row = composite(spark)
    assert [row.B02, row.B04, row.NDVI, row.NDMI] == pytest.approx([0.035, 0.051, 0.677, 0.5])
    assert (row.SCL, row.PROVENANCE, row.valid, row.invalid_reason) == (5, 170, True, None) and row.observation_date == dt.date(2019, 6, 19)
    assert [row.window_n_pixels, row.window_n_valid, row.window_ndvi_median, row.window_ndvi_sd] == pytest.approx([9, 9, 0.677, 0.0])


# The wording of the reasons.
@pytest.mark.parametrize("changes,source,reason,cube_b02,cube_only", [
    ({}, 3, f"SCL origem 3 ({C.SCL_NAMES[3]})", True, True),
    ({"EVI": -9999}, 10, f"SCL origem 10 ({C.SCL_NAMES[10]}); banda sem dado", False, False),
    ({"B11": 0}, 5, "banda sem dado", False, False),
    ({"PROVENANCE": -1}, 5, "PROVENANCE sem dado", False, False),
    ({"PROVENANCE": 200}, 5, "PROVENANCE fora do período (2019-07-19)", False, False),
    ({"B02": 1730, "SCL": 4}, 4, "névoa (B02 0.173 > 0.1)", False, True),
    ({"B02": 170_625}, 5, "névoa (B02 17.062 > 0.1)", False, True),
])
def test_invalid_reasons(spark, changes, source, reason, cube_b02, cube_only):
    row = composite(spark, changes, source)
    assert (row.valid, row.invalid_reason, row.valid_cube_scl_b02, row.valid_cube_scl_only) == (False, reason, cube_b02, cube_only)


def test_cube_class_alone_does_not_invalidate(spark):
    row = composite(spark, {"SCL": 9})
    assert row.valid and not row.valid_cube_scl_b02 and not row.valid_cube_scl_only


def test_missing_scenes(spark):
    assert composite(spark, readings=[("other", 0, 0, "s", 4, 1.0)]).invalid_reason == C.REASON_NO_SCENE
    assert composite(spark, source=None).invalid_reason == C.REASON_SCENE_WITHOUT_DATA


def test_metadata_contract(spark):
    with pytest.raises(Exception, match="without scale"):
        composite(spark, drop_scale="B04")
    with pytest.raises(Exception, match="without nodata"):
        composite(spark, drop_nodata="SCL")


def test_window_statistics_use_valid_pixels_only(spark):
    source = {(i, j): 4 for i in (-1, 0, 1) for j in (-1, 0, 1)} | {(-1, -1): 9}
    row = composite(spark, source=source, pixel_changes={(-1, -1): {"NDVI": 1000}, (1, 1): {"NDVI": 9000}})
    assert (row.window_n_pixels, row.window_n_valid) == (9, 8) and row.window_ndvi_median == pytest.approx(0.8)
    assert row.window_ndvi_sd == pytest.approx(np.std([0.8] * 7 + [0.9]))


def test_nearest_scene_wins_and_conflicts_are_marked(spark):
    cube = {"B04": 500}  # 0.05
    a, b = "S2A_N0400_A", "S2B_N0301_B"
    every = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    first = composite(spark, cube, readings=[r for i, j in every for r in (("it", i, j, a, 9 if j < 1 else None, 1900.0), ("it", i, j, b, 4, 500.0))])
    assert (first.source_scene, first.source_scl, first.source_conflict, first.valid) == (b, 4, False, True)
    second = composite(spark, cube, readings=[r for i, j in every for r in (("it", i, j, a, 9, 1900.0 + 900), ("it", i, j, b, 4, 800.0))])
    assert second.source_conflict and second.invalid_reason == C.REASON_SCENE_CONFLICT
    # without any red value the smallest id stays, in conflict only if the classes disagree, and no difference is reported
    third = composite(spark, cube, readings=[r for i, j in every for r in (("it", i, j, b, 4, None), ("it", i, j, a, 5, None))])
    assert (third.source_scene, third.source_conflict, third.source_b04_difference, third.n_scenes) == (a, False, None, 2)
    assert third.window_source_scenes == a


def test_invariant_valid_means_no_reason(spark):
    import catalogue.optical as Q
    rows = Q.invalid_reason(spark, "/root/testdata/sf0.001")
    assert rows.where(F.col("valid") == F.col("invalid_reason").isNotNull()).isEmpty()


# --- rasters ----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def grid(spark):
    rasters = spark.createDataFrame([("r", -36.0, -6.0, 0.1, 10, 10, -9999.0)], "href string, x0 double, y0 double, res double, width int, height int, nodata double")
    values = np.arange(100).reshape(10, 10) + 1
    blocks = []
    for br in range(3):
        for bc in range(3):
            block = np.full((4, 4), -9999.0)
            part = values[br * 4:br * 4 + 4, bc * 4:bc * 4 + 4]
            block[:part.shape[0], :part.shape[1]] = part
            blocks.append(("r", br, bc, block.ravel().tolist()))
    return rasters, spark.createDataFrame(blocks, "href string, block_row int, block_col int, values array<double>"), values


def test_location(spark, grid):
    points = spark.createDataFrame([("r", -35.75, -6.35)], "href string, x double, y double")
    row = R.locate(points, grid[0]).first()
    assert (row.pixel_row, row.pixel_col, row.border_px) == (3, 2, 2)
    assert (row.x_centre, row.y_centre) == (pytest.approx(-35.75), pytest.approx(-6.35))
    far = spark.createDataFrame([("r", -30.0, -6.35)], "href string, x double, y double")
    with pytest.raises(Exception, match="point outside raster r"):
        R.locate(far, grid[0]).collect()
    assert R.locate(far, grid[0], strict=False).first().border_px is None


def test_windows_cross_blocks_and_are_filled_outside(spark, grid):
    rasters, blocks, values = grid
    points = spark.createDataFrame([("mid", "r", -35.65, -6.35), ("corner", "r", -35.95, -6.05)], "id string, href string, x double, y double")
    rows = R.read_window(R.locate(points, rasters), blocks, block_size=4).collect()
    mid = {(r.i, r.j): r.raw for r in rows if r.id == "mid"}
    assert mid == {(i, j): values[3 + i, 3 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    corner = {(r.i, r.j): r.raw for r in rows if r.id == "corner"}
    assert all(corner[k] == -9999.0 for k in corner if -1 in k) and corner[0, 0] == 1 and len(corner) == 9


def test_window_centres(spark):
    cell = spark.createDataFrame([(-30.0, 55.0, 4.0)], "x_centre double, y_centre double, res double")
    x, y = R.window_centres(F.col("x_centre"), F.col("y_centre"), F.col("res"))
    got = {(r.i, r.j): (r.x, r.y) for r in R.expand_window(cell).select("i", "j", x.alias("x"), y.alias("y")).collect()}
    assert got == {(i, j): (-30.0 + 4 * j, 55.0 - 4 * i) for i in (-1, 0, 1) for j in (-1, 0, 1)}


def test_items_inside_the_window(spark):
    spans = {"before": ("2018-02-25", "2018-03-12"), "inside": ("2018-03-13", "2018-03-28"), "up to the cut": ("2019-02-18", "2019-03-05"), "past it": ("2019-02-18", "2019-03-06")}
    items = spark.createDataFrame([(k, *map(dt.datetime.fromisoformat, v), 10.0, 46.0, 11.0, 47.0) for k, v in spans.items()],
                                  "item_id string, start timestamp, end timestamp, west double, south double, east double, north double")
    targets = spark.createDataFrame([("S", 10.5, 46.2, dt.date(2018, 3, 5), dt.date(2019, 3, 5))], "site string, lon double, lat double, window_start date, cut date")
    assert {r.item_id for r in R.items_over_points(targets, items).collect()} == {"inside", "up to the cut"}


def test_one_item_per_period(spark):
    rows = spark.createDataFrame([("S", "q", period, border, item) for period, border, item in [
        (7, 3, "a"), (7, 12, "k"), (8, None, "z"), (8, None, "m"), (9, 40, "t"), (9, 40, "r")]],
        "site string, campaign_id string, start int, border_px int, item_id string")
    assert {r.start: (r.item_id, r.border_px) for r in R.one_item_per_period(rows).collect()} == {7: ("k", 12), 8: ("m", None), 9: ("r", 40)}


def test_point_grid(spark):
    centres = spark.createDataFrame([("U", 100.0, 1000.0)], "landscape string, x double, y double")
    got = {r.point: (r.x, r.y) for r in R.point_grid(centres, (-2, -1, 0, 1, 2), (-0.5, 0.5), 2000).collect()}
    assert len(got) == 10 and got["U-00"] == (-3900.0, 0.0) and got["U-09"] == (4100.0, 2000.0)


# --- cloudiness ------------------------------------------------------------------------------------------------------------

def test_daily_reduction_and_periods(spark):
    readings = spark.createDataFrame([
        ("P0", dt.date(2020, 10, 1), 10.0, 9), ("P0", dt.date(2020, 10, 1), 30.0, 4), ("P0", dt.date(2020, 10, 16), 5.0, 5),
        ("P0", dt.date(2020, 10, 17), 5.0, 8), ("P1", dt.date(2020, 11, 2), 50.0, None), ("P1", dt.date(2020, 11, 2), 60.0, 9)],
        "point string, day date, scene_cloud_pct double, scl int")
    daily = K.daily_observations(readings, "2020-10-01")
    got = {(r.point, str(r.day)): (r.valid, r.scene_cloud_pct, r.period16, r.month) for r in daily.collect()}
    assert got == {("P0", "2020-10-01"): (True, 20.0, 0, "2020-10"), ("P0", "2020-10-16"): (True, 5.0, 0, "2020-10"),
                   ("P0", "2020-10-17"): (False, 5.0, 1, "2020-10"), ("P1", "2020-11-02"): (False, 60.0, 2, "2020-11")}
    assert {r.point: tuple(r)[1:] for r in K.clean_per_point(daily).collect()} == {"P0": (3, 2, 1), "P1": (1, 0, 0)}
    row = K.observation_summary(daily, "2020-10-01", "2021-09-30").first()
    assert (row.clean_fraction, row.clean_median, row.periods_total, row.months_without_clean) == (0.5, 1.0, 22, "2020-11")
