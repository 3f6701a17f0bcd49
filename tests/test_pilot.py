"""The pilot from files to the analytical table, on tiny synthetic recordings, rasters and scenes."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe import schemas
from ecoframe.plans import pilot
from ecoframe.sources import items as catalogue_items
from ecoframe.sources import tables
from tests.test_sources import HEAD, wav

SITES = ["RBA", "RGU"]
RAW = {"B02": 200, "B04": 300, "B08": 3000, "B8A": 2800, "B11": 1400, "NDVI": 8000, "EVI": 5000, "SCL": 4, "CLEAROB": 2, "TOTALOB": 3}


def feature(name, start, end, assets, acquired=None):
    return json.dumps({"id": name, "bbox": [-37, -7, -35, -5], "assets": assets, "properties": {
        "start_datetime": f"{start}T00:00:00Z", "end_datetime": f"{end}T00:00:00Z", "datetime": acquired and f"{acquired}T13:00:00Z",
        "bdc:tiles": ["041012"], "eo:cloud_cover": 10.0}})


def test_pilot(spark, tmp_path):
    for site in SITES:
        for day in ("20221009", "20221010"):
            wav(tmp_path / "audio" / site / f"{site}_{day}_050240.wav", 60)
    (tmp_path / "m.csv").write_text(HEAD + "".join(
        f"{s},Area,Brazil,Forest,{lat},-35.97,Mic,yes,8 kHz,2022,2,c,r\n" for s, lat in (("RBA", -6.07), ("RGU", -6.47))))
    (tmp_path / "a.csv").write_text("Site,Recording,Species,Begin_Time_(s),End_Time_(s),Low_Freq_(Hz),High_Freq_(Hz)\n" + "".join(
        f"{s},{s}_{d}_050240.wav,sp{k},1,2,3,4\n" for s in SITES for d, k in (("20221009", 1), ("20221010", 2), ("20221010", 1))))
    t = pilot.ingest(spark, str(tmp_path / "audio"), str(tmp_path / "m.csv"), str(tmp_path / "a.csv"), SITES)
    assert t["quality_report"].isEmpty()

    # rasters of 8×8 pixels hold the first site only; a composite every 16 days of the year before the cut
    crs, rasters, blocks, features, scenes = "EPSG:4326", [], [], [], []

    def add(href, value):
        rasters.append((href, -36.0, -6.0, 0.05, 8, 8, -9999.0, crs))
        blocks.extend((href, r, c, [float(value)] * 16) for r in (0, 1) for c in (0, 1))

    starts = [dt.date(2021, 10, 8) + dt.timedelta(days=16 * i) for i in range(23)]
    for n, start in enumerate(starts):
        end, day = start + dt.timedelta(days=15), start + dt.timedelta(days=5)
        assets = {}
        for band, raw in {**RAW, "PROVENANCE": day.timetuple().tm_yday}.items():
            nodata = -1 if band == "PROVENANCE" else 0
            assets[band] = {"href": f"{n}/{band}", "eo:bands": [{"nodata": nodata, **({} if band in C.QUALITY_BANDS else {"scale": 1e-4})}]}
            add(f"{n}/{band}", raw)
        features.append(feature(f"item{n}", start, end, assets))
        scenes.append(feature(f"S2A_N0301_{n}", start, end, {b: {"href": f"s{n}/{b}"} for b in ("SCL", "B04")}, day))
        add(f"s{n}/SCL", 9 if n == 3 else 5)
        add(f"s{n}/B04", 300)
    as_items = lambda rows: catalogue_items.items_from_json(spark.createDataFrame([(r,) for r in rows], "value string"))
    rasters = spark.createDataFrame(rasters, "href string, x0 double, y0 double, res double, width int, height int, nodata double, crs string")
    blocks = spark.createDataFrame(blocks, "href string, block_row int, block_col int, values array<double>")
    targets = pilot.image_targets(t["campaigns"], t["points"])
    assert targets.select("cut", "window_start").distinct().collect() == [(dt.date(2022, 10, 8), dt.date(2021, 10, 8))]
    series = pilot.optical_series(targets, as_items(features), as_items(scenes), rasters, blocks, block_size=4)
    tables.write_table(series, str(tmp_path / "series"), "series")
    series = spark.read.parquet(str(tmp_path / "series"))

    assert set(series.columns) == set(schemas.columns("series"))
    rows = {(r.site, r.item_id): r for r in series.collect()}
    assert len(rows) == 44  # the last period ends after the cut
    good = rows["RBA", "item0"]
    assert good.valid and good.window_n_valid == 6 and good.n_scenes == 1 and good.source_scene == "S2A_N0301_0"
    assert good.observation_date == starts[0] + dt.timedelta(days=5) and good.source_b04_difference < 1e-12
    assert rows["RBA", "item3"].invalid_reason.startswith("SCL origem 9") and rows["RBA", "item3"].window_n_valid == 0
    outside = rows["RGU", "item0"]
    assert (outside.invalid_reason, outside.window_n_pixels, outside.NDVI, outside.valid) == (C.REASON_OUTSIDE_RASTER, 0, None, False)
    coverage = {r.site: r for r in pilot.series_coverage(series).collect()}
    assert (coverage["RBA"].periods, coverage["RBA"].periods_expected, coverage["RBA"].covered_days, coverage["RBA"].valid) == (22, 22, 351, 21)

    table = {r.site: r for r in pilot.integrate(t["recordings"], t["detections"], t["campaigns"], t["points"], series).collect()}
    assert list(table["RBA"].asDict()) == schemas.columns("analytical_table")
    assert (table["RBA"].species, table["RBA"].valid_minutes, table["RBA"].rarefied_richness) == ("sp1;sp2", 2, 2.0)
    assert table["RBA"].coverage_ok and abs(table["RBA"].ndvi_median - 0.8) < 1e-9 and not table["RGU"].coverage_ok
    back = schemas.to_export(spark.createDataFrame(list(table.values()), schemas.schema("analytical_table")), "analytical_table")
    assert back.columns[0] == "sitio" and back.columns[10] == "especies" and F.col
