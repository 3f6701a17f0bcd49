"""Discs over blocked rasters against a direct test of every pixel, and what a read takes from the blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecoframe.operators import raster, zonal

SIZE = 8


def stored(grid, href="r"):
    out = []
    for br in range(-(-grid.shape[0] // SIZE)):
        for bc in range(-(-grid.shape[1] // SIZE)):
            block = np.zeros((SIZE, SIZE))
            part = grid[br * SIZE:(br + 1) * SIZE, bc * SIZE:(bc + 1) * SIZE]
            block[:part.shape[0], :part.shape[1]] = part
            out.append((href, br, bc, block.ravel().tolist()))
    return out


def tables(spark, grid, missing=()):
    rasters = spark.createDataFrame([("r", 1000.0, 5000.0, 10.0, grid.shape[1], grid.shape[0], -1.0)],
                                    "href string, x0 double, y0 double, res double, width int, height int, nodata double")
    blocks = [b for b in stored(grid) if b[1:3] not in missing]
    return rasters, spark.createDataFrame(blocks, "href string, block_row int, block_col int, values array<double>")


@pytest.mark.parametrize("chunk", [10_000, 2])
def test_zonal_cover_equals_every_pixel(spark, chunk, monkeypatch):
    monkeypatch.setattr(zonal, "CHUNK", chunk)
    r = np.random.default_rng(1)
    grid = r.choice([-1.0, 1.0, 2.0, 3.0], (29, 43), p=[0.1, 0.6, 0.2, 0.1])
    rasters, blocks = tables(spark, grid, missing={(1, 2)})
    xs, ys = 1000 + r.uniform(-60, 500, 40), 5000 - r.uniform(-60, 350, 40)
    places = [("r", f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))] + [("r", "grid", 1105.0, 4895.0), ("r", "far", 9e5, 9e5), ("r", "grid", 1105.0, 4895.0)]
    got = zonal.zonal_cover(spark.createDataFrame(places, "href string, point string, x double, y double"), rasters, blocks, [2, 3], (5.0, 30.0, 120.0), SIZE)
    grid[8:16, 16:24] = -1.0
    rows, cols = np.mgrid[:29, :43]
    expected = []
    for _, p, x, y in places:
        d2 = (1000 + (cols + 0.5) * 10 - x) ** 2 + (5000 - (rows + 0.5) * 10 - y) ** 2
        for radius in (5.0, 30.0, 120.0):
            disc = d2 <= radius * radius
            n, of = int((disc & (grid != -1)).sum()), int((disc & (grid >= 2)).sum())
            expected.append((p, radius, n, of, round(of / n, 9) if n else None, round(float(np.sqrt(d2[disc & (grid >= 2)].min())), 6) if of else None))
    rows = [(g.point, g.radius, g.n, g.native, None if g.cover is None else round(g.cover, 9), None if g.nearest is None else round(g.nearest, 6)) for g in got.collect()]
    assert sorted(set(map(str, rows))) == sorted(set(map(str, expected)))


def test_only_wanted_blocks_leave_the_scan(spark, tmp_path, monkeypatch):
    grid = np.arange(64.0 * 64).reshape(64, 64)
    rasters, blocks = tables(spark, grid)
    points = spark.createDataFrame([("r", 1075.0, 4925.0), ("r", 1635.0, 4365.0)], "href string, x double, y double")
    placed = raster.locate(points, rasters)
    for most in (500_000, 1):
        monkeypatch.setattr(raster, "MOST_WANTED", most)
        read = raster.read_window(placed, blocks, block_size=SIZE)
        got = {(v.x, v.i, v.j): v.raw for v in read.collect()}
        assert got[1075.0, 0, 0] == grid[7, 7] and got[1075.0, 1, 1] == grid[8, 8] and got[1075.0, -1, 1] == grid[6, 8]
        assert len(got) == 18 and got[1635.0, 0, 0] == grid[63, 63] and got[1635.0, 1, 0] == -1.0
    monkeypatch.setattr(raster, "MOST_WANTED", 500_000)
    br, bc, _ = raster._in_block(F.col("pixel_row"), F.col("pixel_col"), SIZE)
    kept = raster.wanted_blocks(placed.select("href", br.alias("_br"), bc.alias("_bc")), blocks)
    assert sorted((b._block_row, b._block_col) for b in kept.collect()) == [(0, 0), (7, 7)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
