"""Landscape descriptors: what covers the discs around points, from rasters stored in blocks.

A disc is a run of columns in each row of pixels that it crosses. A block of the raster keeps, for each of its rows, prefix sums
of valid and of native pixels and the nearest native pixel to either side, so a run costs a few lookups whatever its length. Only
blocks that a disc touches are read; each gives one partial row per disc, and partial rows add up. Blocks and their discs are
dealt into groups of bounded size, and a group is worked out as arrays over all its discs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe.operators.raster import BLOCK_SIZE, wanted_blocks

#: Radii of the surroundings in metres, fixed before evaluation.
RADII = (100.0, 500.0, 1000.0)
#: Discs that meet one copy of a block, and discs of one group of blocks.
CHUNK = 10_000
#: Pixels of the blocks of one group.
PIXELS = 1 << 20

_PARTS = "_id long, radius double, n long, native long, nearest2 double"


def _discs(points: DataFrame, rasters: DataFrame, radii: Sequence[float], block_size: int) -> DataFrame:
    """One row per point, radius and touched block."""
    each = points.join(rasters.select("href", "x0", "y0", "res", "width", "height", "nodata"), "href").withColumn(
        "radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))

    def blocks_between(low, high, size):
        first = F.greatest(F.floor(low / F.col("res")), F.lit(0))
        last = F.least(F.floor(high / F.col("res")), F.col(size) - 1)
        span = F.sequence(F.floor(first / block_size).cast("int"), F.floor(last / block_size).cast("int"))
        return F.explode(F.when(first <= last, span))

    dx, dy = F.col("x") - F.col("x0"), F.col("y0") - F.col("y")
    return each.withColumn("_br", blocks_between(dy - F.col("radius"), dy + F.col("radius"), "height")).withColumn(
        "_bc", blocks_between(dx - F.col("radius"), dx + F.col("radius"), "width"))


def _runs(discs: pd.DataFrame, at: np.ndarray, sums: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
    """Valid and native pixels of discs and the squared distance to the nearest native one, each disc in block ``at`` of a stack."""
    size = before.shape[1]
    x, y, radius, x0, y0, res, col0, row0 = (discs[c].to_numpy()[:, None] for c in ("x", "y", "radius", "x0", "y0", "res", "_col0", "_row0"))
    r2, line, at = radius * radius, np.arange(size)[None, :], at[:, None]
    dy2 = (y0 - (row0 + line + 0.5) * res - y) ** 2
    x_left, half = x0 + (col0 + 0.5) * res, np.sqrt(np.maximum(r2 - dy2, 0))
    dx2 = lambda c: (x0 + (col0 + c + 0.5) * res - x) ** 2
    low, high = np.ceil((x - half - x_left) / res).astype(np.int64), np.floor((x + half - x_left) / res).astype(np.int64)
    # The test of a pixel is dx² + dy² <= r²; the ends of a run, found by a root, are set to agree with it.
    low -= dx2(low - 1) + dy2 <= r2
    low += ~(dx2(low) + dy2 <= r2)
    high += dx2(high + 1) + dy2 <= r2
    high -= ~(dx2(high) + dy2 <= r2)
    low, high = np.maximum(low, 0), np.minimum(high, size - 1)
    some = (dy2 <= r2) & (low <= high)
    low, high = np.where(some, low, 0), np.where(some, high, -1)
    n, of = ((m[at, line, high + 1] - m[at, line, low]).sum(axis=1) for m in sums)
    centre = np.clip(np.round((x - x_left) / res).astype(np.int64), low, np.maximum(high, 0))
    left, right = before[at, line, centre], after[at, line, centre]
    nearest = np.minimum(*(np.where(some & there, dx2(c) + dy2, np.inf).min(axis=1) for c, there in ((left, left >= low), (right, right <= high))))
    return pd.DataFrame({"_id": discs["_id"].to_numpy(), "radius": discs["radius"].to_numpy(), "n": n.astype(np.int64),
                         "native": of.astype(np.int64), "nearest2": np.where(of > 0, nearest, np.nan)})


def _counted(discs: pd.DataFrame, blocks: pd.DataFrame, size: int, classes: np.ndarray) -> pd.DataFrame:
    """The partial rows of many discs in many blocks, which are taken in stacks of some PIXELS pixels."""
    keys = ["href", "_br", "_bc", "_chunk"]
    blocks = blocks.drop_duplicates(keys).reset_index(drop=True)
    discs = discs.merge(blocks[keys].assign(_at=np.arange(len(blocks))), on=keys).sort_values("_at", kind="stable")
    discs = discs.assign(_row0=discs["_br"].astype(np.int64) * size, _col0=discs["_bc"].astype(np.int64) * size)
    touched, first, at = np.unique(discs["_at"].to_numpy(), return_index=True, return_inverse=True)
    out = [pd.DataFrame({"_id": [], "radius": [], "n": [], "native": [], "nearest2": []})]
    stack, most = max(1, PIXELS // (size * size)), max(1, PIXELS // (4 * size))
    for start in range(0, len(touched), stack):
        mine, of = touched[start:start + stack], discs.iloc[first[start:start + stack]]
        values = np.stack([np.asarray(v, dtype=float).reshape(size, size) for v in blocks["_values"].iloc[mine]])
        row0, col0, height, width, nodata = (of[c].to_numpy()[:, None, None] for c in ("_row0", "_col0", "height", "width", "nodata"))
        span = np.arange(size)
        valid = (row0 + span[:, None] < height) & (col0 + span < width) & ~np.isnan(values) & ~(values == nodata)
        native = valid & np.isin(values, classes)
        sums = [np.pad(np.cumsum(m, axis=2, dtype=np.int32), ((0, 0), (0, 0), (1, 0))) for m in (valid, native)]
        before = np.maximum.accumulate(np.where(native, span, -1), axis=2)
        after = np.minimum.accumulate(np.where(native, span, size)[:, :, ::-1], axis=2)[:, :, ::-1]
        low, high = np.searchsorted(at, [start, start + stack])
        out += [_runs(discs.iloc[i:min(i + most, high)], at[i:min(i + most, high)] - start, sums, before, after) for i in range(low, high, most)]
    return pd.concat(out[1:] or out)


def zonal_cover(points: DataFrame, rasters: DataFrame, blocks: DataFrame, classes: Sequence[float],
                radii: Sequence[float] = RADII, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Per point (href, point, x, y) and radius: valid and native pixels, share of native cover, distance to the nearest native pixel.

    A pixel belongs to a disc if its centre does. Pixels outside the raster, without a stored block, NaN or equal to nodata are not
    valid. Without valid pixels the share is NULL, without native ones the distance. A block that very many discs touch is
    copied once for each CHUNK of them. Copies are dealt into groups of some CHUNK discs and PIXELS pixels, so that small blocks do not
    cost a group each.
    """
    keyed = points.select("href", "point", "x", "y").withColumn("_id", F.xxhash64("href", "point", "x", "y"))
    discs = _discs(keyed.distinct(), rasters, radii, block_size)
    sizes = discs.groupBy("href", "_br", "_bc").agg(F.count(F.lit(1)).alias("_discs")).withColumn(
        "_chunks", F.ceil(F.col("_discs") / CHUNK).cast("int"))
    counts = sizes.drop("_discs")
    stored = wanted_blocks(counts.select("href", "_br", "_bc"), blocks)
    copies = stored.join(counts.select(F.col("href").alias("h"), "_br", "_bc", "_chunks").hint("merge"), (F.col("_href") == F.col("h"))
                         & (F.col("_block_row") == F.col("_br")) & (F.col("_block_col") == F.col("_bc")))
    copies = copies.select(F.col("_href").alias("href"), "_br", "_bc", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "_values")
    dealt = discs.join(counts.hint("merge"), ["href", "_br", "_bc"]).withColumn("_chunk", F.pmod(F.xxhash64("_id", "radius"), "_chunks").cast("int"))
    groups = sizes.agg(F.ceil(F.greatest(F.sum("_discs") / CHUNK, F.sum("_chunks") * block_size * block_size / PIXELS))).scalar()
    group = F.pmod(F.xxhash64("href", "_br", "_bc", "_chunk"), groups).alias("_group")
    native = np.array(sorted(float(c) for c in classes))

    def count(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _counted(mine, held, block_size, native)

    parts = dealt.drop("_chunks", "point").select("*", group).groupBy("_group").cogroup(
        copies.select("*", group).groupBy("_group")).applyInPandas(count, _PARTS)
    total = parts.groupBy("_id", "radius").agg(F.sum("n").alias("n"), F.sum("native").alias("native"), F.min("nearest2").alias("nearest2"))
    wanted = keyed.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    n, of = F.coalesce("n", F.lit(0)), F.coalesce("native", F.lit(0))
    return wanted.join(total, ["_id", "radius"], "left").select(
        "href", "point", "radius", n.alias("n"), of.alias("native"), F.try_divide(of, n).alias("cover"), F.sqrt("nearest2").alias("nearest"))
