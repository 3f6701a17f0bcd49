"""Coordinate systems: transverse Mercator grids as column arithmetic, other systems through a projection library."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: ellipsoids (semi-major axis, inverse flattening) --------------------------------
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS67": (6378160.0, 298.25)}
# --- Fixed values: geocentric shift from SAD69 to WGS84 (m) -----------------------------------------
SAD69_TO_WGS84 = (-67.35, 3.88, -38.22)


def utm_to_lon_lat(x: Column, y: Column, zone: int, south: bool = True, ellipsoid: str = "WGS84") -> tuple[Column, Column]:
    """Inverse UTM by the Krüger series (third order): longitude and latitude in degrees on the same datum."""
    a, inverse = ELLIPSOIDS[ellipsoid]
    n = 1 / (2 * inverse - 1)
    radius = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    beta = (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96, n ** 2 / 48 + n ** 3 / 15, 17 * n ** 3 / 480)
    delta = (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3, 7 * n ** 2 / 3 - 8 * n ** 3 / 5, 56 * n ** 3 / 15)
    xi = (y - (1e7 if south else 0.0)) / (0.9996 * radius)
    eta = (x - 5e5) / (0.9996 * radius)
    xi_, eta_ = xi, eta
    for k, b in enumerate(beta, 1):
        xi_ = xi_ - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        eta_ = eta_ - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    conformal = F.asin(F.sin(xi_) / F.cosh(eta_))
    latitude = conformal
    for k, d in enumerate(delta, 1):
        latitude = latitude + d * F.sin(2 * k * conformal)
    longitude = F.atan2(F.sinh(eta_), F.cos(xi_)) + math.radians(zone * 6 - 183)
    return F.degrees(longitude), F.degrees(latitude)


def shift_datum(longitude: Column, latitude: Column, source: str, target: str, shift: tuple[float, float, float]) -> tuple[Column, Column]:
    """Longitude and latitude on another datum, by a geocentric translation at height 0."""
    a, inverse = ELLIPSOIDS[source]
    e2 = (2 - 1 / inverse) / inverse
    lon, lat = F.radians(longitude), F.radians(latitude)
    normal = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    gx = normal * F.cos(lat) * F.cos(lon) + shift[0]
    gy = normal * F.cos(lat) * F.sin(lon) + shift[1]
    gz = normal * (1 - e2) * F.sin(lat) + shift[2]
    b, inverse_b = ELLIPSOIDS[target]
    minor = b * (1 - 1 / inverse_b)
    f2, second = (2 - 1 / inverse_b) / inverse_b, (b * b - minor * minor) / (minor * minor)
    distance = F.sqrt(gx * gx + gy * gy)
    reduced = F.atan2(gz * b, distance * minor)  # Bowring's closed form
    s, c = F.sin(reduced), F.cos(reduced)
    new_lat = F.atan2(gz + second * minor * s * s * s, distance - f2 * b * c * c * c)
    return F.degrees(F.atan2(gy, gx)), F.degrees(new_lat)


def transform_points(x: Column, y: Column, source: Column, target: Column) -> Column:
    """struct(x, y) in another system; pairs of different systems need pyproj on the executors."""
    @F.pandas_udf("x double, y double")
    def run(xs: pd.Series, ys: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"x": xs.astype(float), "y": ys.astype(float)})
        for (source_, target_), at in pd.DataFrame({"a": a, "b": b}).groupby(["a", "b"]).groups.items():
            if source_ != target_:
                from pyproj import Transformer
                moved = Transformer.from_crs(source_, target_, always_xy=True).transform(xs[at].to_numpy(), ys[at].to_numpy())
                out.loc[at, "x"], out.loc[at, "y"] = moved
        return out
    return run(x, y, source, target)
