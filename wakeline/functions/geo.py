"""Geodesy as Spark expressions (inside whole-stage codegen), plus the ellipsoidal azimuth in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius of distances, the radius of radial boxes, the Mercator radius, knots per m/s.
EARTH_M = 6371008.8
BOX_EARTH_M = 6371088.0
MERCATOR_M = 6378137.0
KNOTS = 1.9438445
SCORE_KNOTS = 1.9438444924406
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; null where any coordinate is null (``least`` alone would hide that)."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.when(h.isNotNull(), 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def distance_3d(lon1: Column, lat1: Column, lon2: Column, lat2: Column, depth: Column) -> Column:
    d = haversine(lon1, lat1, lon2, lat2)
    return F.sqrt(d * d + depth * depth)


def knots(metres: Column, seconds: Column) -> Column:
    """Speed over a leg; legs of no time count as one second."""
    return F.when(seconds.isNotNull(), metres / F.greatest(F.lit(1.0), seconds.cast("double")) * KNOTS)


def shift_coordinate(x: Column, rng: float = 180.0) -> Column:
    """Wrap into [-rng, rng]; a value of exactly rng changes its sign."""
    wrapped = F.when(F.abs(x) != rng, F.pmod(x + rng, F.lit(360.0)) - rng).otherwise(x)
    return F.when(F.abs(wrapped) == rng, -wrapped).otherwise(wrapped)


def radial_box(lon: Column, lat: Column, radius_m: Column | float) -> dict[str, Column]:
    """Degree box around a point."""
    r = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    dx = F.degrees(r / (BOX_EARTH_M * F.cos(F.radians(lat))))
    dy = F.degrees(r / F.lit(BOX_EARTH_M))
    return {"xmin": lon - dx, "xmax": lon + dx, "ymin": lat - dy, "ymax": lat + dy}


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_M) * F.log(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2))


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - F.lit(np.pi / 2))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing on the sphere in [0, 360); within 0.2 degrees of the ellipsoid's."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smaller angle between two directions in [0, 360)."""
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def geodesic_azimuth_np(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Forward azimuth on WGS84 in (-180, 180] (Vincenty's inverse formula, iterated on arrays)."""
    lon1, lat1, lon2, lat2 = (np.asarray(v, dtype=float) for v in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1))), np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2)))
    total = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = total.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(30):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, c1 * c2 * sl / ss)
            ca2 = 1 - sa**2
            c2m = np.where(ca2 == 0, 0, cs - 2 * s1 * s2 / np.where(ca2 == 0, 1, ca2))
            c = WGS84_F / 16 * ca2 * (4 + WGS84_F * (4 - 3 * ca2))
            new = total + (1 - c) * WGS84_F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-13
            lam = new
            if done:
                break
        return np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)))


def geodesic_azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Arrow-batched WGS84 azimuth; null in, null out."""
    def azimuth(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(geodesic_azimuth_np(a, b, c, d)).where(a.notna() & b.notna() & c.notna() & d.notna())

    # made on call: workers import this module without a session
    return F.pandas_udf(azimuth, "double")(lon1, lat1, lon2, lat2)


def crossings(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Edges of the ring (xs, ys) that a ray from (x, y) to the east crosses; odd means inside."""
    n = F.size(xs)

    def count(acc: Column, i: Column) -> Column:
        j = F.when(i == n, 1).otherwise(i + 1)
        ax, ay = F.element_at(xs, i.cast("int")), F.element_at(ys, i.cast("int"))
        bx, by = F.element_at(xs, j.cast("int")), F.element_at(ys, j.cast("int"))
        hit = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return acc + F.coalesce(hit, F.lit(False)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), count)


def in_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    return crossings(x, y, xs, ys) % 2 == 1
