"""Small tables and brute-force counterparts."""

from __future__ import annotations

import math
from datetime import datetime, timezone

REPORT = "row_id long, mmsi long, time long, longitude double, latitude double, sog double, source string, received timestamp"
T0 = 1_073_088_000


def at(t):
    return datetime.fromtimestamp(t, timezone.utc) if t is not None else None


def reports(spark, rows):
    """rows: (row_id, mmsi, time, lon, lat, sog[, source[, received]])"""
    full = []
    for r in rows:
        r = tuple(r) + (None,) * (8 - len(r))
        rec = r[7] if r[7] is not None else (at(r[2] if r[2] is None or r[2] < 10**11 else r[2] // 1000))
        full.append((*r[:6], r[6] or "feed", rec))
    return spark.createDataFrame(full, REPORT)


def metres(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(min(1, h)))


def leg(mmsi, start, n, lon, lat, knots=12.0, step=120, first_id=1, wobble=0.00002):
    """A vessel that sails east."""
    out = []
    for k in range(n):
        x = lon + knots * 1852 / 3600 * step * k / (111195.08 * math.cos(math.radians(lat)))
        out.append([first_id + k, mmsi, start + step * k, round(x, 6), round(lat + wobble * math.sin(k * 2.4), 6), round(knots + 0.3 * math.sin(k * 1.7), 1)])
    return out


def rest(mmsi, start, n, lon, lat, step=240, first_id=1):
    return [[first_id + k, mmsi, start + step * k, round(lon + 0.0002 * math.sin(k * 1.3), 6), round(lat + 0.0002 * math.cos(k * 2.1), 6), 0.1] for k in range(n)]
