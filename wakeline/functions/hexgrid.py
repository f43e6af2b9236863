"""Hexagonal cells in Mercator space.

The public H3 index is used where its library is installed (``h3_index``); these
cells need no library and are named apart: ``hex_cell`` gives "r:q:r" of the
pointy-top hexagon with the given edge length in projected metres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.geo import mercator_x, mercator_y


def hex_axial(lon: Column, lat: Column, edge_m: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the hexagon that holds the point, by cube rounding."""
    x, y = mercator_x(lon), mercator_y(lat)
    q = (x * (math.sqrt(3) / 3) - y / 3) / edge_m
    r = y * (2 / 3) / edge_m
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq), F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)


def hex_cell(lon: Column, lat: Column, edge_m: float) -> Column:
    q, r = hex_axial(lon, lat, edge_m)
    return F.concat_ws(":", F.lit(str(int(edge_m))), q.cast("string"), r.cast("string"))


def hex_area_km2(lat_deg: float, edge_m: float) -> float:
    """True area of a cell at a latitude: Mercator stretches both ways by 1 / cos(latitude)."""
    return 3 * math.sqrt(3) / 2 * (edge_m * math.cos(math.radians(lat_deg))) ** 2 / 1e6


def area_table(spark: SparkSession, latitudes: list[float], edges_m: list[float]) -> DataFrame:
    """(latitude, edge_m, km2) of cells by latitude and size."""
    return spark.createDataFrame([(float(a), float(e), hex_area_km2(a, e)) for a in latitudes for e in edges_m], "latitude double, edge_m double, km2 double")


def hex_polygon(q: int, r: int, edge_m: float) -> list[tuple[float, float]]:
    """Corners (lon, lat) of a cell."""
    cx, cy = edge_m * math.sqrt(3) * (q + r / 2), edge_m * 1.5 * r
    out = []
    for k in range(6):
        a = math.radians(60 * k + 30)
        x, y = cx + edge_m * math.cos(a), cy + edge_m * math.sin(a)
        out.append((math.degrees(x / 6378137.0), math.degrees(2 * math.atan(math.exp(y / 6378137.0)) - math.pi / 2)))
    return out


def h3_index(resolution: int):
    """Arrow UDF (lat, lon) -> H3 cell; needs the h3 library."""
    try:
        import h3
    except ImportError as e:
        raise ImportError("h3 is not installed; hex_cell needs no library") from e
    to_cell = getattr(h3, "latlng_to_cell", None) or h3.geo_to_h3

    @F.pandas_udf("string")
    def cell(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lat, lon in batches:
            yield pd.Series([None if pd.isna(a) or pd.isna(b) else to_cell(a, b, resolution) for a, b in zip(lat, lon)])

    return cell
