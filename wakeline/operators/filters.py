"""Predicates and row filters; every predicate is a Column, so Catalyst pushes it into the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.scalar import epoch
from wakeline.operators.normalise import MMSI_FROM, MMSI_TO


def _epoch(t: datetime | int) -> int:
    return epoch(t) if isinstance(t, datetime) else int(t)


def _wrap(x: float) -> float:
    if abs(x) == 180:
        return x
    return (x + 180) % 360 - 180 if abs(x) > 180 else x


def in_bbox(xmin: float, xmax: float, ymin: float, ymax: float, lon: str = "longitude", lat: str = "latitude", **_) -> Column:
    """Inclusive box; longitudes out of range are wrapped, and a box over the antimeridian takes both sides."""
    if not (xmin < xmax and ymin < ymax):
        raise ValueError("a box needs xmin < xmax and ymin < ymax")
    a, b = _wrap(float(xmin)), _wrap(float(xmax))
    inside = F.col(lon).between(a, b) if a <= b else (F.col(lon) >= a) | (F.col(lon) <= b)
    return inside & F.col(lat).between(float(ymin), float(ymax))


def in_timerange(start: datetime | int, end: datetime | int, time: str = "time", **_) -> Column:
    """Inclusive at both ends."""
    return F.col(time).between(_epoch(start), _epoch(end))


def has_mmsi(mmsi: int, **_) -> Column:
    return F.col("mmsi") == int(mmsi)


def in_mmsi(mmsis: Sequence[int], **_) -> Column:
    return F.col("mmsi").isin([int(m) for m in mmsis])


def valid_mmsi(**_) -> Column:
    return (F.col("mmsi") >= MMSI_FROM) & (F.col("mmsi") < MMSI_TO)


def all_of(*parts: Callable[..., Column]) -> Callable[..., Column]:
    """Conjunction of predicate builders that share keyword arguments."""
    def build(**kw) -> Column:
        return reduce(and_, [p(**kw) for p in parts])
    return build


in_bbox_time = in_time_bbox = all_of(in_timerange, in_bbox)
in_bbox_time_validmmsi = in_time_bbox_validmmsi = all_of(in_timerange, in_bbox, valid_mmsi)
in_time_bbox_hasmmsi = all_of(in_timerange, in_bbox, has_mmsi)
in_time_bbox_inmmsi = all_of(in_timerange, in_bbox, in_mmsi)
in_time_mmsi = in_timerange_validmmsi = all_of(in_timerange, valid_mmsi)
in_timerange_hasmmsi = all_of(in_timerange, has_mmsi)
in_timerange_inmmsi = all_of(in_timerange, in_mmsi)
in_validmmsi_bbox = all_of(valid_mmsi, in_bbox)


def mask_in_radius(df: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Pings strictly nearer than ``metres``; a degree box goes first so that the scan can prune."""
    dy = metres / geo.EARTH_M * 57.3
    near = F.col("lat").between(lat - dy, lat + dy) & (geo.haversine(F.col("lon"), F.col("lat"), F.lit(float(lon)), F.lit(float(lat))) < metres)
    return df.where(near)


def min_speed_filter(df: DataFrame, min_knots: float, track: Sequence[str] = ("mmsi",), order: Sequence[str] = ("time", "row_id")) -> DataFrame:
    """Pings from which the vessel goes on at ``min_knots`` or more; the last ping has the speed of the leg before it, a lone ping passes."""
    from wakeline.operators.tracks import neighbours, placed

    x = neighbours(placed(df, track), ("lon", "lat", "time"), track, before="_was", after="_then", order=order)
    leg = lambda a, b: geo.knots(geo.haversine(F.col(f"{a}lon"), F.col(f"{a}lat"), F.col(f"{b}lon"), F.col(f"{b}lat")), F.col(f"{b}time") - F.col(f"{a}time"))
    x = x.withColumn("_speed", F.coalesce(leg("", "_then."), leg("_was.", "")))
    return x.where(F.col("_speed").isNull() | (F.col("_speed") >= min_knots)).drop("_was", "_then", "_speed", "_day")


def drop_slow(df: DataFrame, threshold: float, sog: str = "sog") -> DataFrame:
    """Pings whose own speed is above the threshold."""
    return df.where(F.col(sog) > threshold)


def drop_where_any(df: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """Rows for which none of the predicates holds; an unknown predicate does not hold."""
    return df.where(~reduce(or_, [F.coalesce(f, F.lit(False)) for f in filters])) if filters else df


def live_positions(df: DataFrame) -> DataFrame:
    """Live reports with a position: coordinates null or exactly zero are dropped."""
    return df.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & (F.col("longitude") != 0) & (F.col("latitude") != 0))


def cargo_depth_in(df: DataFrame, depths: Sequence[str] = ("A", "B", "C", "D", "E", "F")) -> DataFrame:
    return df.where(F.col("cargo_depth").isin(list(depths)))
