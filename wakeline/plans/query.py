"""Queries over the store: predicates in, ordered tracks out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.scalar import epoch, months_between
from wakeline.operators import filters, joins, tracks
from wakeline.operators.simplify import simplify
from wakeline.plans.store import Store


def crawl_dynamic(store: Store, where: Column, months: Sequence[str]) -> DataFrame:
    """Positions of the months that match; months prune partitions, the rest is pushed into the scan."""
    return store.dynamic().where(F.col("month").isin(list(months)) & where)


def crawl_dynamic_static(store: Store, where: Column, months: Sequence[str]) -> DataFrame:
    """The same with the vessels' static aggregate and class of ship."""
    d = crawl_dynamic(store, where, months)
    a = store.static_aggregate().where(F.col("month").isin(list(months)))
    return joins.with_coarse_type(joins.with_static(d, a), store.coarse_types())


class Query:
    """A query over [start, end]; ``callback`` builds the predicate from the keyword arguments.

    >>> Query(store, start=..., end=..., callback=filters.in_time_bbox_validmmsi, xmin=..., ...).tracks()
    """

    def __init__(self, store: Store, start: datetime, end: datetime, callback: Callable[..., Column] = filters.in_timerange, **kw):
        if start >= end:
            raise ValueError("start must be before end")
        self.store, self.start, self.end, self.callback, self.kw = store, start, end, callback, kw

    @property
    def months(self) -> list[str]:
        return months_between(self.start, self.end)

    def dataframe(self, fcn: Callable = crawl_dynamic, limit: int | None = None, distinct: bool = True, ordered: bool = True) -> DataFrame:
        """Rows of the query; repeated ones once, in order of mmsi and time; ``limit`` cuts after ordering."""
        d = fcn(self.store, self.callback(start=self.start, end=self.end, **self.kw), self.months)
        d = d.distinct() if distinct else d
        d = d.orderBy("mmsi", "time") if ordered or limit else d
        return d.limit(int(limit)) if limit else d

    def tracks(self, fcn: Callable = crawl_dynamic, decimate: float | bool = False) -> DataFrame:
        """Long-form tracks: lon, lat, whole-degree cog, row_id, cut at the antimeridian; simplified if asked."""
        return track_rows(self.dataframe(fcn, ordered=False), decimate)


def track_rows(rows: DataFrame, decimate: float | bool = False) -> DataFrame:
    """Stored rows as track rows; row_id is stable for equal rows."""
    x = rows.withColumnsRenamed({"longitude": "lon", "latitude": "lat"}).withColumn("cog", F.col("cog").cast("int"))
    if "row_id" not in x.columns:
        x = x.withColumn("row_id", F.xxhash64("mmsi", "time", "lon", "lat", "sog", "cog", "source"))
    if decimate:
        x = simplify(x, 1e-4 if decimate is True else float(decimate))
    return tracks.split_longitude(x)


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any DataFrame to DataFrame function is an operator."""
    for s in steps:
        df = df.transform(s)
    return df


def next_month(d: datetime) -> datetime:
    return (d.replace(day=1) + timedelta(days=32)).replace(day=1)


def as_epoch(d: datetime | int) -> int:
    return epoch(d) if isinstance(d, datetime) else int(d)
