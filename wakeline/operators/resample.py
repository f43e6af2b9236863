"""Resampling of tracks along time or way.

Every ping is paired with the next by ``lead``; the samples that fall between the
two are exploded from the pair and interpolated in place, so there is no range
join and one exchange serves all.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.scalar import seconds_of
from wakeline.operators.grouped import as_numpy, grouped_blocks, key_change
from wakeline.operators.tracks import cumulated, placed


def one_per_time(df: DataFrame, track: Sequence[str], values: Sequence[str], day: Sequence[str] = ()) -> DataFrame:
    """Of pings of one time the first; the axis of an interpolation must rise."""
    return df.groupBy(*track, *day, "time").agg(F.min_by(F.struct("lon", "lat", *values), F.col("row_id")).alias("_v")).select(*track, *day, "time", "_v.*")


def _between(a: Column, b: Column, share: Column) -> Column:
    return F.when(share.isNull(), a).otherwise(a + (b - a) * share)


def _paired(df: DataFrame, track: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Placed pings, one a time, in Mercator metres (_x, _y), with the next one (_then) and the track's first and last time (_t0, _tn)."""
    x = one_per_time(placed(df, track, whole=True), track, values, ("_day",))
    x = x.withColumn("_x", geo.mercator_x(F.col("lon"))).withColumn("_y", geo.mercator_y(F.col("lat")))
    keys, line, whole = [*track, "_day"], Window.partitionBy(*track).orderBy("_day"), Window.partitionBy(*track)
    me = F.struct("time", "_x", "_y", *values)
    days = x.groupBy(*keys).agg(F.min_by(me, "time").alias("_head"), F.max("time").alias("_b"))
    days = days.select(*keys, F.lead("_head").over(line).alias("_carry"), F.min("_head.time").over(whole).alias("_t0"), F.max("_b").over(whole).alias("_tn"))
    x = x.withColumn("_then", F.lead(me).over(Window.partitionBy(*keys).orderBy("time"))).join(days, keys, "left")
    return x.withColumn("_then", F.coalesce("_then", "_carry")).drop("_carry")


def interp_time(df: DataFrame, step: timedelta | int = timedelta(minutes=10), values: Sequence[str] = ("sog",), track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Samples every ``step`` from each track's first ping on; positions linear in Mercator, values linear in time.

    The last sample may lie after the last ping and then has its values.  Tracks of
    one ping are left out.  Out: track columns, time, lon, lat, values.
    """
    s = seconds_of(step)
    x = _paired(df, track, values).where(F.col("_t0") < F.col("_tn"))
    k0 = F.ceil((F.col("time") - F.col("_t0")) / s)
    k1 = F.when(F.col("_then").isNotNull(), F.ceil((F.col("_then.time") - F.col("_t0")) / s) - 1).otherwise(F.ceil((F.col("_tn") - F.col("_t0")) / s))
    x = x.withColumn("_k0", k0).withColumn("_k1", k1).where("_k0 <= _k1").withColumn("_k", F.explode(F.sequence("_k0", "_k1")))
    at = F.col("_t0") + F.col("_k") * s
    share = (at - F.col("time")) / (F.col("_then.time") - F.col("time"))
    return x.select(
        *track, at.cast("long").alias("time"),
        geo.mercator_lon(_between(F.col("_x"), F.col("_then._x"), share)).alias("lon"), geo.mercator_lat(_between(F.col("_y"), F.col("_then._y"), share)).alias("lat"),
        *[_between(F.col(v).cast("double"), F.col(f"_then.{v}").cast("double"), share).alias(v) for v in values],
    )


def with_azimuth(samples: DataFrame, pings: DataFrame, track: Sequence[str], order: str) -> DataFrame:
    """cog from sample to sample on the ellipsoid; the last sample keeps the track's last reported course."""
    w = Window.partitionBy(*track).orderBy(order)
    az = geo.geodesic_azimuth(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    last = pings.groupBy(*track).agg(F.max_by("cog", F.struct("time", "row_id")).alias("_last"))
    x = samples.withColumn("_lon", F.lead("lon").over(w)).withColumn("_lat", F.lead("lat").over(w)).withColumn("_az", az)
    return x.join(last, list(track)).withColumn("cog", F.coalesce("_az", F.col("_last").cast("double"))).drop("_lon", "_lat", "_az", "_last")


def geo_interp_time(df: DataFrame, step: timedelta | int = timedelta(minutes=10), values: Sequence[str] = ("sog",), track: Sequence[str] = ("mmsi",)) -> DataFrame:
    return with_azimuth(interp_time(df, step, values, track), df, track, "time")


def interp_spacing(df: DataFrame, spacing: float, values: Sequence[str] = ("sog",), track: Sequence[str] = ("mmsi",), azimuth: bool = False) -> DataFrame:
    """Samples every ``spacing`` metres of projected way, and one at the end; tracks no longer than that are left out.

    Out: track columns, way (metres from the start), time, lon, lat, values (all linear in the way).
    """
    x = _paired(df, track, values)
    leg = F.sqrt(F.pow(F.col("_then._x") - F.col("_x"), F.lit(2.0)) + F.pow(F.col("_then._y") - F.col("_y"), F.lit(2.0)))
    x = cumulated(x.withColumn("_leg", F.coalesce(leg, F.lit(0.0))), "_leg", "_to", track, "_total", order=("time",))
    # to the micrometre, so that a leg begins exactly where the one before it ends
    x = x.withColumn("_from", F.round(F.col("_to") - F.col("_leg"), 6)).withColumn("_to", F.round("_to", 6)).where(F.col("_total") > spacing)
    last = F.col("_then").isNull()
    k0, k1 = F.ceil(F.col("_from") / spacing), F.ceil(F.col("_to") / spacing) - 1
    inner = F.when(~last & (k0 <= k1), F.transform(F.sequence(k0, k1), lambda k: k * F.lit(float(spacing))))
    x = x.withColumn("way", F.explode(F.when(last, F.array("_total")).otherwise(F.coalesce(inner, F.array().cast("array<double>")))))
    share = F.when(~last, (F.col("way") - F.col("_from")) / F.col("_leg"))
    out = x.select(
        *track, "way", _between(F.col("time").cast("double"), F.col("_then.time").cast("double"), share).alias("time"),
        geo.mercator_lon(_between(F.col("_x"), F.col("_then._x"), share)).alias("lon"), geo.mercator_lat(_between(F.col("_y"), F.col("_then._y"), share)).alias("lat"),
        *[_between(F.col(v).cast("double"), F.col(f"_then.{v}").cast("double"), share).alias(v) for v in values],
    )
    return with_azimuth(out, df, track, "way") if azimuth else out


def spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (t, y), evaluated (and extrapolated) at ``at``; y may have several columns.

    The unknowns are the bends (second derivatives) at the inner knots: the slope must
    not jump there.  The first two pieces are one cubic, and so are the last two, which
    makes the outer bends straight continuations of the two beside them.
    """
    n = len(t)
    h = np.diff(t).astype(float)
    rise = np.diff(y, axis=0) / h[:, None]
    bend = np.zeros((n, y.shape[1]))
    if n == 3:
        bend[:] = 2 * (rise[1] - rise[0]) / (t[2] - t[0])  # one parabola
    elif n > 3:
        m = n - 2
        below, on, above = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
        jump = 6 * np.diff(rise, axis=0)
        p, q = h[0] / h[1], h[-1] / h[-2]
        on[0] += h[0] * (1 + p)
        above[0] -= h[0] * p
        on[-1] += h[-1] * (1 + q)
        below[-1] -= h[-1] * q
        for i in range(1, m):
            w = below[i] / on[i - 1]
            on[i] -= w * above[i - 1]
            jump[i] -= w * jump[i - 1]
        inner = np.zeros_like(jump)
        inner[-1] = jump[-1] / on[-1]
        for i in range(m - 2, -1, -1):
            inner[i] = (jump[i] - above[i] * inner[i + 1]) / on[i]
        bend[1:-1] = inner
        bend[0] = inner[0] + p * (inner[0] - inner[1])
        bend[-1] = inner[-1] + q * (inner[-1] - inner[-2])
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    hk, left, right = h[k][:, None], (t[k + 1] - at)[:, None], (at - t[k])[:, None]
    curve = bend[k] * left**3 / (6 * hk) + bend[k + 1] * right**3 / (6 * hk)
    return curve + (y[k] / hk - bend[k] * hk / 6) * left + (y[k + 1] / hk - bend[k + 1] * hk / 6) * right


def interp_cubic_spline(df: DataFrame, step: timedelta | int = timedelta(minutes=10), values: Sequence[str] = ("sog",), track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Samples every ``step`` on a cubic spline in Mercator; goes on beyond the last ping if the last sample does.

    A spline hangs together over its whole track: cut long tracks first
    (``split_timedelta``).  Tracks with fewer than two times are left out; null
    values count as zero.
    """
    s = seconds_of(step)
    names = [*track, "time", "lon", "lat", *values]
    src = one_per_time(df, track, values).select(*track, "time", "lon", "lat", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        cols = {k: as_numpy(table[k]) for k in names}
        heads = np.flatnonzero(key_change([cols[k] for k in track]))
        out: dict[str, list] = {k: [] for k in names}
        for a, b in zip(heads, np.r_[heads[1:], table.num_rows]):
            t = cols["time"][a:b]
            if len(t) < 2:
                continue
            x = geo.MERCATOR_M * np.radians(cols["lon"][a:b])
            y = geo.MERCATOR_M * np.log(np.tan(np.pi / 4 + np.radians(cols["lat"][a:b]) / 2))
            at = np.arange(t[0], t[-1] + s, s)
            z = spline(t, np.stack([x, y, *[cols[v][a:b] for v in values]], 1), at)
            for k in track:
                out[k].append(np.full(len(at), cols[k][a]))
            out["time"].append(at)
            out["lon"].append(np.degrees(z[:, 0] / geo.MERCATOR_M))
            out["lat"].append(np.degrees(2 * np.arctan(np.exp(z[:, 1] / geo.MERCATOR_M)) - np.pi / 2))
            for i, v in enumerate(values):
                out[v].append(z[:, 2 + i])
        return pa.table({k: np.concatenate(v) for k, v in out.items()}) if out["time"] else None

    return grouped_blocks(src, list(track), ["time"], run, ", ".join(f"{k} {kinds[k]}" for k in names))
