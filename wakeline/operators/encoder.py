"""Pathway encoding: which stretches of a vessel's reports belong to one trajectory.

Windows find the breaks and number the segments; only each segment's head and
tail - two points, however long it is - go to the sequential step, which hands
segments in order to the pathway with the highest score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.grouped import as_numpy, grouped_blocks, key_change
from wakeline.operators.tracks import numbered, placed


def score(lon1: Column, lat1: Column, t1: Column, lon2: Column, lat2: Column, t2: Column, speed: float, distance: float) -> Column:
    """Likelihood that a report continues a trajectory: distance bound per second, or -1 beyond the bounds."""
    way = geo.haversine(lon1, lat1, lon2, lat2)
    dm = F.greatest(way, F.lit(1.0))
    dt = F.greatest((t2 - t1).cast("double"), F.lit(10.0))
    pace = dm / dt * geo.SCORE_KNOTS
    return F.when(way.isNull() | t1.isNull() | t2.isNull(), None).when((pace < speed) & (dm < 2 * distance), F.lit(float(distance)) / pace).otherwise(-1.0)


def scores_np(lon1, lat1, t1, lon2, lat2, t2, speed: float, distance: float) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    dm = np.maximum(2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1))), 1)
    pace = dm / np.maximum(t2 - t1, 10) * geo.SCORE_KNOTS
    return np.where((pace < speed) & (dm < 2 * distance), distance / pace, -1.0).astype(np.float32)


def segments(df: DataFrame, distance: float, speed: float) -> DataFrame:
    """``seg``: numbers of the stretches without a leg above the speed or distance bound."""
    def breaks(here, was):
        far = geo.haversine(was("lon"), was("lat"), here("lon"), here("lat"))
        return (geo.knots(far, here("time") - was("time")) > speed) | (far > distance)

    return numbered(placed(df), ("lon", "lat", "time"), breaks, "seg").drop("_day")


def assign(distance: float, speed: float, minscore: float):
    def run(table: pa.Table) -> pa.Table:
        c = {k: as_numpy(table[k]) for k in table.column_names}
        label = np.zeros(table.num_rows, np.int32)
        for a in np.split(np.arange(table.num_rows), np.flatnonzero(key_change([c["mmsi"]]))[1:]):
            lon, lat, t = (np.empty(len(a)) for _ in range(3))
            n = 0
            for i in a:
                k = n
                if n:
                    s = scores_np(lon[:n], lat[:n], t[:n], c["lon1"][i], c["lat1"][i], c["t1"][i], speed, distance)
                    if s.max() >= minscore:
                        k = n - 1 - int(np.argmax(s[::-1]))  # of equal scores the last pathway
                label[i] = k
                lon[k], lat[k], t[k] = c["lon2"][i], c["lat2"][i], c["t2"][i]
                n = max(n, k + 1)
        return pa.table({"mmsi": table["mmsi"], "seg": table["seg"], "label": pa.array(label)})

    return run


def encode(df: DataFrame, distance: float = 200_000, speed: float = 50, minscore: float = 1e-6) -> DataFrame:
    """Rows with ``label``, the number of their pathway, in the order in which pathways opened.

    Rows need mmsi, time, row_id, lon, lat without nulls.  Extra columns stay.
    """
    s = segments(df, distance, speed)
    at = F.struct("time", "row_id")
    ends = s.groupBy("mmsi", "seg").agg(
        F.min_by(F.struct("lon", "lat", "time"), at).alias("h"), F.max_by(F.struct("lon", "lat", "time"), at).alias("t")
    ).select("mmsi", "seg", F.col("h.lon").alias("lon1"), F.col("h.lat").alias("lat1"), F.col("h.time").alias("t1"), F.col("t.lon").alias("lon2"), F.col("t.lat").alias("lat2"), F.col("t.time").alias("t2"))
    labels = grouped_blocks(ends, ["mmsi"], ["seg"], assign(distance, speed, minscore), "mmsi long, seg int, label int")
    return s.join(labels, ["mmsi", "seg"]).drop("seg")
