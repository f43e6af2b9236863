"""Line simplification by Visvalingam and Whyatt: points whose triangle is small go first."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.grouped import as_numpy, grouped_blocks, key_change
from wakeline.operators.tracks import DAY

def kept(x: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    """Mask of the points that stay: both ends, and all whose triangle is larger than ``epsilon`` when its turn comes."""
    n = len(x)
    keep = np.ones(n, bool)
    if n < 3:
        return keep
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    area = lambda i: abs((x[i] - x[left[i]]) * (y[right[i]] - y[left[i]]) - (x[right[i]] - x[left[i]]) * (y[i] - y[left[i]])) / 2
    i = np.arange(1, n - 1)
    first = np.abs((x[i] - x[i - 1]) * (y[i + 1] - y[i - 1]) - (x[i + 1] - x[i - 1]) * (y[i] - y[i - 1])) / 2
    version = np.zeros(n, int)
    heap = [(a, int(k), 0) for a, k in zip(first, i)]
    heapq.heapify(heap)
    while heap:
        a, k, v = heapq.heappop(heap)
        if not keep[k] or v != version[k]:
            continue
        if a > epsilon:
            break
        keep[k] = False
        l, r = left[k], right[k]
        right[l], left[r] = r, l
        for m in (l, r):
            if 0 < m < n - 1:
                version[m] += 1
                heapq.heappush(heap, (area(m), int(m), int(version[m])))
    return keep


def simplify(df: DataFrame, epsilon: float = 1e-4, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Rows that stay; all columns are kept.

    Days are simplified first, each by itself, and what is left of a track then as a
    whole: the first step bounds what a task holds of the pings, the second takes out
    the ends of days that are no corners.  No triangle of the result is as small as
    ``epsilon`` or smaller; a track of one day is simplified exactly as in one go.
    """
    keys = [*track, "_day"]
    rows = df.select(*track, "row_id", "time", "lon", "lat").withColumn("_day", F.floor(F.col("time") / DAY).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def thin(key: list[str]):
        def run(table: pa.Table) -> pa.Table:
            x, y = as_numpy(table["lon"]), as_numpy(table["lat"])
            cuts = np.flatnonzero(key_change([as_numpy(table[k]) for k in key]))[1:]
            return table.filter(pa.array(np.concatenate([kept(x[i], y[i], epsilon) for i in np.split(np.arange(len(x)), cuts)])))

        return run

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns)
    days = grouped_blocks(rows, keys, ["time", "row_id"], thin(keys), schema)
    left = grouped_blocks(days, list(track), ["time", "row_id"], thin(list(track)), schema)
    return df.join(left.select("row_id"), "row_id", "left_semi")


def farthest_first(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points that Douglas and Peucker keep: both ends, and whatever lies farther than ``tolerance`` from its chord."""
    n = len(x)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    keep[[0, n - 1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        size = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / size, 0, 1) if size else np.zeros(len(px))
        far = np.hypot(px - t * dx, py - t * dy)
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify_live(df: DataFrame, tolerance: float = 100.0, every: int = 100, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Rows that stay when a live track is simplified after every so many points, in projected metres (Douglas and Peucker); by day."""
    keys = [*track, "_day"]
    rows = df.select(*track, "row_id", "time", "lon", "lat").withColumn("_day", F.floor(F.col("time") / DAY).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        x = geo.MERCATOR_M * np.radians(as_numpy(table["lon"]))
        y = geo.MERCATOR_M * np.log(np.tan(np.pi / 4 + np.radians(as_numpy(table["lat"])) / 2))
        cuts = np.flatnonzero(key_change([as_numpy(table[k]) for k in keys]))[1:]
        out = []
        for group in np.split(np.arange(len(x)), cuts):
            line = np.zeros(0, np.int64)
            for k in range(0, len(group), every):
                line = np.r_[line, group[k : k + every]]
                if len(group) - k >= every:  # a full batch has come: the line so far is simplified again
                    line = line[farthest_first(x[line], y[line], tolerance)]
            out.append(line)
        return table.select(["row_id"]).take(pa.array(np.concatenate(out)))

    return df.join(grouped_blocks(rows, keys, ["time", "row_id"], run, "row_id long"), "row_id", "left_semi")
