"""Stops and trips from position reports.

Per vessel and day, stationary fragments (runs within ``RADIUS_M`` of their own
median) are found on the track that is left after implausible positions are
taken out; only fragments long enough, or touching the edge of the day, go on.
Per vessel their medians form a proximity graph whose communities are the
recurring places; contiguous fragments of one place are joined into visits, and
the time between two visits is a trip.  The second step sees at most some fifty
rows per vessel-day (stays of half an hour and the ends of the day), however many
reports a vessel sends, and is linear in them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wakeline.operators.grouped import as_numpy, grouped_blocks, key_change
from wakeline.operators.plausibility import clean_track, day_chunks, distance

RADIUS_M = 200.0
MIN_STAY_S = 1800
SILENCE_S = 86_400

FRAGMENT = "mmsi long, bucket long, start_time long, end_time long, lon double, lat double, n long, way_m double, first boolean, last boolean"
VISIT = "kind string, mmsi long, place long, start_time long, end_time long, duration_s long, distance_m double, lon double, lat double"


def middle(lon: np.ndarray, lat: np.ndarray) -> tuple[float, float]:
    ref = lon[0]
    return float((np.median((lon - ref + 180) % 360 - 180) + ref + 180) % 360 - 180), float(np.median(lat))


def stationary_runs(lon: np.ndarray, lat: np.ndarray, t: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of consecutive runs that keep within RADIUS_M of their median; they tile the input."""
    n = len(lon)
    if n == 1:
        return [(0, 1)]
    clon, clat = middle(lon, lat)
    if distance(lon, lat, clon, clat).max() <= RADIUS_M:
        return [(0, n)]
    k = np.cos(np.radians(lat.mean())) * 111195.08
    x = ((lon - lon[0] + 180) % 360 - 180) * k
    y = (lat - lat[0]) * 111195.08
    xs, ys = x.tolist(), y.tolist()
    r2 = RADIUS_M**2
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        sx, sy, j = xs[i], ys[i], i + 1
        while j < n:
            c = j - i
            dx, dy = xs[j] - sx / c, ys[j] - sy / c
            if dx * dx + dy * dy > r2:
                break
            sx += xs[j]
            sy += ys[j]
            j += 1
        if j - i > 2 and t[j - 1] - t[i] >= 600:
            # settle on the median and let the run reach out on both sides
            for _ in range(3):
                mx, my = np.median(x[i:j]), np.median(y[i:j])
                inside = (x[i:] - mx) ** 2 + (y[i:] - my) ** 2 <= r2
                a = i
                while a < j and not inside[a - i]:
                    a += 1
                if a == j:
                    break
                stop = np.flatnonzero(~inside[a - i :])
                b = a + (int(stop[0]) if len(stop) else len(inside) - (a - i))
                while a > 0 and (xs[a - 1] - mx) ** 2 + (ys[a - 1] - my) ** 2 <= r2 and (not out or a - 1 >= out[-1][0] + 0 and not long_run(out, a - 1, t)):
                    a -= 1
                if (a, b) == (i, j):
                    break
                # runs before give up what this one takes
                while out and out[-1][0] >= a:
                    out.pop()
                if out and out[-1][1] > a:
                    out[-1] = (out[-1][0], a)
                if a > i:
                    out.append((i, a))
                i, j = a, max(b, a + 1)
        out.append((i, j))
        i = j
    return out


def long_run(out: list[tuple[int, int]], at: int, t: np.ndarray) -> bool:
    """Whether a position belongs to a run that is already a stay of its own."""
    for a, b in reversed(out):
        if a <= at < b:
            return t[b - 1] - t[a] >= MIN_STAY_S
        if b <= at:
            return False
    return False


def fragments(table: pa.Table) -> pa.Table:
    c = clean_track(table)
    own = as_numpy(table["own"])
    r = c["r"][~c["stuck"] & ~c["spike"]]
    r = r[own[r]]
    if not len(r):
        return None
    mmsi, bucket, t, lon, lat = (c[x][r] for x in ("mmsi", "bucket", "t", "lon", "lat"))
    head = key_change([mmsi, bucket])
    step = np.zeros(len(r))
    step[1:] = distance(lon[:-1], lat[:-1], lon[1:], lat[1:])
    step[head] = 0
    way = np.cumsum(step)
    # two reports of one stay are at most twice the radius apart
    piece = np.flatnonzero(head | (step > 2 * RADIUS_M))
    bounds = np.r_[piece, len(r)]
    chunk_start = np.flatnonzero(head)
    chunk_end = np.r_[chunk_start[1:], len(r)]
    is_first = np.zeros(len(r) + 1, dtype=bool)
    is_first[chunk_start] = True
    is_last = np.zeros(len(r) + 1, dtype=bool)
    is_last[chunk_end] = True
    rows = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if t[b - 1] - t[a] < MIN_STAY_S and not is_first[a] and not is_last[b]:
            continue
        for i, j in stationary_runs(lon[a:b], lat[a:b], t[a:b]):
            i, j = a + i, a + j
            first, last = bool(is_first[i]), bool(is_last[j])
            if first or last or t[j - 1] - t[i] >= MIN_STAY_S:
                mlon, mlat = middle(lon[i:j], lat[i:j])
                rows.append((int(mmsi[i]), int(bucket[i]), int(t[i]), int(t[j - 1]), mlon, mlat, j - i, float(way[j - 1] - way[i]), first, last))
    cols = list(zip(*rows)) if rows else [[]] * 10
    kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.int64(), pa.float64(), pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in FRAGMENT.split(", ")]
    return pa.table({n: pa.array(list(v), k) for n, v, k in zip(names, cols, kinds)})


def near_nodes(xyz: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(starts, neighbours): of each point on the sphere the points within ``reach`` metres (itself too), by cubes of that size."""
    n = len(xyz)
    cube = np.floor(xyz / reach).astype(np.int64) + (1 << 20)
    code = (cube[:, 0] << 42) | (cube[:, 1] << 21) | cube[:, 2]
    order = np.argsort(code, kind="stable")
    line = code[order]
    left, right = [], []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dz in (-1, 0, 1):
                want = code + (dx << 42) + (dy << 21) + dz
                lo, hi = np.searchsorted(line, want, "left"), np.searchsorted(line, want, "right")
                size = hi - lo
                i = np.repeat(np.arange(n), size)
                j = order[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
                ok = ((xyz[i] - xyz[j]) ** 2).sum(1) <= reach * reach
                left.append(i[ok])
                right.append(j[ok])
    i, j = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((j, i))
    return np.searchsorted(i[order], np.arange(n + 1)), j[order]


def communities(lon: np.ndarray, lat: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Labels by weighted label propagation on the graph of medians within RADIUS_M.

    Medians of one fine cell are one node with the sum of their weights, so that any
    number of visits to a berth is a handful of nodes.  Every change of a label
    raises the weight of the edges whose ends agree (a node's own vote counts), so
    the propagation ends by itself.
    """
    la, lo = np.radians(lat), np.radians(lon)
    xyz = 6371008.8 * np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)
    cell, node = np.unique(np.floor(xyz / (RADIUS_M / 4)).astype(np.int64), axis=0, return_inverse=True)
    node = node.ravel()
    heavy = np.bincount(node, weights=weight, minlength=len(cell))
    middle_of = np.stack([np.bincount(node, weights=weight * xyz[:, k], minlength=len(cell)) for k in range(3)], 1) / heavy[:, None]
    start, other = near_nodes(middle_of, RADIUS_M)
    near = [other[a:b].tolist() for a, b in zip(start[:-1], start[1:])]
    label, mass = list(range(len(cell))), heavy.tolist()
    todo = np.argsort(-heavy, kind="stable").tolist()
    rank = {k: r for r, k in enumerate(todo)}
    while todo:
        stirred: set[int] = set()
        for i in todo:
            votes: dict[int, float] = defaultdict(float)
            for j in near[i]:
                votes[label[j]] += mass[j]
            best = min(votes, key=lambda k: (-votes[k], k))
            if best != label[i] and votes[best] >= votes[label[i]]:
                label[i] = best
                stirred.update(near[i])
        todo = sorted(stirred, key=rank.__getitem__)
    return np.unique(label, return_inverse=True)[1].ravel()[node]


def visits(table: pa.Table) -> pa.Table:
    """Stops and trips of whole vessels from their fragments in order of time."""
    cols = {c: as_numpy(table[c]) for c in table.column_names}
    edge = np.r_[np.flatnonzero(key_change([cols["mmsi"]])), table.num_rows]
    rows = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        f = {k: v[a:b] for k, v in cols.items()}
        label = communities(f["lon"], f["lat"], (f["end_time"] - f["start_time"] + 1).astype(float))
        runs: list[list[int]] = [[0]]
        silent = [False]  # whether a silence lies between a run and the one before
        for i in range(1, b - a):
            gap = f["start_time"][i] - f["end_time"][i - 1]
            joined = (
                f["last"][i - 1] and f["first"][i] and f["bucket"][i] != f["bucket"][i - 1] and gap < SILENCE_S
                and (label[i] == label[i - 1] or min(f["n"][i], f["n"][i - 1]) <= 3)
                and distance(f["lon"][i - 1], f["lat"][i - 1], f["lon"][i], f["lat"][i]) <= RADIUS_M
            )
            if joined:
                runs[-1].append(i)
            else:
                runs.append([i])
                silent.append(bool(gap >= SILENCE_S))
        stop = None
        quiet = False
        for run, s in zip(runs, silent):
            quiet |= s
            start, end = int(f["start_time"][run[0]]), int(f["end_time"][run[-1]])
            if end - start < MIN_STAY_S:
                continue
            main = run[int(np.argmax(f["n"][run]))]
            place = int(label[main])
            m = int(f["mmsi"][0])
            lon, lat = float(f["lon"][main]), float(f["lat"][main])
            if stop is not None and not quiet:
                rows.append(("trip", m, place, stop[1], start, start - stop[1], float(distance(stop[2], stop[3], lon, lat)), lon, lat))
            rows.append(("stop", m, place, start, end, end - start, float(f["way_m"][run].sum()), lon, lat))
            stop, quiet = (start, end, lon, lat), False
    names = [x.split()[0] for x in VISIT.split(", ")]
    kinds = [pa.string()] + [pa.int64()] * 5 + [pa.float64()] * 3
    cols = list(zip(*rows)) if rows else [[]] * 9
    return pa.table({n: pa.array(list(v), k) for n, v, k in zip(names, cols, kinds)})


def stops_and_trips(df: DataFrame) -> DataFrame:
    """Stops and trips of every vessel with a valid mmsi.

    ``df`` needs row_id, mmsi, time, longitude, latitude, sog, received.  Columns
    out: kind (stop | trip), mmsi, place (recurring place of the stop, or where
    the trip ends, numbered per vessel), start_time, end_time, duration_s,
    distance_m (way within a stop, straight line of a trip), lon, lat.  Reports
    without a usable position, repeated instants and implausible positions do not
    count; a silence of a day ends a stop and voids a trip.  Empty in, empty out.
    """
    frag = grouped_blocks(day_chunks(df), ["mmsi", "bucket"], ["t", "rank", "row_id"], fragments, FRAGMENT)
    return grouped_blocks(frag, ["mmsi"], ["start_time"], visits, VISIT)


def p4_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/ais_dynamic.parquet")
    return stops_and_trips(d).select("kind", "mmsi", "start_time", "end_time").distinct()
