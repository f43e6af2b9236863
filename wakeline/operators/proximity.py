"""Points near other points and inside regions: a distributed dual-tree join.

Space and time are cut into coarse cells; every point goes to its own cell and
to those whose border it can reach.  A cell that holds very many points is cut
into fine cells of space and time, again with copies at the borders only.  What
is still crowded then lies so close together that the pairs asked for are a fixed
share of all pairs: such a fine cell is cut into blocks, and every pair of blocks
is a task of its own.  In a task the
points (tracks along a space-filling curve, each in order of time) form a balanced tree of
bounding boxes, and two trees are walked together level by level: pairs of nodes
that cannot meet are thrown away, pairs that lie near each other as a whole are
accepted wholesale, and only uncertain leaves are refined point by point.
Regions are nodes too: a box outside a region is discarded, a box inside it
accepted, and only boxes crossed by its outline are tested.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.grouped import as_numpy, grouped_blocks
from wakeline.operators.normalise import seconds, usable_position

EARTH_M = 6371008.8
LEAF = 8
CELL_DEG = 1.0  # height of a cell; its width covers at least as many metres
SLOT_S = 6 * 3600
FINE_CELLS, FINE_SLOTS = 6, 5  # a fine cell is at least so many reaches high and wide, a fine slot so many long
HOT_ROWS = 200_000  # a cell with more rows is cut into fine cells, a fine cell into blocks of about this size
MOST_ZONES = 100_000  # regions held by every task
M_PER_DEG = EARTH_M * np.pi / 180
MOST_HOT = 20_000  # hot cells looked up by broadcast; beyond that by a join
PAIR_STEP = 2_000_000  # node or point pairs handled at once

OUT = "kind string, left_id long, right_id long"


class Boxes:
    """Levels of bounding boxes over sorted points; level 0 holds leaves of LEAF points, every level halves."""

    def __init__(self, cols: np.ndarray):
        n = cols.shape[1]
        starts = np.arange(0, n, LEAF)
        self.n = n
        self.low = [np.minimum.reduceat(cols, starts, axis=1)]
        self.high = [np.maximum.reduceat(cols, starts, axis=1)]
        while self.low[-1].shape[1] > 1:
            pairs = np.arange(0, self.low[-1].shape[1], 2)
            self.low.append(np.minimum.reduceat(self.low[-1], pairs, axis=1))
            self.high.append(np.maximum.reduceat(self.high[-1], pairs, axis=1))

    def span(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one point below each node."""
        width = LEAF << level
        return node * width, np.minimum((node + 1) * width, self.n)


def expand(a0, a1, b0, b1):
    """All (i, j) of the rectangles [a0, a1) x [b0, b1), flattened; yields bounded pieces."""
    na, nb = a1 - a0, b1 - b0
    size = na * nb
    at = 0
    total = np.cumsum(size)
    while at < len(size):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + PAIR_STEP, side="right")))
        s = size[at:end]
        rep = np.repeat(np.arange(at, end), s)
        k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        yield a0[rep] + k // nb[rep], b0[rep] + k % nb[rep]
        at = end


def near_pairs(xyz: np.ndarray, t: np.ndarray, key: np.ndarray, owner: np.ndarray, chord: float, within_s: int):
    """Yields (i, j), i < j, of points of one key and two owners within reach; ``certain`` pairs skip the distance test."""
    cols = np.vstack([xyz, t.astype(float), key.astype(float), owner.astype(float)])
    tree = Boxes(cols)
    level = len(tree.low) - 1
    a = b = np.zeros(1, dtype=np.int64)
    c2 = chord * chord
    while len(a):
        keep_a, keep_b, sure_a, sure_b = [], [], [], []
        for s in range(0, len(a), PAIR_STEP):
            i, j = a[s : s + PAIR_STEP], b[s : s + PAIR_STEP]
            lo_i, hi_i, lo_j, hi_j = tree.low[level][:, i], tree.high[level][:, i], tree.low[level][:, j], tree.high[level][:, j]
            gap = np.maximum(np.maximum(lo_i - hi_j, lo_j - hi_i), 0)
            can = (gap[4] == 0) & (gap[3] <= within_s) & ((gap[:3] ** 2).sum(0) <= c2)
            can &= ~((lo_i[5] == hi_j[5]) & (hi_i[5] == lo_j[5]))  # both nodes are one owner's
            wide = np.maximum(hi_i - lo_j, hi_j - lo_i)
            sure = can & ((wide[:3] ** 2).sum(0) <= c2) & (wide[3] <= within_s) & (wide[4] == 0)
            sure_a.append(i[sure])
            sure_b.append(j[sure])
            maybe = can & ~sure
            keep_a.append(i[maybe])
            keep_b.append(j[maybe])
        i, j = np.concatenate(sure_a), np.concatenate(sure_b)
        if len(i):
            (a0, a1), (b0, b1) = tree.span(level, i), tree.span(level, j)
            for p, q in expand(a0, a1, b0, b1):
                up = p < q
                yield p[up], q[up], True
        a, b = np.concatenate(keep_a), np.concatenate(keep_b)
        if not len(a):
            break
        if level == 0:
            (a0, a1), (b0, b1) = tree.span(0, a), tree.span(0, b)
            for p, q in expand(a0, a1, b0, b1):
                up = (p < q) & (owner[p] != owner[q]) & (np.abs(t[p] - t[q]) <= within_s)
                p, q = p[up], q[up]
                up = (key[p] == key[q]) & (((xyz[:, p] - xyz[:, q]) ** 2).sum(0) <= c2)
                yield p[up], q[up], False
            break
        level -= 1
        size = tree.low[level].shape[1]
        # children of both nodes; of a node with itself only the upper half
        na, nb = [], []
        for da in (0, 1):
            for db in (0, 1):
                x, y = 2 * a + da, 2 * b + db
                ok = (x < size) & (y < size) & (x <= y)
                na.append(x[ok])
                nb.append(y[ok])
        a, b = np.concatenate(na), np.concatenate(nb)


def great_circle(lon1, lat1, lon2, lat2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def in_ring(px, py, xs, ys) -> np.ndarray:
    """Even-odd test of points against one ring, run either way, closed or not."""
    ax, ay, bx, by = xs, ys, np.roll(xs, -1), np.roll(ys, -1)
    inside = np.zeros(len(px), dtype=bool)
    for x1, y1, x2, y2 in zip(ax, ay, bx, by):
        if y1 == y2:
            continue
        hit = (y1 > py) != (y2 > py)
        inside ^= hit & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return inside


def crosses(lo, hi, xs, ys) -> np.ndarray:
    """Whether any edge of a ring may touch the boxes (2, n) lo..hi (clipped exactly, one edge at a time)."""
    out = np.zeros(lo.shape[1], dtype=bool)
    for x1, y1, x2, y2 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1)):
        t0, t1 = np.zeros(lo.shape[1]), np.ones(lo.shape[1])
        ok = np.ones(lo.shape[1], dtype=bool)
        for p, d, a, b in ((x1, x2 - x1, lo[0], hi[0]), (y1, y2 - y1, lo[1], hi[1])):
            if d == 0:
                ok &= (a <= p) & (p <= b)
            else:
                u, v = (a - p) / d, (b - p) / d
                t0, t1 = np.maximum(t0, np.minimum(u, v)), np.minimum(t1, np.maximum(u, v))
        out |= ok & (t0 <= t1 + 1e-12)
    return out


def contained(lon: np.ndarray, lat: np.ndarray, zones: Sequence[tuple[int, np.ndarray, np.ndarray]]):
    """Yields (indexes of points, zone id) by walking the boxes of the points against each region."""
    if not len(lon):
        return
    tree = Boxes(np.vstack([lon, lat]))
    for zone, xs, ys in zones:
        box_lo, box_hi = np.array([xs.min(), ys.min()])[:, None], np.array([xs.max(), ys.max()])[:, None]
        level, node = len(tree.low) - 1, np.zeros(1, dtype=np.int64)
        while len(node):
            lo, hi = tree.low[level][:, node], tree.high[level][:, node]
            node = node[((lo <= box_hi) & (hi >= box_lo)).all(0)]
            if not len(node):
                break
            lo, hi = tree.low[level][:, node], tree.high[level][:, node]
            mixed = crosses(lo, hi, xs, ys)
            whole = ~mixed & in_ring((lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2, xs, ys)
            if whole.any():
                a, b = tree.span(level, node[whole])
                yield np.concatenate([np.arange(i, j) for i, j in zip(a, b)]), zone
            node = node[mixed]
            if level == 0:
                a, b = tree.span(0, node)
                p = np.concatenate([np.arange(i, j) for i, j in zip(a, b)]) if len(node) else np.zeros(0, np.int64)
                yield p[in_ring(lon[p], lat[p], xs, ys)], zone
                break
            level -= 1
            node = np.concatenate([2 * node, 2 * node + 1])
            node = node[node < tree.low[level].shape[1]]


def morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Interleaved bits of two 16-bit numbers."""
    def spread(v):
        v = v.astype(np.uint64)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = (v | (v << np.uint64(shift))) & np.uint64(mask)
        return v
    return spread(x) | (spread(y) << np.uint64(1))


def join_block(metres: float, within_s: int, zones):
    chord = 2 * EARTH_M * np.sin(metres / (2 * EARTH_M))
    reach = chord * (1 + 1e-12) + 1e-6  # boxes may not lose a pair to rounding

    def run(table: pa.Table) -> pa.Table:
        names = ("cell", "one", "two", "block", "home", "row_id", "mmsi", "t", "lon", "lat")
        c = {k: as_numpy(table[k]) for k in names}
        x = np.clip((c["lon"] + 180) / 360 * 65535, 0, 65535)
        y = np.clip((c["lat"] + 90) / 180 * 65535, 0, 65535)
        part = np.cumsum(np.r_[0, (np.diff(c["cell"]) != 0) | (np.diff(c["one"]) != 0) | (np.diff(c["two"]) != 0)])
        # a track keeps together (tight boxes along time); tracks lie along a space-filling curve
        order = np.lexsort((c["t"], c["mmsi"], part))
        track = np.flatnonzero(np.r_[True, (np.diff(part[order]) != 0) | (np.diff(c["mmsi"][order]) != 0)])
        size = np.diff(np.r_[track, len(order)])
        place = morton(np.add.reduceat(x[order], track) / size, np.add.reduceat(y[order], track) / size)
        order = order[np.lexsort((c["t"][order], c["mmsi"][order], np.repeat(place, size), part[order]))]
        c = {k: v[order] for k, v in c.items()}
        part = part[order]
        la, lo = np.radians(c["lat"]), np.radians(c["lon"])
        xyz = EARTH_M * np.vstack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
        kinds, left, right = [], [], []
        for p, q, sure in near_pairs(xyz, c["t"], part, c["mmsi"], reach, within_s):
            ok = c["mmsi"][p] != c["mmsi"][q]
            # the pair belongs to the cell where the smaller id is at home, and to its pair of blocks
            small = np.where(c["row_id"][p] < c["row_id"][q], p, q)
            ok &= c["home"][small] & (c["row_id"][p] != c["row_id"][q])
            ok &= ((c["block"][p] == c["one"][p]) & (c["block"][q] == c["two"][p])) | ((c["block"][q] == c["one"][p]) & (c["block"][p] == c["two"][p]))
            p, q = p[ok], q[ok]
            if not sure:
                ok = great_circle(c["lon"][p], c["lat"][p], c["lon"][q], c["lat"][q]) <= metres
                p, q = p[ok], q[ok]
            else:  # accepted as a whole; only the rounding margin of the boxes is looked at
                d2 = ((xyz[:, p] - xyz[:, q]) ** 2).sum(0)
                edge = np.flatnonzero(d2 > (chord * (1 - 1e-9)) ** 2)
                bad = edge[great_circle(c["lon"][p[edge]], c["lat"][p[edge]], c["lon"][q[edge]], c["lat"][q[edge]]) > metres]
                p, q = np.delete(p, bad), np.delete(q, bad)
            left.append(np.minimum(c["row_id"][p], c["row_id"][q]))
            right.append(np.maximum(c["row_id"][p], c["row_id"][q]))
        pairs = sum(map(len, left))
        mine = np.flatnonzero(c["home"] & (c["one"] == c["block"]) & (c["two"] == c["block"]))
        for p, zone in contained(c["lon"][mine], c["lat"][mine], zones):
            left.append(c["row_id"][mine[p]])
            right.append(np.full(len(p), zone, np.int64))
        total = sum(map(len, left))
        kinds = pa.DictionaryArray.from_arrays(pa.array(np.r_[np.zeros(pairs, np.int8), np.ones(total - pairs, np.int8)]), ["vessel", "zone"]).cast(pa.string())
        return pa.table({"kind": kinds, "left_id": pa.array(np.concatenate(left) if left else [], pa.int64()), "right_id": pa.array(np.concatenate(right) if right else [], pa.int64())})

    return run


def band_of(lat: Column, deg: float) -> tuple[Column, Column]:
    """(band of latitude, its number of columns); columns widen towards the poles."""
    bands = max(1, int(180 / deg))
    band = F.least(F.greatest(F.floor((lat + 90) / deg), F.lit(0)), F.lit(bands - 1)).cast("long")
    edge = F.greatest(F.abs(band * deg - 90), F.abs((band + 1) * deg - 90))
    return band, F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * (360 / deg))).cast("long")


def cell_of(lon: Column, lat: Column, t: Column, deg: float, slot_s: int, parts: tuple[int, int, float] | None = None) -> Column:
    """One number for (slot, band of latitude, column of longitude).

    ``parts`` (slots in a slot, bands in a band, least degrees of a column) gives
    the number of the fine cell: every fine cell lies in one cell as a whole.
    """
    band, columns = band_of(lat, deg)
    along = F.pmod(lon + 180, F.lit(360.0)) / 360 * columns
    col = F.least(F.floor(along), columns - 1).cast("long")
    if parts is None:
        return F.floor(t / slot_s).cast("long") * (1 << 32) + band * (1 << 16) + col
    slots, rows, least = parts
    inner = F.least(F.greatest(F.floor((lat + 90 - band * deg) / deg * rows), F.lit(0)), F.lit(rows - 1)).cast("long")
    fine = band * rows + inner
    edge = F.greatest(F.abs(fine * (deg / rows) - 90), F.abs((fine + 1) * (deg / rows) - 90))
    cols = F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * 360 / columns / least)).cast("long")
    sub = F.least(F.floor((along - col) * cols), cols - 1).cast("long")
    return F.floor(t / slot_s * slots).cast("long") * (1 << 32) + fine * (1 << 16) + col * cols + sub


class Grid:
    """Cells of ``deg`` degrees and ``slot_s`` seconds, the fine cells in them, and which of them a row of (lon, lat, t) can reach."""

    def __init__(self, metres: float, within_s: int):
        size = metres / M_PER_DEG
        self.deg, self.slot_s, self.within_s, self.dy = max(CELL_DEG, 4 * size), max(SLOT_S, 4 * within_s), within_s, size * 1.001
        # a cell holds a reach twice and more, either way and in time, so the corners of a reach meet all its cells
        bands = max(1, min(int(self.deg / max(FINE_CELLS * size, 1e-9)), int((1 << 15) * self.deg / 180)))
        self.parts = (max(1, min(self.slot_s // max(FINE_SLOTS * within_s, 1), self.slot_s // 60)), bands, self.deg / bands)

    def coarse(self, lon: Column, lat: Column, t: Column) -> Column:
        return cell_of(lon, lat, t, self.deg, self.slot_s)

    def fine(self, lon: Column, lat: Column, t: Column) -> Column:
        """Numbers of fine cells are negative."""
        return -1 - cell_of(lon, lat, t, self.deg, self.slot_s, self.parts)

    @property
    def place(self) -> tuple[Column, Column, Column]:
        return F.col("lon"), F.col("lat"), F.col("t")

    @property
    def dx(self) -> Column:
        return F.least(F.lit(180.0), self.dy / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("lat")) + self.dy, F.lit(89.999)))), F.lit(1e-5)))

    def corners(self, f) -> Column:
        """``f(lon, lat, t)`` of the eight corners of what a row can reach: a cell holds a reach twice, so corners meet all its cells."""
        signs = F.lit([f"{x}{y}{z}" for x in "-+" for y in "-+" for z in "-+"])
        sign = lambda o, i: F.when(F.substring(o, i, 1) == "-", -1).otherwise(1)
        return F.transform(signs, lambda o: f(F.col("lon") + sign(o, 1) * self.dx, F.col("lat") + sign(o, 2) * self.dy, F.col("t") + sign(o, 3) * self.within_s))

    def reach(self) -> Column:
        """Distinct cells in reach; most rows lie well inside their own."""
        lon, lat, t = self.place
        into_y, into_t = F.pmod(lat + 90, F.lit(self.deg)), F.pmod(t, F.lit(self.slot_s))
        _, columns = band_of(lat, self.deg)
        along, wide = F.pmod(lon + 180, F.lit(360.0)) / 360 * columns, self.dx / 360 * columns * 1.001
        into_x = along - F.floor(along)
        inner = (
            (into_y > self.dy) & (into_y < self.deg - self.dy) & (into_t >= self.within_s) & (into_t < self.slot_s - self.within_s)
            & (into_x > wide) & (into_x < 1 - wide)
        )
        home = self.coarse(*self.place)
        return F.when(inner, F.array(home)).otherwise(F.array_distinct(F.concat(F.array(home), self.corners(self.coarse))))

    def fine_reach(self, cell: str) -> Column:
        """Distinct fine cells in reach that lie in ``cell``."""
        each = self.corners(lambda x, y, t: F.struct(self.coarse(x, y, t).alias("up"), self.fine(x, y, t).alias("down")))
        own = F.when(self.coarse(*self.place) == F.col(cell), F.array(self.fine(*self.place))).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.concat(own, F.transform(F.filter(each, lambda c: c["up"] == F.col(cell)), lambda c: c["down"])))


def crowded(counts: DataFrame, hot_rows: int) -> DataFrame | None:
    """(cell, blocks) of cells with more than ``hot_rows`` rows; none at all is None, few are broadcast, many are joined."""
    hot = counts.where(F.col("count") > hot_rows).select("cell", F.ceil(F.col("count") / hot_rows).cast("int").alias("blocks"))
    first = hot.limit(MOST_HOT + 1).collect()
    if not first:
        return None
    return hot if len(first) > MOST_HOT else F.broadcast(counts.sparkSession.createDataFrame(first, "cell long, blocks int"))


def near(points: DataFrame, zones: DataFrame, metres: float, within_s: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(kind, left_id, right_id): pairs of points of different mmsi within ``metres`` and ``within_s``, and zones that hold a point.

    ``points``: row_id (unique), mmsi, t (seconds), lon, lat, all usable; rows with
    nulls give nothing.  ``zones``: zone_id, xs, ys - a fixed list, size checked;
    rings with fewer than three points or null vertices hold nothing.  Identical
    positions and repeated reports all count; empty tables give no rows.
    """
    rings, seen = [], 0
    for r in zones.select("zone_id", "xs", "ys").limit(MOST_ZONES + 1).toLocalIterator():
        seen += 1
        if r.zone_id is None or r.xs is None or r.ys is None:
            continue
        xs, ys = np.array(r.xs, dtype=float), np.array(r.ys, dtype=float)
        if len(xs) >= 3 and len(xs) == len(ys) and not (np.isnan(xs).any() or np.isnan(ys).any()):
            rings.append((int(r.zone_id), xs, ys))
    if seen > MOST_ZONES:
        raise ValueError("more regions than one task should hold: join them as points of their own")
    pts = points.select("row_id", "mmsi", "t", "lon", "lat").dropna()
    grid = Grid(metres, within_s)
    home = grid.coarse(*grid.place)
    rows = pts.withColumn("cell", F.explode(grid.reach())).withColumn("home", F.col("cell") == home)
    hot = crowded(pts.groupBy(home.alias("cell")).count(), hot_rows)
    dense = None
    if hot is not None:
        cells = F.when(F.col("blocks").isNull(), F.array("cell")).otherwise(grid.fine_reach("cell"))
        rows = (
            rows.join(hot, "cell", "left").withColumn("_cell", F.explode(cells))
            .withColumn("home", F.col("home") & (F.col("blocks").isNull() | (F.col("_cell") == grid.fine(*grid.place))))
            .drop("cell", "blocks").withColumnRenamed("_cell", "cell")
        )
        dense = crowded(rows.where("home and cell < 0").groupBy("cell").count(), hot_rows)
    if dense is None:
        cut = rows.select("*", F.lit(0).alias("block"), F.lit(0).alias("one"), F.lit(0).alias("two"))
    else:
        n = F.coalesce("blocks", F.lit(1))
        cut = (
            rows.join(dense, "cell", "left")
            .withColumn("block", F.pmod(F.hash("row_id"), n).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumn("one", F.least("block", "_o")).withColumn("two", F.greatest("block", "_o"))
            .drop("blocks", "_o")
        )
    columns = ("cell", "one", "two", "block", "home", "row_id", "mmsi", "t", "lon", "lat")
    return grouped_blocks(cut.select(*columns), ["cell", "one", "two"], [], join_block(metres, within_s, rings), OUT, rows=100_000)


def p3_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/ais_dynamic.parquet")
    pts = d.where(usable_position(d.mmsi, d.longitude, d.latitude)).select(
        "row_id", "mmsi", seconds(d.time).alias("t"), d.longitude.alias("lon"), d.latitude.alias("lat")
    )
    return near(pts, spark.read.parquet(f"{sf_dir}/zones.parquet"), 250.0, 120)


P3_SQL = """
WITH p AS (SELECT row_id, mmsi, CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END AS t, longitude AS lon, latitude AS lat
           FROM ais_dynamic WHERE mmsi >= 201000000 AND mmsi < 776000000 AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90),
b AS (SELECT *, CAST(floor(t / 120) AS BIGINT) AS s, CAST(floor(lat * 200) AS BIGINT) AS y FROM p),
n AS (SELECT row_id, mmsi, t, lon, lat, s + unnest([-1, 0, 1]) AS s, y FROM b),
m AS (SELECT row_id, mmsi, t, lon, lat, s, y + unnest([-1, 0, 1]) AS y FROM n),
e AS (SELECT zone_id, xs[i] AS ax, ys[i] AS ay, xs[CASE WHEN i = len(xs) THEN 1 ELSE i + 1 END] AS bx, ys[CASE WHEN i = len(xs) THEN 1 ELSE i + 1 END] AS by
      FROM (SELECT zone_id, xs, ys, unnest(generate_series(1, len(xs))) AS i FROM zones)),
x AS (SELECT zone_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY zone_id)
SELECT 'vessel' AS kind, a.row_id AS left_id, c.row_id AS right_id FROM b a JOIN m c ON a.s = c.s AND a.y = c.y
WHERE a.row_id < c.row_id AND a.mmsi <> c.mmsi AND abs(a.t - c.t) <= 120
  AND 2 * 6371008.8e0 * asin(sqrt(least(1e0, power(sin(radians(c.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lon - a.lon) / 2), 2)))) <= 250e0
UNION ALL
SELECT 'zone', p.row_id, e.zone_id FROM p JOIN x ON p.lon BETWEEN x.x0 AND x.x1 AND p.lat BETWEEN x.y0 AND x.y1 JOIN e ON e.zone_id = x.zone_id
WHERE (e.ay > p.lat) <> (e.by > p.lat) AND p.lon < (e.bx - e.ax) * (p.lat - e.ay) / (e.by - e.ay) + e.ax
GROUP BY p.row_id, e.zone_id HAVING count(*) % 2 = 1
"""
