"""Gridded data: rasters (GeoTIFF), tile sets, weather cubes; and lookups in them.

A raster is a long table (ix, iy, value) with a regular or irregular axis each
way; pings meet it by computed cell numbers and an equality join.  Files are read
by the workers, a strip or block at a time, so a global raster is no burden.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.scalar import cell_index, nearest_index
from wakeline.operators.joins import tile_lookup

# Names of the columns that rasters of distances fill.
DISTANCES = {"shore": "km_from_shore", "port": "km_from_port", "coast": "km_from_coast"}


@dataclass
class Axis:
    start: float
    step: float
    size: int


@dataclass
class Raster:
    values: np.ndarray  # rows from the first latitude on
    lon: Axis
    lat: Axis

    def table(self, spark: SparkSession) -> DataFrame:
        iy, ix = np.indices(self.values.shape)
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame({"ix": ix.ravel().astype("int32"), "iy": iy.ravel().astype("int32"), "value": self.values.ravel().astype(float)}))


# Sizes and codes of TIFF field types.
FIELD = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


class GeoTiff:
    """A GeoTIFF of one band: strips or blocks, plain, deflated or LZW, with or without horizontal differences; small or big TIFF."""

    def __init__(self, data: bytes, path: str = "raster"):
        self.data, self.path = data, path
        self.end = {b"II": "<", b"MM": ">"}.get(data[:2])
        version = struct.unpack(self.end + "H", data[2:4])[0] if self.end else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = version == 43
        at = struct.unpack(self.end + "Q", data[8:16])[0] if big else struct.unpack(self.end + "I", data[4:8])[0]
        head, entry, room = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
        first = at + struct.calcsize(self.end + head)
        self.tags: dict[int, tuple] = {}
        for k in range(struct.unpack(self.end + head, data[at:first])[0]):
            where = first + k * (struct.calcsize(self.end + entry) + room)
            tag, kind, count = struct.unpack(self.end + entry, data[where : where + struct.calcsize(self.end + entry)])
            if kind not in FIELD:
                continue
            code, size = FIELD[kind]
            where += struct.calcsize(self.end + entry)
            if size * count > room:
                where = struct.unpack(self.end + ("Q" if big else "I"), data[where : where + room])[0]
            self.tags[tag] = struct.unpack(f"{self.end}{count}{code}", data[where : where + size * count])
        self.width, self.height = self.tags[256][0], self.tags[257][0]
        form = {1: "u", 2: "i", 3: "f"}[self.tags.get(339, (1,))[0]]
        self.kind = np.dtype(f"{self.end}{form}{self.tags.get(258, (8,))[0] // 8}")
        if self.tags.get(277, (1,))[0] != 1:
            raise ValueError(f"{path} has more than one band")

    def axes(self) -> tuple[Axis, Axis]:
        """Longitudes and latitudes, placed by tie point and scale or by a matrix."""
        t = self.tags
        if 33550 in t and 33922 in t:
            (sx, sy), (i, j, _, x, y) = t[33550][:2], t[33922][:5]
            return Axis(x - i * sx, sx, self.width), Axis(y + j * sy, -sy, self.height)
        if 34264 in t:
            m = t[34264]
            return Axis(m[3], m[0], self.width), Axis(m[7], m[5], self.height)
        raise ValueError(f"{self.path} is not placed on the earth")

    def unpacked(self, body: bytes) -> bytes:
        how = self.tags.get(259, (1,))[0]
        if how == 1:
            return body
        if how in (8, 32946):
            return zlib.decompress(body)
        if how == 5:
            return unlzw(body)
        raise ValueError(f"{self.path}: compression {how} is not read")

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first column, first row, values) of each strip or block."""
        t = self.tags
        if 322 in t:
            w, h, at, size = t[322][0], t[323][0], t[324], t[325]
        else:
            w, h, at, size = self.width, t.get(278, (self.height,))[0], t[273], t[279]
        across = -(-self.width // w)
        for k, (o, n) in enumerate(zip(at, size)):
            x, y = k % across * w, k // across * h
            rows = h if 322 in t else min(h, self.height - y)
            values = np.frombuffer(self.unpacked(self.data[o : o + n]), self.kind, rows * w).reshape(rows, w)
            if t.get(317, (1,))[0] == 2:
                values = np.cumsum(values, axis=1, dtype=self.kind)
            yield x, y, values[: self.height - y, : self.width - x]


def unlzw(body: bytes) -> bytes:
    """Bytes of an LZW stream as TIFF packs it: codes of 9 to 12 bits, high bits first, the width growing one code early."""
    out, table, width, last = [], [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
    held, bits = 0, 0
    for byte in body:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def relzw(body: bytes) -> bytes:
    """A valid LZW stream without any compression: literals, with the table cleared before codes would widen."""
    out, held, bits = bytearray(), 0, 0
    codes = [c for k in range(0, len(body), 250) for c in (256, *body[k : k + 250])] + [257]
    for code in codes:
        held, bits = held << 9 | code, bits + 9
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    return bytes(out + bytes([held << (8 - bits)]) if bits else out)


def read_geotiff(path: str) -> Raster:
    """A raster of one file, whole in memory; large ones are better read by the workers (``raster_cells``)."""
    t = GeoTiff(Path(path).read_bytes(), path)
    lon, lat = t.axes()
    values = np.zeros((t.height, t.width), t.kind)
    for x, y, v in t.blocks():
        values[y : y + v.shape[0], x : x + v.shape[1]] = v
    return Raster(values, lon, lat)


def geotiff_bytes(raster: Raster, pack: str = "plain", block: int | None = None) -> bytes:
    """32-bit floats as a GeoTIFF of one strip, or of square blocks: plain, deflate or lzw."""
    squeeze = {"plain": lambda b: b, "deflate": zlib.compress, "lzw": relzw}[pack]
    h, w = raster.values.shape
    v = raster.values.astype("<f4")
    if block:
        v = np.pad(v, ((0, -h % block), (0, -w % block)))
        bodies = [squeeze(v[y : y + block, x : x + block].tobytes()) for y in range(0, v.shape[0], block) for x in range(0, v.shape[1], block)]
    else:
        bodies = [squeeze(v.tobytes())]
    n = len(bodies)
    shape = [(322, 3, 1, block), (323, 3, 1, block), (324, 4, n, None), (325, 4, n, None)] if block else [(273, 4, n, None), (278, 4, 1, h), (279, 4, n, None)]
    entries = sorted([(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, {"plain": 1, "deflate": 8, "lzw": 5}[pack]), (277, 3, 1, 1), (339, 3, 1, 3), (33550, 12, 3, None), (33922, 12, 6, None), *shape])
    at = 8 + 2 + 12 * len(entries) + 4
    scale, tie = struct.pack("<3d", raster.lon.step, -raster.lat.step, 0), struct.pack("<6d", 0, 0, 0, raster.lon.start, raster.lat.start, 0)
    tables = at + len(scale) + len(tie)
    start = tables + 8 * n
    offsets = [start + sum(map(len, bodies[:k])) for k in range(n)]
    place = {33550: at, 33922: at + len(scale)}
    for tag, values, spot in ((324 if block else 273, offsets, tables), (325 if block else 279, [len(b) for b in bodies], tables + 4 * n)):
        place[tag] = values[0] if n == 1 else spot
    out = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries))
    for tag, kind, count, value in entries:
        value = place.get(tag, value)
        out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    lists = struct.pack(f"<{n}I", *offsets) + struct.pack(f"<{n}I", *[len(b) for b in bodies])
    return out + struct.pack("<I", 0) + scale + tie + lists + b"".join(bodies)


def write_geotiff(path: str, raster: Raster, deflate: bool = False) -> None:
    Path(path).write_bytes(geotiff_bytes(raster, "deflate" if deflate else "plain"))


CELLS = "tile string, ix int, iy int, value double"
AXES = "tile string, x0 double, dx double, nx int, y0 double, dy double, ny int"


def _files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("tile"), "content")


def raster_cells(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(tile, ix, iy, value) of every cell of raster files; a worker holds one file and one of its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, body in zip(batch["tile"].to_pylist(), batch["content"]):
                for x, y, v in GeoTiff(body.as_py(), tile).blocks():
                    iy, ix = np.indices(v.shape, np.int32)
                    yield pa.record_batch({"tile": pa.array([tile] * v.size), "ix": pa.array((ix + x).ravel()), "iy": pa.array((iy + y).ravel()), "value": pa.array(v.ravel().astype(float))})

    return _files(spark, paths).mapInArrow(run, CELLS)


def raster_axes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(tile, x0, dx, nx, y0, dy, ny): where each file's cells lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tile, body in zip(batch["tile"].to_pylist(), batch["content"]):
                lon, lat = GeoTiff(body.as_py(), tile).axes()
                rows.append((tile, lon.start, lon.step, lon.size, lat.start, lat.step, lat.size))
            cols = list(zip(*rows))
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.record_batch({f.split()[0]: pa.array(c, k) for f, c, k in zip(AXES.split(", "), cols, kinds)})

    return _files(spark, paths).mapInArrow(run, AXES)


def with_tiles(points: DataFrame, spark: SparkSession, paths: list[str] | str, name: str) -> DataFrame:
    """``name``: value of the cell of the first tile (by name) that holds a point; a point without any tile is an error.

    Tiles say their bounds in their names; points need row_id.
    """
    axes = raster_axes(spark, paths)
    placed = tile_lookup(points, tile_bounds(axes)).withColumn("tile", F.when(F.col("tile").isNull(), F.raise_error(F.lit("a position lies in no raster tile"))).otherwise(F.col("tile")))
    at = lambda c, v: F.least(F.greatest(F.ceil((F.col(c) - F.col(f"{v}0")) / F.col(f"d{v}")), F.lit(0)), F.col(f"n{v}") - 1).cast("int")
    placed = placed.join(axes, "tile").withColumn("ix", at("lon", "x")).withColumn("iy", at("lat", "y")).select(*points.columns, "tile", "ix", "iy")
    cells = raster_cells(spark, paths).withColumnRenamed("value", name)
    return placed.join(cells, ["tile", "ix", "iy"], "left").drop("tile", "ix", "iy")


def with_depth(points: DataFrame, spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``depth_metres``: metres below the sea at each point, from tiles of heights."""
    return with_tiles(points, spark, paths, "_height").withColumn("depth_metres", -F.col("_height")).drop("_height")


def with_distances(points: DataFrame, spark: SparkSession, rasters: dict[str, str]) -> DataFrame:
    """km_from_shore, km_from_port, km_from_coast: values of the rasters given for them (shore, port, coast)."""
    out = points
    for kind, path in rasters.items():
        axes = raster_axes(spark, path).collect()  # one row a file
        if len(axes) != 1:
            raise ValueError(f"{path} is not one raster")
        a = axes[0]
        cells = raster_cells(spark, path).select("ix", "iy", "value")
        out = with_raster(out, cells, Axis(a.x0, a.dx, a.nx), Axis(a.y0, a.dy, a.ny), DISTANCES[kind])
    return out


def with_raster(points: DataFrame, values: DataFrame, lon: Axis, lat: Axis, name: str) -> DataFrame:
    """``name``: value of the cell whose axis values are the first not below the ping's (above, on a falling axis)."""
    y = cell_index(F.col("lat"), lat.start, lat.step, lat.size)
    p = points.withColumn("ix", cell_index(F.col("lon"), lon.start, lon.step, lon.size)).withColumn("iy", y)
    return p.join(values.withColumnRenamed("value", name), ["ix", "iy"], "left").drop("ix", "iy")


def tile_bounds(names: DataFrame, column: str = "tile") -> DataFrame:
    """Bounds of tiles named like ..._n90.0_s0.0_w-90.0_e0.0..."""
    part = lambda k: F.regexp_extract(column, rf"_{k}(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return names.select("*", part("n").alias("north"), part("s").alias("south"), part("w").alias("west"), part("e").alias("east")).where("north is not null and south is not null and west is not null and east is not null")


def parse_tile_name(name: str) -> dict[str, float]:
    return {k: float(v) for k, v in re.findall(r"_([nswe])(-?\d+(?:\.\d+)?)", name)}


def variables_of(catalogue: DataFrame, names: list[str]) -> dict[str, str]:
    """Variable of each short name, from a catalogue (short_name, variable) that the caller keeps; an unknown name is an error."""
    found = {r.short_name: r.variable for r in catalogue.where(F.col("short_name").isin(names)).select("short_name", "variable").dropDuplicates(["short_name"]).collect()}  # a row a name asked for
    unknown = [n for n in names if n not in found]
    if unknown:
        raise ValueError(f"unknown weather variables: {unknown}")
    return {n: found[n] for n in names}


def with_weather(points: DataFrame, cube: DataFrame, variables: list[str], known: list[str], lats: list[float], lons: list[float], times: list[int]) -> DataFrame:
    """One column per variable: the value nearest in latitude, longitude and time, each on its own; null where there is none.

    ``cube`` is long: short_name, ilat, ilon, itime (numbers on the rising axes), value.
    """
    unknown = [v for v in variables if v not in known]
    if unknown:
        raise ValueError(f"unknown weather variables: {unknown}")
    wide = cube.where(F.col("short_name").isin(variables)).groupBy("ilat", "ilon", "itime").agg(*[F.max(F.when(F.col("short_name") == v, F.col("value"))).alias(v) for v in variables])
    p = points.withColumn("ilat", nearest_index(lats, F.col("lat"))).withColumn("ilon", nearest_index(lons, F.col("lon"))).withColumn("itime", nearest_index([float(t) for t in times], F.col("time").cast("double")))
    return p.join(wide, ["ilat", "ilon", "itime"], "left").drop("ilat", "ilon", "itime")


def weather_request(variables: list[str], start, end, box: tuple[float, float, float, float]) -> list[dict]:
    """Requests, one a month, for hourly reanalysis of the box (north, west, south, east)."""
    from calendar import monthrange

    from wakeline.functions.scalar import months_between

    north, west, south, east = box
    if not (-90 <= south < north <= 90 and -180 <= west < east <= 180):
        raise ValueError("the box is (north, west, south, east)")
    if start > end:
        raise ValueError("start is after end")
    return [
        {"variable": list(variables), "year": m[:4], "month": m[4:], "day": [f"{d:02d}" for d in range(1, monthrange(int(m[:4]), int(m[4:]))[1] + 1)], "time": [f"{h:02d}:00" for h in range(24)], "area": [north, west, south, east]}
        for m in months_between(start, end)
    ]
