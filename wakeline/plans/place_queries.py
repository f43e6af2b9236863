"""Queries of what lies around: rasters, zones, ports and the registry from files, the service's answers, the live receiver.

Files are written from the tables (or by a rule) to the shared folder and read back by the sources.
"""

from __future__ import annotations

import json
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.hexgrid import area_table
from wakeline.operators import resample, tracks, zones
from wakeline.plans import export, service
from wakeline.plans.catalogue import _ILAT, _ILON, _MX, _MY, _T, BOX, END, INSIDE, PINGS, START, TRANSITS, ZONES, geom, hav, pings, registrar, table
from wakeline.plans.graph import graph
from wakeline.plans.ingest_queries import _positions_sql, position_lines, voyage_lines
from wakeline.plans.shipping import fresh_folder, put_file
from wakeline.plans.store import Store, ingest
from wakeline.sources import files, grids, nmea, places
from wakeline.streaming import receiver

Q: dict = {}
SQL: dict = {}
query = registrar(Q, SQL)


# -- rasters ----------------------------------------------------------------

TILES = [(north, west) for north in range(-60, 91, 30) for west in range(-180, 121, 60)]


def _tile_files(spark) -> str:
    """Height tiles of half a degree a cell: height of cell (ix, iy) of the tile is (ix * 31 + iy * 17 + west + north) % 997 - 700."""
    out = fresh_folder(spark, "tiles")
    for k, (north, west) in enumerate(TILES):
        iy, ix = np.indices((60, 120))
        r = grids.Raster((ix * 31 + iy * 17 + west + north + 1000) % 997 - 700.0, grids.Axis(float(west), 0.5, 120), grids.Axis(float(north), -0.5, 60))
        body = grids.geotiff_bytes(r, ("plain", "deflate", "lzw")[k % 3], (None, 32)[k % 2])
        put_file(spark, f"{out}/gebco_2022_n{north}.0_s{north - 30}.0_w{west}.0_e{west + 60}.0.tif", body)
    return out


@query(f"""WITH {PINGS}, t AS (SELECT 'gebco_2022_n' || n || '.0_s' || (n - 30) || '.0_w' || w || '.0_e' || (w + 60) || '.0.tif' AS tile, n, w FROM (SELECT unnest(generate_series(-60, 90, 30)) AS n) CROSS JOIN (SELECT unnest(generate_series(-180, 120, 60)) AS w)),
h AS (SELECT p.row_id, min({{'tile': t.tile, 'n': t.n, 'w': t.w}}) AS t, any_value(p.lon) AS lon, any_value(p.lat) AS lat FROM pings p JOIN t ON p.lon BETWEEN t.w AND t.w + 60 AND p.lat BETWEEN t.n - 30 AND t.n GROUP BY p.row_id),
c AS (SELECT row_id, t.n AS n, t.w AS w, CAST(least(greatest(ceil((lon - t.w) / 0.5e0), 0), 119) AS BIGINT) AS ix, CAST(least(greatest(ceil((lat - t.n) / -0.5e0), 0), 59) AS BIGINT) AS iy FROM h)
SELECT row_id, CAST(700 - (ix * 31 + iy * 17 + w + n + 1000) % 997 AS DOUBLE) AS depth_metres FROM c""")
def gebco_depth(spark, d):
    """Depth from tiles of heights: strips and blocks, plain, deflated and LZW."""
    return grids.with_depth(pings(spark, d), spark, f"{_tile_files(spark)}/*.tif").select("row_id", "depth_metres")


_RULES = {"shore": (7, 3), "port": (11, 5), "coast": (13, 2)}


def _distance_sql(a: int, b: int, name: str) -> str:
    return f"CAST((ix * {a} + iy * {b}) % 500 AS DOUBLE) AS {name}"


@query(f"""WITH {PINGS}, c AS (SELECT row_id, CAST(least(greatest(ceil(lon + 180), 0), 359) AS BIGINT) AS ix, CAST(least(greatest(ceil((lat - 90) / -1e0), 0), 179) AS BIGINT) AS iy FROM pings)
SELECT row_id, {', '.join(_distance_sql(a, b, grids.DISTANCES[k]) for k, (a, b) in _RULES.items())} FROM c""")
def raster_distances(spark, d):
    """km_from_shore, km_from_port and km_from_coast from three rasters."""
    out, paths = fresh_folder(spark, "distances"), {}
    iy, ix = np.indices((180, 360))
    for kind, (a, b) in _RULES.items():
        r = grids.Raster((ix * a + iy * b) % 500 + 0.0, grids.Axis(-180.0, 1.0, 360), grids.Axis(90.0, -1.0, 180))
        paths[kind] = put_file(spark, f"{out}/{kind}.tif", grids.geotiff_bytes(r, "deflate", 64))
    return grids.with_distances(pings(spark, d), spark, paths).select("row_id", *grids.DISTANCES.values())


@query("SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(edge_m AS DOUBLE) AS edge_m, round(3 * sqrt(3e0) / 2 * power(edge_m * cos(radians(latitude)), 2) / 1e6, 6) AS km2 FROM (SELECT unnest(generate_series(-80, 80, 10)) AS latitude) CROSS JOIN (SELECT unnest([500, 5000, 50000]) AS edge_m)")
def cell_areas(spark, d):
    """True areas of hexagonal cells by latitude and size."""
    return area_table(spark, list(range(-80, 81, 10)), [500, 5000, 50_000]).withColumn("km2", F.round("km2", 6))


# -- zones, ports, registry -------------------------------------------------

@query("SELECT zone_name, xs, ys FROM zones")
def zone_files(spark, d):
    """Zones as text files and back."""
    out = fresh_folder(spark, "zones")
    for r in table(spark, d, "zones").select("zone_name", "xs", "ys").toLocalIterator():  # a fixed list of zones
        put_file(spark, f"{out}/{r.zone_name}.txt", "\n".join(f"{x!r},{y!r}" for x, y in zip(r.xs, r.ys)).encode())
    return places.zones_from_text(spark, f"{out}/*.txt")


@query("SELECT zone_name, list_transform(xs, lambda v: round(v, 6)) AS xs, list_transform(ys, lambda v: round(v, 6)) AS ys FROM zones")
def zones_from_vertices(spark, d):
    """Zones from vertices in Web Mercator metres."""
    v = table(spark, d, "zones").select("zone_id", "zone_name", F.posexplode(F.arrays_zip("xs", "ys")).alias("seq", "p"))
    v = v.select(F.col("zone_id").alias("zone"), "zone_name", "seq", geo.mercator_x(F.col("p.xs")).alias("x"), geo.mercator_y(F.col("p.ys")).alias("y"))
    r6 = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return zones.from_vertices(v, "zone_name", 3857).select("zone_name", r6("xs"), r6("ys"))


@query("""WITH b AS (SELECT port_name, longitude AS x, latitude AS y, degrees(1000 * (port_id + 1) / (6371088e0 * cos(radians(latitude)))) AS dx, degrees(1000 * (port_id + 1) / 6371088e0) AS dy FROM ports)
SELECT port_name AS zone, round(x - dx, 6) AS xmin, round(x + dx, 6) AS xmax, round(y - dy, 6) AS ymin, round(y + dy, 6) AS ymax FROM b""")
def boxes_around_ports(spark, d):
    """Square zones around points, each with its radius."""
    p = table(spark, d, "ports").select(F.col("port_name").alias("name"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), (F.col("port_id") + 1).cast("double").alias("radius")).withColumn("radius", F.col("radius") * 1000)
    return zones.geometry(zones.boxes_around(p)).select("zone", *[F.round(c, 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query("SELECT 'all_' || CAST(row_number() OVER (ORDER BY zone_id) - 1 AS VARCHAR) AS zone, list_min(xs) AS xmin, list_max(xs) AS xmax, list_min(ys) AS ymin, list_max(ys) AS ymax FROM zones")
def multipolygon_parts(spark, d):
    """A multipolygon taken apart into named zones."""
    z = table(spark, d, "zones").agg(F.array_sort(F.collect_list(F.struct("zone_id", "xs", "ys"))).alias("r"))
    m = z.select(F.lit("all").alias("zone_name"), F.transform("r", lambda p: F.struct(p["xs"].alias("xs"), p["ys"].alias("ys"))).alias("rings"))
    return zones.geometry(zones.exploded(m)).select("zone", "xmin", "xmax", "ymin", "ymax")


@query(f"WITH {ZONES} SELECT p.port_id AS row_id, g.zone, round({hav('p.longitude', 'p.latitude', 'g.cx', 'g.cy')} - g.maxradius, 1) AS distance FROM ports p CROSS JOIN geom g")
def nearest_polygons(spark, d):
    """Every zone's distance from each port: two fixed lists."""
    p = table(spark, d, "ports").select(F.col("port_id").alias("row_id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return zones.zone_distances(p, geom(spark, d))


@query(f"SELECT port_name AS \"PORT_NAME\", longitude, latitude FROM ports WHERE longitude BETWEEN {BOX['xmin']} AND {BOX['xmax']} AND latitude BETWEEN {BOX['ymin']} AND {BOX['ymax']}")
def port_index(spark, d):
    """The port index as features, asked for a box."""
    feats = [{"type": "Feature", "properties": {"PORT_NAME": r.port_name}, "geometry": {"type": "Point", "coordinates": [r.longitude, r.latitude]}} for r in table(spark, d, "ports").toLocalIterator()]
    path = put_file(spark, f"{fresh_folder(spark, 'ports')}/ports.json", json.dumps({"type": "FeatureCollection", "features": feats}).encode())
    return places.ports_from_geojson(spark, path, (BOX["xmin"], BOX["ymin"], BOX["xmax"], BOX["ymax"]))


@query("""SELECT mmsi, imo, CASE WHEN mmsi % 3 = 0 THEN 'NEW ' || coalesce(name, '') ELSE name END AS name, CASE WHEN mmsi % 3 = 0 THEN 0 ELSE error404 END AS error404 FROM vessel_registry
UNION ALL SELECT mmsi + 1000000000, imo, 'NEW ' || coalesce(name, ''), 0 FROM vessel_registry WHERE mmsi % 5 = 0""")
def registry_upsert(spark, d):
    """A third of the registry replaced, some vessels new; of two new rows the later one counts."""
    old = table(spark, d, "vessel_registry").select("mmsi", "imo", "name", "error404")
    fresh = old.withColumn("name", F.concat(F.lit("NEW "), F.coalesce("name", F.lit("")))).withColumn("error404", F.lit(0))
    new = fresh.where("mmsi % 3 = 0").unionByName(fresh.where("mmsi % 5 = 0").withColumn("mmsi", F.col("mmsi") + 1_000_000_000))
    stale = new.withColumn("name", F.lit("STALE")).withColumn("seen", F.lit(1))
    return places.registry_upsert(old, new.withColumn("seen", F.lit(2)).unionByName(stale))


# -- the service ------------------------------------------------------------

_AREA = {"x0": BOX["xmin"], "x1": BOX["xmax"], "y0": BOX["ymin"], "y1": BOX["ymax"]}


@query("SELECT zone_name AS name, xs AS x, ys AS y FROM zones")
def service_zones(spark, d):
    m = service.answer({"msgtype": "zones"}, pings(spark, d), geom=geom(spark, d))
    v = F.from_json("message", "msgtype string, meta struct<name: string>, x array<double>, y array<double>")
    return m.select(v.alias("v")).where("v.msgtype = 'zone'").select("v.meta.name", "v.x", "v.y")


@query(f"WITH {PINGS} SELECT mmsi, imo, name FROM vessel_registry WHERE error404 <> 1 AND mmsi IN (SELECT mmsi FROM pings)")
def service_meta(spark, d):
    m = service.answer({"msgtype": "meta"}, pings(spark, d), table(spark, d, "vessel_registry"))
    return m.select(F.from_json("message", "meta struct<mmsi: bigint, imo: bigint, name: string>").alias("v")).select("v.meta.*")


@query(f"WITH {PINGS} SELECT CAST(floor(lon / 0.5e0) AS INTEGER) AS cx, CAST(floor(lat / 0.5e0) AS INTEGER) AS cy, count(*) AS pings FROM pings WHERE {_T} AND lon BETWEEN {BOX['xmin']} AND {BOX['xmax']} AND lat BETWEEN {BOX['ymin']} AND {BOX['ymax']} GROUP BY 1, 2")
def service_heatmap(spark, d):
    m = service.answer({"msgtype": "heatmap", "start": START, "end": END, "area": _AREA}, pings(spark, d))
    return m.select(F.from_json("message", "cx int, cy int, pings bigint").alias("v")).select("v.*")


_BOXED = f"{_T} AND lon BETWEEN {BOX['xmin']} AND {BOX['xmax']} AND lat BETWEEN {BOX['ymin']} AND {BOX['ymax']}"
_R4 = "round({} * 10000) / 10000"


@query(f"""WITH {PINGS}, b AS (SELECT * FROM pings WHERE {_BOXED}),
t AS (SELECT mmsi, list({_R4.format('lon')} ORDER BY time, row_id) AS x, list({_R4.format('lat')} ORDER BY time, row_id) AS y, list(time ORDER BY time, row_id) AS t FROM b GROUP BY mmsi)
SELECT 'track_vector' AS msgtype, t.mmsi, r.name, t.x, t.y, t.t, CAST(NULL AS BIGINT) AS count FROM t LEFT JOIN vessel_registry r ON r.mmsi = t.mmsi
UNION ALL SELECT 'done', NULL, NULL, NULL, NULL, NULL, count(*) FROM t""")
def service_tracks(spark, d):
    """Whole tracks of a box and span with what the registry knows of their vessels, and the count at the end."""
    r = {"msgtype": "track_vectors_extra", "start": START, "end": END, "area": _AREA}
    m = service.answer(r, pings(spark, d), table(spark, d, "vessel_registry"), decimate=None)
    v = F.from_json("message", "msgtype string, meta struct<mmsi: bigint, reg_name: string>, x array<double>, y array<double>, t array<bigint>, count bigint")
    return m.select(v.alias("v")).select("v.msgtype", "v.meta.mmsi", F.col("v.meta.reg_name").alias("name"), "v.x", "v.y", "v.t", "v.count")


@query(f"WITH {PINGS} SELECT mmsi, list(lon ORDER BY time, row_id) AS lon, list(time ORDER BY time, row_id) AS time, arg_min(source, {{'t': time, 'r': row_id}}) AS source FROM pings GROUP BY mmsi")
def track_arrays(spark, d):
    """Tracks as one row of arrays each, with what is constant along them."""
    return tracks.vectorised(pings(spark, d), static=("source",), vectors=("lon",)).select("mmsi", "lon", "time", "source")


@query(f"""WITH {PINGS}, l AS (SELECT *, CASE WHEN source IS DISTINCT FROM lag(source) OVER w OR lag(row_id) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY time, row_id)),
k AS (SELECT *, sum(b) OVER (PARTITION BY mmsi ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT mmsi, source, min(time) AS first_time, max(time) AS last_time, count(*) AS pings FROM k GROUP BY mmsi, source, run""")
def run_bounds(spark, d):
    """Maximal runs of one value along a track, with their bounds."""
    return tracks.runs(pings(spark, d), "source").select("mmsi", "source", "first_time", "last_time", "pings")


@query("SELECT port_id || ',' || replace(replace(port_name, ',', ''), '#', '') || ',' || coalesce(rtrim(harbor_size), '') AS line FROM ports")
def csv_plain_rows(spark, d):
    """Plain rows appended to a file without separators inside cells."""
    out = fresh_folder(spark, "rows")
    export.write_csv_rows(table(spark, d, "ports").select("port_id", "port_name", F.coalesce("harbor_size", F.lit("")).alias("h")), out)
    return spark.read.text(out).select(F.regexp_replace("value", '"', "").alias("line"))


# -- the movement graph -----------------------------------------------------

_STEP = 3600
_SAMPLES = f"""{PINGS.replace('pings AS', 'raw AS', 1)}, raw0 AS (SELECT * FROM raw WHERE abs(lat) < 85),
gap AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY mmsi ORDER BY time, row_id) >= 604800 THEN 1 ELSE 0 END AS b FROM raw0),
cut AS (SELECT *, CAST(sum(b) OVER (PARTITION BY mmsi ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS idx FROM gap),
one AS (SELECT mmsi * 1000 + idx AS mmsi, time, arg_min(lon, row_id) AS lon, arg_min(lat, row_id) AS lat FROM cut GROUP BY ALL),
m AS (SELECT *, {_MX.format('lon')} AS x, {_MY.format('lat')} AS y, min(time) OVER (PARTITION BY mmsi) AS t0, max(time) OVER (PARTITION BY mmsi) AS tn FROM one),
l AS (SELECT *, lead(time) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM m WINDOW w AS (PARTITION BY mmsi ORDER BY time)),
grid AS (SELECT mmsi, t0 + unnest(generate_series(0, CAST(ceil((tn - t0) / {_STEP}e0) AS BIGINT))) * {_STEP} AS gt FROM (SELECT DISTINCT mmsi, t0, tn FROM m) WHERE tn > t0),
j AS (SELECT grid.mmsi, grid.gt, l.* EXCLUDE (mmsi), CASE WHEN l.nt IS NOT NULL THEN (grid.gt - l.time) / CAST(l.nt - l.time AS DOUBLE) END AS f FROM grid JOIN l ON l.mmsi = grid.mmsi AND grid.gt >= l.time AND (grid.gt < l.nt OR l.nt IS NULL)),
pings AS (SELECT row_number() OVER () AS row_id, mmsi, gt AS time, {_ILON.format('CASE WHEN f IS NULL THEN x ELSE x + (nx - x) * f END')} AS lon, {_ILAT.format('CASE WHEN f IS NULL THEN y ELSE y + (ny - y) * f END')} AS lat FROM j)"""


@query(f"""WITH {_SAMPLES}, {ZONES}, {INSIDE}, {TRANSITS},
g AS (SELECT mmsi, edge, bool_or(final) AS final, first(in_zone ORDER BY time, row_id) AS src, last(in_zone ORDER BY time, row_id) AS rcv, min(time) AS first_time, max(time) AS last_time, count(*) AS pings FROM tr GROUP BY mmsi, edge)
SELECT mmsi // 1000 AS mmsi, CAST(mmsi % 1000 AS INTEGER) AS idx, edge, src AS src_name, CASE WHEN NOT final THEN rcv END AS rcv_name, first_time, last_time, pings FROM g""")
def graph_transits(spark, d):
    """Edges of the graph where bounds of speed and distance part nothing: splitting, encoding, resampling, fencing and transits in one."""
    p = pings(spark, d).where(F.abs("lat") < 85)
    e = graph(p, geom(spark, d), speed=1e9, distance=1e12, minscore=-2.0, step=timedelta(seconds=_STEP))
    return e.select("mmsi", "idx", "edge", "src_name", "rcv_name", "first_time", "last_time", "pings")


def _azimuth_sql(steps: int = 8) -> str:
    """CTEs of the inverse problem on the ellipsoid, iterated a fixed number of times, over n (k, lon, lat, lon2, lat2)."""
    f = "(1 / 298.257223563e0)"
    out = [f"""v0 AS (SELECT k, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, total, total AS lam FROM (SELECT k, atan((1 - {f}) * tan(radians(lat))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2,
  radians(lon2 - lon + CASE WHEN lon2 - lon >= 180 THEN -360 WHEN lon2 - lon < -180 THEN 360 ELSE 0 END) AS total FROM n))"""]
    for i in range(steps):
        out.append(f"""a{i} AS (SELECT *, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM v{i}),
b{i} AS (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM a{i}),
d{i} AS (SELECT *, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * s1 * s2 / (1 - sa * sa) END AS c2m, {f} / 16 * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) AS c FROM b{i}),
v{i + 1} AS (SELECT k, s1, c1, s2, c2, total, total + (1 - c) * {f} * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam FROM d{i})""")
    return ",\n".join(out) + f",\naz AS (SELECT k, degrees(atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam))) AS az FROM v{steps})"


@query(f"""WITH {_SAMPLES.replace('>= 604800', '>= 1e18')}, s AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY time)),
n AS (SELECT row_id AS k, lon, lat, lon2, lat2 FROM s WHERE lon2 IS NOT NULL), {_azimuth_sql()},
last AS (SELECT mmsi * 1000 AS mmsi, last(cog ORDER BY time, row_id) AS cog FROM raw0 GROUP BY mmsi)
SELECT s.mmsi // 1000 AS mmsi, s.time, round(CASE WHEN az.az IS NULL THEN last.cog ELSE az.az END, 3) + 0 AS cog FROM s JOIN last ON last.mmsi = s.mmsi LEFT JOIN az ON az.k = s.row_id
WHERE s.lon2 IS NULL OR abs(s.lon2 - s.lon) + abs(s.lat2 - s.lat) > 1e-4""")
def geodesic_courses(spark, d):
    """Courses from sample to sample on the ellipsoid; where a vessel hardly moves a course says nothing and is left out on both sides."""
    from pyspark.sql import Window

    x = resample.geo_interp_time(pings(spark, d).where(F.abs("lat") < 85), _STEP)
    w = Window.partitionBy("mmsi").orderBy("time")
    x = x.withColumn("_x", F.lead("lon").over(w)).withColumn("_y", F.lead("lat").over(w))
    x = x.where(F.col("_x").isNull() | (F.abs(F.col("_x") - F.col("lon")) + F.abs(F.col("_y") - F.col("lat")) > 1e-4))
    return x.select("mmsi", "time", (F.round("cog", 3) + F.lit(0.0)).alias("cog"))


# -- files and streams ------------------------------------------------------

_ONE = _positions_sql().replace("FROM r", "FROM r WHERE k = 0")


@query(f"WITH p AS ({_ONE}) SELECT DISTINCT mmsi, time, longitude, latitude, coalesce(sog, 0) AS sog, coalesce(cog, 0) AS cog FROM p WHERE longitude <> 0 AND latitude <> 0")
def stream_receiver(spark, d):
    """The receiver drained over a log of position reports: decoded, filtered, stored without repeats."""
    log = f"{fresh_folder(spark, 'live')}"
    position_lines(spark, d).where("n % 4 = 0").select("line").repartition(4).write.text(log)
    lines = spark.readStream.text(log).select(F.col("value").alias("line"), F.current_timestamp().alias("arrival"))
    store = Store(spark, fresh_folder(spark, "store"))
    receiver.start(lines, store, fresh_folder(spark, "checkpoint"), interval=None).awaitTermination()
    return store.dynamic().select("mmsi", "time", "longitude", "latitude", "sog", "cog")


@query("SELECT count(*) AS messages, count(DISTINCT mmsi) AS vessels FROM ais_static WHERE mmsi >= 201000000 AND mmsi < 776000000 AND time IS NOT NULL AND static_id % 2 = 0")
def stream_fragments(spark, d):
    """Fragments of voyage reports put together in keyed state."""
    log = fresh_folder(spark, "fragments")
    voyage_lines(spark, d).coalesce(1).sortWithinPartitions("file", "n").where("line like '%AIVDM,2,%'").select("line").write.text(log)
    lines = spark.readStream.text(log).select(F.col("value").alias("line"), F.current_timestamp().alias("arrival"))
    out = fresh_folder(spark, "whole")
    messages = receiver.messages(receiver.sentences(lines))
    messages.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    rows = nmea.static_rows(spark.read.schema(messages.schema).parquet(f"{out}/rows"), "x", keep_nulls=True)
    return rows.agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("mmsi").alias("vessels"))


@query(f"WITH p AS ({_ONE}) SELECT DISTINCT mmsi, time, coalesce(longitude, 0) AS longitude, coalesce(latitude, 0) AS latitude FROM p")
def ingest_files(spark, d):
    """Files ingested by their names, the second time left out by their checksums."""
    log = fresh_folder(spark, "ingest")
    position_lines(spark, d).where("n % 4 = 0").select("line").repartition(3).write.option("compression", "gzip").text(log)
    store = Store(spark, fresh_folder(spark, "store"))
    names = files.glob_files(log.removeprefix("file:"), ".txt.gz")
    for _ in range(2):
        ingest(store, names, "x", skip_checksum=False)
    return store.dynamic().select("mmsi", "time", "longitude", "latitude")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)
