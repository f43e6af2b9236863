"""One query per operator of the toolkit over the vessel tables, each with the SQL it is compared with.

Both sides start from ``pings``: reports with a valid identifier and a usable
position, time in seconds.  Floating results are rounded alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import geo, scalar
from wakeline.functions.hexgrid import hex_axial
from wakeline.operators import aggregates, encoder, filters, joins, resample, simplify, tracks, zones
from wakeline.operators.normalise import seconds, usable_position
from wakeline.plans import export, service
from wakeline.plans.graph import graph
from wakeline.plans.shipping import fresh_folder
from wakeline.sources import grids, nmea, places, provider_csv
from wakeline.streaming import receiver

START, END = 1_073_500_000, 1_075_500_000
BOX = {"xmin": -65.0, "xmax": -58.0, "ymin": 44.0, "ymax": 48.0}
CENTRE = (-62.19, 46.65)
FLEET = (299000777, 280091964, 280035917)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pings(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "ais_dynamic")
    return a.where(usable_position(a.mmsi, a.longitude, a.latitude)).select(
        "row_id", "mmsi", seconds(a.time).alias("time"), a.longitude.alias("lon"), a.latitude.alias("lat"), "sog", "cog", "heading", "source"
    )


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return pings(spark, d).withColumn("month", scalar.month_key(F.col("time")))


def static(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "ais_static").where("mmsi is not null and time is not null")
    return s.withColumn("time", seconds(F.col("time"))).withColumn("month", scalar.month_key(F.col("time")))


MODE_COLUMNS = ("vessel_name", "ship_type", "call_sign", "imo", "dim_bow", "destination")


def static_modes(spark, d):
    return aggregates.static_aggregate(static(spark, d), MODE_COLUMNS)


def geom(spark, d):
    return zones.geometry(table(spark, d, "zones"))


def fenced(spark, d):
    return zones.fence(pings(spark, d), geom(spark, d))


PINGS = """pings AS (SELECT row_id, mmsi, CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END AS time,
  longitude AS lon, latitude AS lat, sog, cog, heading, source FROM ais_dynamic
  WHERE mmsi >= 201000000 AND mmsi < 776000000 AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90)"""
MONTH = "strftime(make_timestamp({} * 1000000), '%Y%m')"
STATIC = f"""st0 AS (SELECT * REPLACE (CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END AS time) FROM ais_static WHERE mmsi IS NOT NULL AND time IS NOT NULL),
st AS (SELECT *, {MONTH.format('time')} AS month FROM st0)"""


def hav(x1, y1, x2, y2):
    return (f"(2 * 6371008.8e0 * asin(sqrt(least(1e0, power(sin(radians(({y2}) - ({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians(({x2}) - ({x1})) / 2), 2)))))")


def lagged(track="mmsi"):
    w = f"(PARTITION BY {track} ORDER BY time, row_id)"
    return f"""lagged AS (SELECT *, lag(time) OVER {w} AS pt, lag(lon) OVER {w} AS px, lag(lat) OVER {w} AS py FROM pings),
d AS (SELECT *, time - pt AS ds, CASE WHEN pt IS NOT NULL THEN {hav('px', 'py', 'lon', 'lat')} END AS dm FROM lagged),
k AS (SELECT *, CASE WHEN pt IS NOT NULL THEN dm / greatest(1e0, CAST(ds AS DOUBLE)) * 1.9438445e0 END AS kn FROM d)"""


def modes_sql():
    cells = " UNION ALL ".join(f"SELECT month, mmsi, time, static_id, '{c}' AS c, CAST({'trim(vessel_name)' if c == 'vessel_name' else c} AS VARCHAR) AS v FROM st WHERE mmsi <> 0" for c in MODE_COLUMNS)
    types = {"ship_type": "INTEGER", "imo": "BIGINT", "dim_bow": "INTEGER"}
    wide = ", ".join(f"CAST(max(CASE WHEN c = '{c}' THEN v END) AS {types.get(c, 'VARCHAR')}) AS {c}" for c in MODE_COLUMNS)
    return f"""{STATIC}, cells AS ({cells}),
n AS (SELECT month, mmsi, c, v, count(*) AS n, min({{'time': time, 'static_id': static_id}}) AS o FROM cells WHERE v IS NOT NULL AND v NOT IN ('', '0') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY month, mmsi, c ORDER BY n DESC, o) AS rn FROM n),
modes AS (SELECT k.month, k.mmsi, {', '.join(f'w.{c}' for c in MODE_COLUMNS)} FROM (SELECT DISTINCT month, mmsi FROM st WHERE mmsi <> 0) k
  LEFT JOIN (SELECT month, mmsi, {wide} FROM r WHERE rn = 1 GROUP BY month, mmsi) w ON w.month = k.month AND w.mmsi = k.mmsi)"""


ZONES = """e AS (SELECT zone_name, xs, ys, xs[i] AS ax, ys[i] AS ay, xs[CASE WHEN i = len(xs) THEN 1 ELSE i + 1 END] AS bx, ys[CASE WHEN i = len(xs) THEN 1 ELSE i + 1 END] AS bty
  FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM zones)),
g0 AS (SELECT zone_name AS zone, xs[1] AS x0, ys[1] AS y0, list_min(xs) AS xmin, list_max(xs) AS xmax, list_min(ys) AS ymin, list_max(ys) AS ymax,
  sum((ax - xs[1]) * (bty - ys[1]) - (bx - xs[1]) * (ay - ys[1])) AS a,
  sum((ax + bx - 2 * xs[1]) * ((ax - xs[1]) * (bty - ys[1]) - (bx - xs[1]) * (ay - ys[1]))) AS mx,
  sum((ay + bty - 2 * ys[1]) * ((ax - xs[1]) * (bty - ys[1]) - (bx - xs[1]) * (ay - ys[1]))) AS my FROM e GROUP BY zone_name, xs, ys),
g1 AS (SELECT *, x0 + mx / (3 * a) AS cx, y0 + my / (3 * a) AS cy FROM g0),
geom AS (SELECT g1.*, (SELECT max(""" + hav("g1.cx", "g1.cy", "e.ax", "e.ay") + """) FROM e WHERE e.zone_name = g1.zone) AS maxradius FROM g1)"""
INSIDE = f"""cand AS (SELECT p.row_id, p.lon, p.lat, geom.zone, geom.cx, geom.cy, geom.maxradius FROM pings p JOIN geom ON p.lon BETWEEN geom.xmin AND geom.xmax AND p.lat BETWEEN geom.ymin AND geom.ymax),
inside AS (SELECT cand.row_id, cand.zone, any_value(round({hav('cand.lon', 'cand.lat', 'cand.cx', 'cand.cy')} - cand.maxradius, 3)) AS reach FROM cand JOIN e ON e.zone_name = cand.zone
  WHERE (e.ay > cand.lat) <> (e.bty > cand.lat) AND cand.lon < (e.bx - e.ax) * (cand.lat - e.ay) / (e.bty - e.ay) + e.ax GROUP BY cand.row_id, cand.zone HAVING count(*) % 2 = 1),
best AS (SELECT row_id, zone, row_number() OVER (PARTITION BY row_id ORDER BY reach, zone) AS rn FROM inside),
fenced AS (SELECT p.*, coalesce(b.zone, 'Z0') AS in_zone FROM pings p LEFT JOIN best b ON b.row_id = p.row_id AND b.rn = 1)"""
TRANSITS = """ch AS (SELECT *, CASE WHEN in_zone <> lag(in_zone) OVER w THEN 1 ELSE 0 END AS c FROM fenced WINDOW w AS (PARTITION BY mmsi ORDER BY time, row_id)),
ck AS (SELECT *, CAST(sum(c) OVER (PARTITION BY mmsi ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS kk FROM ch),
cl AS (SELECT *, max(kk) OVER (PARTITION BY mmsi) AS last FROM ck),
tr AS (SELECT *, edge = last AS final FROM (SELECT *, kk AS edge FROM cl UNION ALL SELECT *, kk - 1 AS edge FROM cl WHERE c = 1 AND kk > 1) WHERE edge > 0 OR last = 0)"""

def registrar(queries: dict, texts: dict):
    """A decorator that registers a query under its function's name, with its SQL."""
    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            key = name or f.__name__
            queries[key] = f
            if sql:
                texts[key] = sql
            return f
        return add
    return query


Q: dict = {}
SQL: dict = {}
query = registrar(Q, SQL)


# -- predicates and filters -------------------------------------------------

def _pred(name: str, build, where: str) -> None:
    def run(spark, d):
        return pings(spark, d).where(build()).select("row_id", "mmsi", "time")
    query(f"WITH {PINGS} SELECT row_id, mmsi, time FROM pings WHERE {where}", name)(run)


_T = f"time BETWEEN {START} AND {END}"
_B = f"lon BETWEEN {BOX['xmin']} AND {BOX['xmax']} AND lat BETWEEN {BOX['ymin']} AND {BOX['ymax']}"
_M = "mmsi >= 201000000 AND mmsi < 776000000"
_I = f"mmsi IN ({', '.join(map(str, FLEET))})"
_kw = {**BOX, "lon": "lon", "lat": "lat", "start": START, "end": END, "mmsi": FLEET[0], "mmsis": FLEET}
for _name, _f, _w in (
    ("in_bbox", filters.in_bbox, _B), ("in_timerange", filters.in_timerange, _T), ("has_mmsi", filters.has_mmsi, f"mmsi = {FLEET[0]}"), ("in_mmsi", filters.in_mmsi, _I),
    ("in_bbox_time", filters.in_bbox_time, f"{_B} AND {_T}"), ("in_bbox_time_validmmsi", filters.in_bbox_time_validmmsi, f"{_B} AND {_T} AND {_M}"),
    ("in_time_bbox", filters.in_time_bbox, f"{_B} AND {_T}"), ("in_time_bbox_hasmmsi", filters.in_time_bbox_hasmmsi, f"{_B} AND {_T} AND mmsi = {FLEET[0]}"),
    ("in_time_bbox_inmmsi", filters.in_time_bbox_inmmsi, f"{_B} AND {_T} AND {_I}"), ("in_time_bbox_validmmsi", filters.in_time_bbox_validmmsi, f"{_B} AND {_T} AND {_M}"),
    ("in_time_mmsi", filters.in_time_mmsi, f"{_T} AND {_M}"), ("in_timerange_hasmmsi", filters.in_timerange_hasmmsi, f"{_T} AND mmsi = {FLEET[0]}"),
    ("in_timerange_inmmsi", filters.in_timerange_inmmsi, f"{_T} AND {_I}"), ("in_timerange_validmmsi", filters.in_timerange_validmmsi, f"{_T} AND {_M}"),
    ("in_validmmsi_bbox", filters.in_validmmsi_bbox, f"{_B} AND {_M}"),
):
    _pred(_name, lambda f=_f: f(**_kw), _w)


@query("SELECT row_id, mmsi FROM ais_dynamic WHERE mmsi >= 201000000 AND mmsi < 776000000")
def valid_mmsi(spark, d):
    return table(spark, d, "ais_dynamic").where(filters.valid_mmsi()).select("row_id", "mmsi")


@query("SELECT row_id, source FROM ais_dynamic WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND longitude <> 0 AND latitude <> 0")
def live_positions(spark, d):
    return filters.live_positions(table(spark, d, "ais_dynamic")).select("row_id", "source")


@query(f"WITH {PINGS} SELECT row_id, mmsi FROM pings WHERE {hav('lon', 'lat', CENTRE[0], CENTRE[1])} < 50000")
def mask_in_radius(spark, d):
    return filters.mask_in_radius(pings(spark, d), *CENTRE, 50_000).select("row_id", "mmsi")


@query(f"WITH {PINGS}, {lagged()}, s AS (SELECT *, lead(kn) OVER (PARTITION BY mmsi ORDER BY time, row_id) AS nk FROM k) SELECT row_id FROM s WHERE coalesce(nk, kn) IS NULL OR coalesce(nk, kn) >= 5")
def min_speed_filter(spark, d):
    return filters.min_speed_filter(pings(spark, d), 5).select("row_id")


@query(f"WITH {PINGS} SELECT row_id FROM pings WHERE sog > 1")
def remove_pings_wrt_speed(spark, d):
    return filters.drop_slow(pings(spark, d), 1).select("row_id")


@query("SELECT port_id, port_name FROM ports WHERE cargo_depth IN ('A', 'B', 'C', 'D', 'E', 'F')")
def cargo_depth_isin(spark, d):
    return filters.cargo_depth_in(table(spark, d, "ports")).select("port_id", "port_name")


@query(f"SELECT port_id FROM ports WHERE longitude BETWEEN {BOX['xmin']} AND {BOX['xmax']} AND latitude BETWEEN {BOX['ymin']} AND {BOX['ymax']}")
def ports_in_bbox(spark, d):
    return table(spark, d, "ports").where(places.inside(BOX["xmin"], BOX["ymin"], BOX["xmax"], BOX["ymax"])).select("port_id")


@query(f"WITH {PINGS}, {ZONES}, {INSIDE} SELECT row_id FROM pings WHERE row_id NOT IN (SELECT row_id FROM inside WHERE zone LIKE '%approach' AND row_id NOT IN (SELECT row_id FROM inside WHERE zone LIKE '%inner'))")
def inland_denoising(spark, d):
    g = geom(spark, d)
    return zones.without_land(pings(spark, d), g.where(F.col("zone").endswith("approach")), g.where(F.col("zone").endswith("inner"))).select("row_id")


# -- joins ------------------------------------------------------------------

_MODES = modes_sql()
_DM = f"dm AS (SELECT *, {MONTH.format('time')} AS month FROM pings)"


@query(f"WITH {_MODES} SELECT month, mmsi, {', '.join(MODE_COLUMNS)} FROM modes")
def static_mode_aggregate(spark, d):
    return static_modes(spark, d)


@query(f"WITH {PINGS}, {_MODES}, {_DM} SELECT p.row_id, p.month, p.mmsi, s.vessel_name, s.ship_type FROM dm p LEFT JOIN modes s ON s.month = p.month AND s.mmsi = p.mmsi")
def static_leftjoin(spark, d):
    return joins.with_static(monthly(spark, d), static_modes(spark, d)).select("row_id", "month", "mmsi", "vessel_name", "ship_type")


@query(f"WITH {PINGS}, {_MODES}, {_DM} SELECT p.row_id, s.ship_type, c.coarse_type_txt AS ship_type_txt FROM dm p LEFT JOIN modes s ON s.month = p.month AND s.mmsi = p.mmsi LEFT JOIN coarsetype_ref c ON c.coarse_type = s.ship_type")
def coarsetype_join(spark, d):
    x = joins.with_static(monthly(spark, d), static_modes(spark, d))
    return joins.with_coarse_type(x, table(spark, d, "coarsetype_ref")).select("row_id", "ship_type", "ship_type_txt")


@query(f"""WITH {PINGS}, {_MODES}, {_DM} SELECT p.row_id, s.vessel_name, c.coarse_type_txt AS ship_type_txt, r.name AS reg_name, r.flag AS reg_flag, r.summer_dwt AS reg_summer_dwt
FROM dm p LEFT JOIN modes s ON s.month = p.month AND s.mmsi = p.mmsi LEFT JOIN coarsetype_ref c ON c.coarse_type = s.ship_type LEFT JOIN vessel_registry r ON r.mmsi = p.mmsi""")
def merged_all(spark, d):
    x = joins.with_coarse_type(joins.with_static(monthly(spark, d), static_modes(spark, d)), table(spark, d, "coarsetype_ref"))
    return joins.with_registry(x, table(spark, d, "vessel_registry")).select("row_id", "vessel_name", "ship_type_txt", "reg_name", "reg_flag", "reg_summer_dwt")


@query(f"WITH {PINGS} SELECT mmsi, name, flag, gross_tonnage FROM vessel_registry WHERE error404 <> 1 AND mmsi IN (SELECT mmsi FROM pings)")
def registry_inner(spark, d):
    return joins.registry_of(pings(spark, d), table(spark, d, "vessel_registry")).select("mmsi", "name", "flag", "gross_tonnage")


@query(f"WITH {_MODES} SELECT m.month, m.mmsi, coalesce(r.error404, 1) AS reg_error404, coalesce(r.name, m.vessel_name) AS reg_name, coalesce(r.imo, m.imo, 0) AS reg_imo FROM modes m LEFT JOIN (SELECT * FROM vessel_registry WHERE error404 <> 1) r ON r.mmsi = m.mmsi")
def vessel_info_default(spark, d):
    return joins.vessel_info(static_modes(spark, d), table(spark, d, "vessel_registry")).select("month", "mmsi", "reg_error404", "reg_name", "reg_imo")


@query(f"WITH {PINGS} SELECT DISTINCT mmsi FROM pings WHERE mmsi NOT IN (SELECT mmsi FROM vessel_registry)")
def setdiff_mmsi(spark, d):
    return joins.without(pings(spark, d).select("mmsi").distinct(), table(spark, d, "vessel_registry"), "mmsi")


@query("SELECT batch_id, h FROM (SELECT DISTINCT batch_id, md5(CAST(batch_id AS VARCHAR)) AS h FROM ais_dynamic WHERE batch_id IS NOT NULL) WHERE h NOT IN (SELECT md5(CAST(batch_id AS VARCHAR)) FROM ais_dynamic WHERE batch_id % 3 = 0 AND batch_id IS NOT NULL)")
def checksum_anti(spark, d):
    b = table(spark, d, "ais_dynamic").select("batch_id").where("batch_id is not null").distinct().withColumn("h", F.md5(F.col("batch_id").cast("string")))
    return joins.without(b, b.where("batch_id % 3 = 0"), "h").select("batch_id", "h")


def _grid(spark):
    """A raster made of a rule: value of cell (ix, iy) is (ix * 31 + iy * 17) % 997, one cell a quarter degree."""
    n = spark.range(1440 * 720).select((F.col("id") % 1440).cast("int").alias("ix"), F.floor(F.col("id") / 1440).cast("int").alias("iy"))
    return n.withColumn("value", ((F.col("ix") * 31 + F.col("iy") * 17) % 997).cast("double"))


@query(f"""WITH {PINGS}, c AS (SELECT row_id, CAST(least(greatest(ceil((lon + 180) / 0.25e0), 0), 1439) AS BIGINT) AS ix, CAST(least(greatest(ceil((lat - 90) / -0.25e0), 0), 719) AS BIGINT) AS iy FROM pings)
SELECT row_id, CAST((ix * 31 + iy * 17) % 997 AS DOUBLE) AS km_from_shore FROM c""")
def raster_cell_join(spark, d):
    return grids.with_raster(pings(spark, d), _grid(spark), grids.Axis(-180.0, 0.25, 1440), grids.Axis(90.0, -0.25, 720), "km_from_shore").select("row_id", "km_from_shore")


@query(f"""WITH {PINGS}, t AS (SELECT 'tile_n' || n || '.0_s' || (n - 30) || '.0_w' || w || '.0_e' || (w + 60) || '.0' AS tile, n AS north, n - 30 AS south, w AS west, w + 60 AS east
  FROM (SELECT unnest(generate_series(-60, 90, 30)) AS n) CROSS JOIN (SELECT unnest(generate_series(-180, 120, 60)) AS w))
SELECT p.row_id, min(t.tile) AS tile FROM pings p LEFT JOIN t ON p.lon BETWEEN t.west AND t.east AND p.lat BETWEEN t.south AND t.north GROUP BY p.row_id""")
def bathymetry_tile_range_join(spark, d):
    names = [f"tile_n{n}.0_s{n - 30}.0_w{w}.0_e{w + 60}.0" for n in range(-60, 91, 30) for w in range(-180, 121, 60)]
    tiles = grids.tile_bounds(spark.createDataFrame([(n,) for n in names], "tile string"))
    return joins.tile_lookup(pings(spark, d), tiles).select("row_id", "tile")


@query(f"""WITH {PINGS}, i AS (SELECT row_id, CAST(least(greatest(ceil((lat - 40) / 0.5e0 - 0.5e0), 0), 20) AS BIGINT) AS ilat, CAST(least(greatest(ceil((lon + 70) / 0.5e0 - 0.5e0), 0), 40) AS BIGINT) AS ilon,
  CAST(least(greatest(ceil((time - 1072915200) / 21600e0 - 0.5e0), 0), 240) AS BIGINT) AS itime FROM pings)
SELECT row_id, CAST((ilat * 7 + ilon * 3 + itime) % 29 AS DOUBLE) AS t2m, CAST((ilat * 5 + ilon + itime * 2) % 31 AS DOUBLE) AS u10 FROM i""")
def weather_nearest(spark, d):
    lats, lons, times = [40 + 0.5 * k for k in range(21)], [-70 + 0.5 * k for k in range(41)], [1072915200 + 21600 * k for k in range(241)]
    n = spark.range(21 * 41 * 241).select((F.col("id") % 21).cast("int").alias("ilat"), (F.floor(F.col("id") / 21) % 41).cast("int").alias("ilon"), F.floor(F.col("id") / 861).cast("int").alias("itime"))
    both = F.array(F.struct(F.lit("t2m").alias("short_name"), ((F.col("ilat") * 7 + F.col("ilon") * 3 + F.col("itime")) % 29).cast("double").alias("value")), F.struct(F.lit("u10").alias("short_name"), ((F.col("ilat") * 5 + F.col("ilon") + F.col("itime") * 2) % 31).cast("double").alias("value")))
    cube = n.select("ilat", "ilon", "itime", F.explode(both).alias("v")).select("ilat", "ilon", "itime", "v.*")
    return grids.with_weather(pings(spark, d), cube, ["t2m", "u10"], ["t2m", "u10", "v10"], lats, lons, times).select("row_id", "t2m", "u10")


@query(f"WITH {ZONES} SELECT zone, round(cx, 6) AS cx, round(cy, 6) AS cy, round(maxradius, 1) AS maxradius, xmin, xmax, ymin, ymax FROM geom")
def zone_geometry(spark, d):
    return geom(spark, d).select("zone", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("maxradius", 1).alias("maxradius"), "xmin", "xmax", "ymin", "ymax")


@query("SELECT min(list_min(xs)) AS xmin, max(list_max(xs)) AS xmax, min(list_min(ys)) AS ymin, max(list_max(ys)) AS ymax FROM zones")
def domain_bounds(spark, d):
    return zones.bounds(geom(spark, d))


@query(f"WITH {PINGS}, {ZONES}, {INSIDE} SELECT row_id, in_zone FROM fenced")
def fence_tracks(spark, d):
    return fenced(spark, d).select("row_id", "in_zone")


@query(f"WITH {PINGS}, {ZONES}, {INSIDE} SELECT row_id, zone AS in_zone FROM best WHERE rn = 1")
def point_in_polygon(spark, d):
    return zones.zone_of(pings(spark, d), geom(spark, d))


@query(f"""WITH {PINGS}, {ZONES}, n AS (SELECT p.row_id, g.zone, round({hav('p.lon', 'p.lat', 'g.cx', 'g.cy')} - g.maxradius, 1) AS distance FROM pings p CROSS JOIN geom g),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, zone) AS rn FROM n) SELECT row_id, zone, distance FROM r WHERE rn = 1""")
def nearest_zone_distance(spark, d):
    return zones.nearest_zone(pings(spark, d), geom(spark, d))


# -- aggregates, sets, limits -----------------------------------------------

@query(f'WITH {PINGS} SELECT min(time) AS start, max(time) AS "end" FROM pings')
def valid_range(spark, d):
    return aggregates.valid_range(pings(spark, d))


@query(f"WITH {PINGS}, {_DM} SELECT CAST(strptime(min(month) || '01', '%Y%m%d') AS DATE) AS first_day, last_day(CAST(strptime(max(month) || '01', '%Y%m%d') AS DATE)) AS last_day FROM dm")
def date_range(spark, d):
    return aggregates.date_range(monthly(spark, d))


@query(f"WITH {PINGS} SELECT DISTINCT mmsi FROM pings")
def distinct_vessels(spark, d):
    return pings(spark, d).select("mmsi").distinct()


@query(f"WITH {PINGS}, {_DM} SELECT month, count(*) AS pings, count(DISTINCT mmsi) AS vessels FROM dm GROUP BY month")
def pings_per_month(spark, d):
    return aggregates.pings_per_month(monthly(spark, d))


@query(f"WITH {PINGS} SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY mmsi, time, source ORDER BY row_id) AS rn FROM pings) WHERE rn = 1")
def dedup_dynamic(spark, d):
    return aggregates.keep_first(pings(spark, d), ("mmsi", "time", "source"), ("row_id",)).select("row_id")


@query(f"WITH {PINGS} SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY mmsi, time, lon, lat, sog, cog, source ORDER BY row_id) AS rn FROM pings WHERE sog IS NOT NULL AND cog IS NOT NULL) WHERE rn = 1")
def dedup_first_wins(spark, d):
    p = pings(spark, d).where("sog is not null and cog is not null")
    return aggregates.keep_first(p, ("mmsi", "time", "lon", "lat", "sog", "cog", "source"), ("row_id",)).select("row_id")


@query(f"WITH {PINGS} SELECT source, count(*) AS messages, max(time) - min(time) AS span_s, round(count(*) / greatest(max(time) - min(time), 1), 6) AS per_second FROM pings GROUP BY source")
def message_rate(spark, d):
    return aggregates.message_rate(pings(spark, d))


@query(f"WITH {PINGS} SELECT CAST(floor(lon / 0.5e0) AS INTEGER) AS cx, CAST(floor(lat / 0.5e0) AS INTEGER) AS cy, count(*) AS pings FROM pings GROUP BY 1, 2")
def heatmap(spark, d):
    return aggregates.heat_grid(pings(spark, d))


@query(f"WITH {PINGS}, {_DM} SELECT mmsi, time, lon, lat FROM dm WHERE month = '200401' UNION SELECT mmsi, time, lon, lat FROM dm WHERE month = '200402'")
def union_months(spark, d):
    return monthly(spark, d).where(F.col("month").isin("200401", "200402")).select("mmsi", "time", "lon", "lat").distinct()


@query(f"WITH {PINGS} SELECT mmsi, time, row_id FROM pings ORDER BY mmsi, time, row_id LIMIT 500")
def limit_ordered(spark, d):
    return pings(spark, d).select("mmsi", "time", "row_id").orderBy("mmsi", "time", "row_id").limit(500)


# -- windows ----------------------------------------------------------------

@query(f"WITH {PINGS}, {lagged()} SELECT row_id, ds AS delta_seconds, round(dm, 2) AS delta_meters, round(kn, 3) AS delta_knots FROM k")
def deltas(spark, d):
    return tracks.deltas(pings(spark, d)).select("row_id", "delta_seconds", F.round("delta_meters", 2).alias("delta_meters"), F.round("delta_knots", 3).alias("delta_knots"))


def _islands_sql(flag: str, name: str) -> str:
    return f"WITH {PINGS}, {lagged()} SELECT row_id, CAST(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS {name} FROM k"


@query(_islands_sql("abs(lon - px) > 300", "lon_seg"))
def segment_longitude(spark, d):
    return tracks.split_longitude(pings(spark, d)).select("row_id", "lon_seg")


@query(_islands_sql("ds >= 21600", "idx"))
def split_timedelta(spark, d):
    return tracks.split_timedelta(pings(spark, d), 21_600).select("row_id", "idx")


@query(_islands_sql("kn > 50 OR dm > 200000", "seg"))
def encoder_breaks(spark, d):
    return encoder.segments(pings(spark, d), 200_000, 50).select("row_id", "seg")


@query(f"""WITH {PINGS}, {lagged()}, s AS (SELECT *, greatest(dm, 1e0) / greatest(CAST(ds AS DOUBLE), 10e0) * 1.9438444924406e0 AS pace FROM k)
SELECT row_id, CASE WHEN pt IS NULL THEN NULL WHEN pace < 50 AND greatest(dm, 1e0) < 400000 THEN round(200000e0 / pace, 2) ELSE -1e0 END AS score FROM s""")
def encoder_score(spark, d):
    w = tracks.along()
    s = encoder.score(F.lag("lon").over(w), F.lag("lat").over(w), F.lag("time").over(w), F.col("lon"), F.col("lat"), F.col("time"), 50, 200_000)
    return pings(spark, d).withColumn("score", F.round(s, 2)).select("row_id", "score")


@query(f"""WITH {PINGS}, b AS (SELECT *, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY time, row_id)),
c AS (SELECT *, CASE WHEN nx IS NOT NULL THEN degrees(atan2(sin(radians(nx - lon)) * cos(radians(ny)), cos(radians(lat)) * sin(radians(ny)) - sin(radians(lat)) * cos(radians(ny)) * cos(radians(nx - lon)))) END AS a0,
  CAST(trunc(cog) AS INTEGER) % 360 AS cg FROM b),
e AS (SELECT *, CASE WHEN a0 < 0 THEN a0 + 360 ELSE a0 END AS a FROM c),
f AS (SELECT *, lag(a) OVER w AS pa, lag(cg) OVER w AS pc, lag(time) OVER w AS pt, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM e WINDOW w AS (PARTITION BY mmsi ORDER BY time, row_id)),
g AS (SELECT *, CASE WHEN pt IS NOT NULL AND (time - pt >= 86400 OR coalesce(sog <= 50 AND sog < 0.2e0, false) OR coalesce(least(abs(cg - pc), 360 - abs(cg - pc)) >= 45, false)
  OR coalesce(least(abs(a - pa), 360 - abs(a - pa)) >= 45, false) OR {hav('px', 'py', 'lon', 'lat')} >= 25000) THEN 1 ELSE 0 END AS cut FROM f),
h AS (SELECT *, sum(cut) OVER (PARTITION BY mmsi ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS s0 FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY mmsi, s0) AS n FROM h)
SELECT row_id, CAST(dense_rank() OVER (PARTITION BY mmsi ORDER BY s0) - 1 AS INTEGER) AS seg FROM n WHERE n >= 15""")
def split_tracks(spark, d):
    return tracks.split_tracks(pings(spark, d)).select("row_id", "seg")


@query(f"WITH {PINGS}, {lagged()} SELECT mmsi, count(*) AS pings, min(time) AS first_time, max(time) AS last_time, round(coalesce(sum(dm), 0), 1) AS meters, round(avg(kn), 3) AS avg_knots FROM k GROUP BY mmsi")
def track_summary(spark, d):
    return tracks.summary(pings(spark, d))


@query(f"WITH {PINGS} SELECT row_id, round(sqrt(power({hav('lon', 'lat', CENTRE[0], CENTRE[1])}, 2) + power(CAST(row_id % 4000 AS DOUBLE), 2)), 2) AS metres FROM pings")
def distance_3d(spark, d):
    p = pings(spark, d).withColumn("depth", (F.col("row_id") % 4000).cast("double"))
    return tracks.distance_3d(p, *CENTRE, "depth", "metres").select("row_id", F.round("metres", 2).alias("metres"))


@query(f"WITH {PINGS}, {ZONES}, {INSIDE}, {TRANSITS} SELECT row_id, edge, final FROM tr")
def zone_transits(spark, d):
    return zones.transits(fenced(spark, d)).select("row_id", "edge", "final")


@query(f"""WITH {PINGS}, {ZONES}, {INSIDE}, {TRANSITS},
l AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py, lag(time) OVER w AS pt FROM tr WINDOW w AS (PARTITION BY mmsi, edge ORDER BY time, row_id)),
v AS (SELECT *, CASE WHEN pt IS NOT NULL THEN {hav('px', 'py', 'lon', 'lat')} END AS dm FROM l),
x AS (SELECT *, CASE WHEN pt IS NOT NULL THEN dm / greatest(1e0, CAST(time - pt AS DOUBLE)) * 1.9438445e0 END AS kn FROM v),
a AS (SELECT mmsi, edge, bool_or(final) AS final, first(in_zone ORDER BY time, row_id) AS src, last(in_zone ORDER BY time, row_id) AS rcv, min(time) AS first_time, max(time) AS last_time, count(*) AS pings,
  CAST(trunc(coalesce(sum(dm), 0)) AS INTEGER) AS cumulative_distance_meters, round(min(kn), 2) AS velocity_knots_min, round(avg(kn), 2) AS velocity_knots_avg, round(max(kn), 2) AS velocity_knots_max FROM x GROUP BY mmsi, edge)
SELECT mmsi, edge, src AS src_zone, CASE WHEN NOT final THEN rcv END AS rcv_zone, first_time, last_time, pings, cumulative_distance_meters, velocity_knots_min, velocity_knots_avg, velocity_knots_max,
  CASE WHEN pings > 1 THEN round((last_time - first_time) / 60e0, 2) END AS minutes_spent_in_zone FROM a""")
def transit_edges(spark, d):
    e = zones.edge_statistics(zones.transits(fenced(spark, d)))
    two = [F.round(c, 2).alias(c) for c in ("velocity_knots_min", "velocity_knots_avg", "velocity_knots_max", "minutes_spent_in_zone")]
    return e.select("mmsi", "edge", F.col("src_name").alias("src_zone"), F.col("rcv_name").alias("rcv_zone"), "first_time", "last_time", "pings", "cumulative_distance_meters", *two)


@query(f"""WITH {PINGS}, {ZONES}, {INSIDE}, {TRANSITS} SELECT mmsi, edge, count(*) FILTER ((row_id % 600) / 10e0 BETWEEN 0.01 AND 5) AS minutes_within_10m_5km_shoredist,
  count(*) FILTER ((row_id % 600) / 10e0 BETWEEN 0.03 AND 20) AS minutes_within_30m_20km_shoredist, count(*) FILTER ((row_id % 600) / 10e0 BETWEEN 0.1 AND 50) AS minutes_within_100m_50km_shoredist,
  round(avg((row_id % 600) / 10e0), 4) AS avg_shore_dist, round(max(greatest(CAST(row_id % 300 - 50 AS DOUBLE), 0)), 2) AS max_depth FROM tr GROUP BY mmsi, edge""")
def edge_enrichment(spark, d):
    p = fenced(spark, d).withColumn("km_from_shore", (F.col("row_id") % 600) / 10.0).withColumn("depth_metres", (F.col("row_id") % 300 - 50).cast("double"))
    e = zones.edge_statistics(zones.transits(p))
    return e.select("mmsi", "edge", "minutes_within_10m_5km_shoredist", "minutes_within_30m_20km_shoredist", "minutes_within_100m_50km_shoredist", F.round("avg_shore_dist", 4).alias("avg_shore_dist"), F.round("max_depth", 2).alias("max_depth"))


# -- resampling -------------------------------------------------------------

_ONE = "one AS (SELECT mmsi, time, arg_min(lon, row_id) AS lon, arg_min(lat, row_id) AS lat, arg_min({{'v': sog}}, row_id).v AS sog FROM pings GROUP BY mmsi, time)".replace("{{", "{").replace("}}", "}")
_MX, _MY = "6378137e0 * radians({})", "6378137e0 * ln(tan(pi() / 4 + radians({}) / 2))"
_ILON, _ILAT = "degrees(({}) / 6378137e0)", "degrees(2 * atan(exp(({}) / 6378137e0)) - pi() / 2)"
# Mercator ends near the poles: resampling leaves out positions beyond 85 degrees, on both sides alike
_NEAR = "pings0 AS (SELECT * FROM pings WHERE abs(lat) < 85)"


def _sailed(spark, d):
    return pings(spark, d).where(F.abs("lat") < 85)


@query(f"""WITH {PINGS}, {_NEAR}, {_ONE.replace('FROM pings ', 'FROM pings0 ')},
m AS (SELECT *, {_MX.format('lon')} AS x, {_MY.format('lat')} AS y, min(time) OVER (PARTITION BY mmsi) AS t0, max(time) OVER (PARTITION BY mmsi) AS tn FROM one),
l AS (SELECT *, lead(time) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(sog) OVER w AS ns FROM m WINDOW w AS (PARTITION BY mmsi ORDER BY time)),
g AS (SELECT mmsi, t0, tn, t0 + unnest(generate_series(0, CAST(ceil((tn - t0) / 1800e0) AS BIGINT))) * 1800 AS gt FROM (SELECT DISTINCT mmsi, t0, tn FROM m) WHERE tn > t0),
j AS (SELECT g.mmsi, g.gt, l.*, CASE WHEN l.nt IS NOT NULL THEN (g.gt - l.time) / CAST(l.nt - l.time AS DOUBLE) END AS f FROM g JOIN l ON l.mmsi = g.mmsi AND g.gt >= l.time AND (g.gt < l.nt OR l.nt IS NULL))
SELECT mmsi, gt AS time, round({_ILON.format('CASE WHEN f IS NULL THEN x ELSE x + (nx - x) * f END')}, 6) AS lon, round({_ILAT.format('CASE WHEN f IS NULL THEN y ELSE y + (ny - y) * f END')}, 6) AS lat,
  round(CASE WHEN f IS NULL THEN sog ELSE sog + (ns - sog) * f END, 4) AS sog FROM j""")
def interp_time(spark, d):
    x = resample.interp_time(_sailed(spark, d), 1800)
    return x.select("mmsi", "time", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("sog", 4).alias("sog"))


@query(f"""WITH {PINGS}, {_NEAR}, {_ONE.replace('FROM pings ', 'FROM pings0 ')}, m AS (SELECT *, {_MX.format('lon')} AS x, {_MY.format('lat')} AS y FROM one),
l AS (SELECT *, lead(time) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM m WINDOW w AS (PARTITION BY mmsi ORDER BY time)),
s AS (SELECT *, coalesce(sqrt(power(nx - x, 2) + power(ny - y, 2)), 0) AS leg FROM l),
r AS (SELECT *, sum(leg) OVER (PARTITION BY mmsi ORDER BY time ROWS UNBOUNDED PRECEDING) AS b, sum(leg) OVER (PARTITION BY mmsi) AS total FROM s),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY mmsi ORDER BY time), 0) AS a FROM r),
w AS (SELECT *, unnest(CASE WHEN nt IS NULL THEN [total] ELSE [k * 50000e0 FOR k IN generate_series(CAST(ceil(a / 50000e0) AS BIGINT), CAST(ceil(b / 50000e0) AS BIGINT) - 1)] END) AS way FROM q WHERE total > 50000),
f AS (SELECT *, CASE WHEN nt IS NULL THEN 0 ELSE (way - a) / leg END AS f FROM w)
SELECT mmsi, round(way, 1) AS way, round(CASE WHEN nt IS NULL THEN time ELSE time + (nt - time) * f END, 1) AS time, round({_ILON.format('CASE WHEN nt IS NULL THEN x ELSE x + (nx - x) * f END')}, 6) AS lon,
  round({_ILAT.format('CASE WHEN nt IS NULL THEN y ELSE y + (ny - y) * f END')}, 6) AS lat FROM f""")
def interp_spacing(spark, d):
    x = resample.interp_spacing(_sailed(spark, d), 50_000)
    return x.select("mmsi", F.round("way", 1).alias("way"), F.round("time", 1).alias("time"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query()
def geo_interp_azimuth(spark, d):
    return resample.geo_interp_time(_sailed(spark, d), 1800).select("mmsi", "time", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("cog", 3).alias("cog"))


@query()
def cubic_spline(spark, d):
    p = tracks.split_timedelta(_sailed(spark, d), 86_400)
    return resample.interp_cubic_spline(p, 1800, ("sog",), ("mmsi", "idx")).select("mmsi", "idx", "time", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query()
def vw_decimate(spark, d):
    return simplify.simplify(tracks.split_timedelta(pings(spark, d), 86_400), 1e-4, ("mmsi", "idx")).select("row_id", "mmsi", "idx")


@query()
def encode_pathways(spark, d):
    return encoder.encode(pings(spark, d)).select("row_id", "mmsi", "label")


@query()
def graph_edges(spark, d):
    p = pings(spark, d).where(F.abs("lat") < 85)
    e = graph(p, geom(spark, d), table(spark, d, "vessel_registry"), drop=[F.col("velocity_knots_max") > 500])
    return export.edge_rows(e.select("mmsi", "idx", "label", "edge", "src_zone", "rcv_zone", "transit_nodes", "first_seen_in_zone", "last_seen_in_zone", "total_distance_meters", "cumulative_distance_meters", "velocity_knots_max", "minutes_spent_in_zone"))


# -- scalars ----------------------------------------------------------------

@query("SELECT row_id, CASE WHEN abs(w) = 180 THEN -w ELSE w END AS shifted FROM (SELECT row_id, CASE WHEN abs(x) <> 180 THEN (((x + 180) % 360) + 360) % 360 - 180 ELSE x END AS w FROM (SELECT row_id, CAST(row_id % 1441 - 720 AS DOUBLE) / 2 AS x FROM ais_dynamic))")
def shiftcoord(spark, d):
    x = (F.col("row_id") % 1441 - 720).cast("double") / 2
    return table(spark, d, "ais_dynamic").select("row_id", geo.shift_coordinate(x).alias("shifted"))


@query("SELECT port_id, round(longitude - degrees(10000 / (6371088e0 * cos(radians(latitude)))), 8) AS xmin, round(longitude + degrees(10000 / (6371088e0 * cos(radians(latitude)))), 8) AS xmax, round(latitude - degrees(10000 / 6371088e0), 8) AS ymin, round(latitude + degrees(10000 / 6371088e0), 8) AS ymax FROM ports")
def radial_box(spark, d):
    b = geo.radial_box(F.col("longitude"), F.col("latitude"), 10_000)
    return table(spark, d, "ports").select("port_id", *[F.round(v, 8).alias(k) for k, v in b.items()])


@query(f"WITH {PINGS} SELECT row_id, round({_MX.format('lon')}, 2) + 0 AS x, round({_MY.format('lat')}, 2) + 0 AS y, round({_ILAT.format(_MY.format('lat'))}, 6) + 0 AS back FROM pings WHERE abs(lat) < 85")
def mercator_roundtrip(spark, d):
    p = pings(spark, d).where(F.abs("lat") < 85)
    flat = {"x": F.round(geo.mercator_x(F.col("lon")), 2), "y": F.round(geo.mercator_y(F.col("lat")), 2), "back": F.round(geo.mercator_lat(geo.mercator_y(F.col("lat"))), 6)}
    return p.select("row_id", *[(c + F.lit(0.0)).alias(n) for n, c in flat.items()])  # no negative zeros


@query("""SELECT static_id, round(CASE WHEN t < 30 THEN 0e0 WHEN t = 30 THEN 15.58e0 * power(w, 0.602e0) WHEN t BETWEEN 52 AND 53 THEN 19.36e0 * power(w, 0.553e0) WHEN t BETWEEN 60 AND 69 THEN 14.64e0 * power(w, 0.671e0)
  WHEN t BETWEEN 70 AND 79 THEN 14.24e0 * power(w, 0.596e0) WHEN t = 84 THEN 5.41e0 * power(w, 0.699e0) WHEN t BETWEEN 80 AND 89 THEN 9.56e0 * power(w, 0.63e0) ELSE 26.2e0 * power(w, 0.551e0) END, 3) AS hull
FROM (SELECT s.static_id, coalesce(s.ship_type, 0) AS t, CAST(coalesce(r.summer_dwt, 0) AS DOUBLE) AS w FROM ais_static s LEFT JOIN vessel_registry r ON r.mmsi = s.mmsi)""")
def wetted_surface(spark, d):
    s = joins.with_registry(table(spark, d, "ais_static"), table(spark, d, "vessel_registry"))
    return s.select("static_id", F.round(scalar.wetted_surface(F.col("reg_summer_dwt"), F.col("ship_type")), 3).alias("hull"))


@query("SELECT static_id, CASE WHEN vessel_name IS NULL OR vessel_name = '-' THEN '' ELSE translate(vessel_name, ',' || chr(130) || '#\"''' || chr(10), '') END AS clean FROM ais_static")
def sanitize(spark, d):
    return table(spark, d, "ais_static").select("static_id", scalar.sanitize(F.col("vessel_name")).alias("clean"))


@query("SELECT DISTINCT source, TRY_CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) AS number FROM ais_dynamic")
def zone_number(spark, d):
    return table(spark, d, "ais_dynamic").select("source", scalar.zone_number(F.col("source")).alias("number")).distinct()


@query(f"WITH {PINGS} SELECT row_id, CAST(CASE WHEN lon <= -66 THEN 0 WHEN lon <= -63.5 THEN 1 WHEN lon <= -61 THEN 2 WHEN lon <= -57 THEN 3 ELSE 4 END AS INTEGER) AS i FROM pings")
def binary_search(spark, d):
    return pings(spark, d).select("row_id", scalar.first_at_least([-66, -63.5, -61, -57, 0], F.col("lon")).alias("i"))


@query(f"WITH {PINGS} SELECT row_id, round(lon * 10000) / 10000 AS lon4, {MONTH.format('time')} AS month FROM pings")
def round_floats(spark, d):
    return pings(spark, d).select("row_id", scalar.round_floats(F.col("lon")).alias("lon4"), scalar.month_key(F.col("time")).alias("month"))


@query(f"""WITH {PINGS}, a AS (SELECT row_id, ({_MX.format('lon')} * 0.5773502691896257e0 - {_MY.format('lat')} / 3) / 5000e0 AS q, {_MY.format('lat')} * (2e0 / 3) / 5000e0 AS r FROM pings WHERE abs(lat) < 85),
b AS (SELECT *, -q - r AS s, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM b)
SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r, count(*) AS pings FROM c GROUP BY 1, 2""")
def hex_cells(spark, d):
    q, r = hex_axial(F.col("lon"), F.col("lat"), 5000.0)
    return pings(spark, d).where(F.abs("lat") < 85).groupBy(q.cast("long").alias("q"), r.cast("long").alias("r")).agg(F.count(F.lit(1)).alias("pings"))


@query("""SELECT CAST(c AS INTEGER) AS coarse_type, CASE WHEN c = 100 THEN 'Unknown'
  WHEN c BETWEEN 30 AND 39 THEN ['Fishing', 'Towing', 'Towing - length >200m or breadth >25m', 'Dredger', 'Dive Vessel', 'Military Ops', 'Sailing Vessel', 'Pleasure Craft', 'Reserved for future use', 'Reserved for future use'][c - 29]
  WHEN c BETWEEN 50 AND 59 THEN ['Pilot vessel', 'SAR', 'Tug', 'Port Tender', 'Anti-Pollution', 'Law Enforce', 'Spare - local vessels', 'Spare - local vessels', 'Medical Trans)', 'Ships and aircraft of States not parties to an armed conflict'][c - 49]
  ELSE ['Wing In Grnd', '', 'High speed craft', '', 'Passenger', 'Cargo', 'Tanker', 'Other'][c // 10 - 1] || CASE WHEN c % 10 BETWEEN 1 AND 4 THEN ', hazardous category ' || 'ABCD'[c % 10] ELSE '' END END AS coarse_type_txt
  FROM (SELECT unnest(generate_series(20, 100)) AS c)""")
def coarse_types(spark, d):
    return spark.createDataFrame(scalar.coarse_types(), "coarse_type int, coarse_type_txt string")


# -- export and service -----------------------------------------------------

@query(f"""WITH {PINGS} SELECT CAST(dense_rank() OVER (ORDER BY mmsi) AS VARCHAR) AS "Track_ID", CAST(mmsi AS VARCHAR) AS mmsi, strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S') AS datetime, CAST(time AS VARCHAR) AS time,
  CAST(CAST(CAST(CAST(lon AS VARCHAR) AS DECIMAL(18, 8)) AS DECIMAL(18, 5)) AS VARCHAR) AS lon, CAST(CAST(CAST(CAST(lat AS VARCHAR) AS DECIMAL(18, 8)) AS DECIMAL(18, 5)) AS VARCHAR) AS lat, translate(source, ',#', '') AS source, CAST(row_id AS VARCHAR) AS row_id FROM pings""")
def csv_rows(spark, d):
    return export.csv_rows(pings(spark, d).select("row_id", "mmsi", "time", "lon", "lat", "source"))


_R4 = "round({} * 10000) / 10000"


@query(f"""WITH {PINGS} SELECT mmsi, list({_R4.format('lon')} ORDER BY time, row_id) AS x, list({_R4.format('lat')} ORDER BY time, row_id) AS y, list(time ORDER BY time, row_id) AS t FROM pings GROUP BY mmsi""")
def track_json(spark, d):
    m = export.track_json(pings(spark, d))
    v = F.from_json("message", "msgtype string, meta struct<mmsi: bigint>, x array<double>, y array<double>, t array<bigint>")
    return m.select(v.alias("v")).where("v.msgtype = 'track_vector'").select("v.meta.mmsi", "v.x", "v.y", "v.t")


@query(f"""WITH {PINGS}, g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY mmsi ORDER BY time, row_id) >= 86400 THEN 1 ELSE 0 END AS b FROM pings),
k AS (SELECT *, CAST(sum(b) OVER (PARTITION BY mmsi ORDER BY time, row_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS idx FROM g)
SELECT mmsi, idx, 'LineString' AS kind, list(lon ORDER BY time, row_id) AS lon, list(lat ORDER BY time, row_id) AS lat FROM k GROUP BY mmsi, idx""")
def track_geojson(spark, d):
    f = export.geojson(tracks.split_timedelta(pings(spark, d), 86_400), ("mmsi", "idx"))
    v = F.from_json("feature", "geometry struct<type: string, coordinates: array<array<double>>>, properties struct<mmsi: bigint, idx: int>").alias("v")
    at = lambda k: F.transform("v.geometry.coordinates", lambda c: c[k])
    return f.select(v).select("v.properties.mmsi", "v.properties.idx", F.col("v.geometry.type").alias("kind"), at(0).alias("lon"), at(1).alias("lat"))


@query()
def track_vectors(spark, d):
    r = {"msgtype": "track_vectors", "start": START, "end": END, "area": {"x0": BOX["xmin"], "x1": BOX["xmax"], "y0": BOX["ymin"], "y1": BOX["ymax"]}}
    return service.answer(r, pings(spark, d))


@query(f"""WITH {PINGS} SELECT '{{"msgtype":"validrange","start":' || min(time) || ',"end":' || max(time) || '}}' AS message FROM pings""")
def service_validrange(spark, d):
    return service.answer({"msgtype": "validrange"}, pings(spark, d))


# -- raw sources, from lines made in the query ------------------------------

@query(r"""SELECT * FROM (VALUES (1635883083::BIGINT, '144fiV0P00WT:`8POChN4?v4281b'), (1726841314::BIGINT, '15MgK45P3@G?fl0E`JbR0OwT0@MS')) t("time", payload)""")
def nm4_headers(spark, d):
    lines = [
        r"\s:43479,c:1635883083,t:1635883172*6C\!AIVDM,1,1,,,144fiV0P00WT:`8POChN4?v4281b,0*64", r"\c:1726841314345,s:my-station,T:x*23\!AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*4E",
        r"\s:1,c:,t:1*00\!AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*4E", r"\s:1,c:-5*00\!AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*4E", r"\s:1,c:1635883083*00\!AIVDM,1,1,,A,;5,0*4E",
    ]
    x = spark.createDataFrame([(v, "f", n) for n, v in enumerate(lines)], "line string, file string, n long")
    return nmea.parsed(x, now=1_800_000_000).select("time", "payload")


@query(r"""SELECT * FROM (VALUES (1325394060::BIGINT, '15MgK45P3@G?fl0E`JbR0OwT0@MS'), (0::BIGINT, '15MgK45P3@G?fl0E`JbR0OwT0@MS')) t("time", payload)""")
def nmea_epoch(spark, d):
    lines = ["!AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*28,d-109,S2105,t050056.00,T56.13,r003669946,1325394060,1325394001", "!AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*28", "AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*28"]
    x = spark.createDataFrame([(v, "f", n) for n, v in enumerate(lines)], "line string, file string, n long")
    return nmea.parsed(x).select("time", "payload")


@query("SELECT 366730000::BIGINT AS mmsi, 1325394060::BIGINT AS time, -122.392533e0 AS longitude, 37.803803e0 AS latitude, 20.8e0 AS sog, 51.3e0 AS cog, 0e0 AS heading")
def ais_decode(spark, d):
    x = spark.createDataFrame([("!AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*4E,r0,1325394060", "f", 0)], "line string, file string, n long")
    r = nmea.dynamic_rows(nmea.reassembled(nmea.parsed(x)), "test")
    return r.select("mmsi", "time", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), "sog", "cog", "heading")


@query("SELECT 316000001::BIGINT AS mmsi, 1609459261::BIGINT AS time, CAST(-63.5 AS DOUBLE) AS longitude, CAST(44.25 AS DOUBLE) AS latitude, CAST(7.5 AS DOUBLE) AS sog")
def spire_csv(spark, d):
    row = [""] * 132
    for k, v in {"mmsi": "316000001", "msg_type": "1", "time": "20210101_000101", "sog": "7.5", "longitude": "-63.5", "latitude": "44.25", "cog": "None"}.items():
        row[provider_csv.SPIRE[k]] = v
    bad = list(row)
    bad[provider_csv.SPIRE["time"]] = "never"
    x = spark.createDataFrame([(",".join(f'"{v}"' for v in r), "f", n) for n, r in enumerate((row, bad))], "line string, file string, n long")
    rows = x.select("file", "n", provider_csv.cells(F.col("line")).alias("c"))
    return provider_csv.spire(rows, "spire")[0].select("mmsi", "time", "longitude", "latitude", "sog")


@query("SELECT 338000001::BIGINT AS mmsi, 1672531261::BIGINT AS time, 'SEA, STAR' AS vessel_name, 9000001::BIGINT AS imo")
def noaa_csv(spark, d):
    lines = ['338000001,2023-01-01T00:01:01,30.5,-88.25,1.5,10.0,511,"SEA, STAR",9000001,WX1,70,0,20,5,2.5,70,A', "338000001,2023-01-01T00:02:01,30.5,-88.25,1.5,10.0,511,OTHER,9000001,WX1,70,0,20,5,2.5,70,A", "x,2023-01-01T00:02:01,1,1", "338000002,bad,1,1"]
    x = spark.createDataFrame([(v, "f", n) for n, v in enumerate(lines)], "line string, file string, n long")
    rows = x.select("file", "n", provider_csv.cells(F.col("line")).alias("c"))
    return provider_csv.noaa(rows, "noaa_x")[1].select("mmsi", "time", "vessel_name", "imo")


# -- streams: drained file sources, compared with the batch result ----------

def _stream(spark, d: str, build, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over the reports to its end and read what it wrote (in the shared folder of the session)."""
    out = fresh_folder(spark, f"stream_{name}")
    batch = table(spark, d, "ais_dynamic")
    # the reader of streams takes folders and patterns, and tables may be either a file or a folder
    src = spark.readStream.schema(batch.schema).parquet(f"{d}/ais_dynamic.parque[t]")
    a = src.where(usable_position(src.mmsi, src.longitude, src.latitude)).select(
        "row_id", "mmsi", seconds(src.time).alias("time"), src.longitude.alias("longitude"), src.latitude.alias("latitude"), "sog", "cog", "source"
    )
    df = build(a)

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("append" if mode == "append" else "overwrite").parquet(f"{out}/rows")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query(f"WITH {PINGS} SELECT DISTINCT mmsi, time, source FROM pings")
def stream_dedup(spark, d):
    return _stream(spark, d, lambda a: receiver.distinct_positions(a, "400 days", ("mmsi", "time", "source")), "dedup").select("mmsi", "time", "source")


@query(f"WITH {PINGS} SELECT make_timestamp(CAST(floor(time / 3600) AS BIGINT) * 3600000000) AS hour, source, count(*) AS pings FROM pings GROUP BY 1, 2")
def stream_hourly(spark, d):
    return _stream(spark, d, lambda a: receiver.hourly_counts(a, "400 days"), "hourly", "complete").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "source", "pings")


@query(f"""WITH {PINGS}, l AS (SELECT mmsi, time, lag(time) OVER (PARTITION BY mmsi ORDER BY time, row_id) AS pt FROM pings),
s AS (SELECT mmsi, time, sum(CASE WHEN time - pt > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY time ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT mmsi, min(time) AS first_time, max(time) AS last_time, count(*) AS pings FROM s GROUP BY mmsi, k""")
def stream_sessions(spark, d):
    return _stream(spark, d, lambda a: receiver.session_tracks(a, "1 day", "400 days"), "sessions", "complete")


@query(f"WITH {PINGS} SELECT row_id, CAST(coalesce(sog, -1) AS DOUBLE) AS sog FROM pings WHERE lon <> 0 AND lat <> 0")
def stream_live_json(spark, d):
    def build(a):
        x = filters.live_positions(a).withColumn("heading", F.lit(None).cast("double")).withColumn("rot", F.lit(None).cast("double"))
        return receiver.as_json(x)
    v = F.from_json("value", "row_id bigint, sog double")
    return _stream(spark, d, build, "json").select(v.alias("v")).select("v.row_id", "v.sog")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)
