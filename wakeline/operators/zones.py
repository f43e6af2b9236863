"""Zones: their geometry, which zone a ping is in, and the transits between zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.scalar import zone_number
from wakeline.operators.tracks import numbered, placed

OUTSIDE = "Z0"


def _edges(n: Column) -> Column:
    return F.sequence(F.lit(1), n)


def _next(i: Column, n: Column) -> Column:
    return F.when(i == n, 1).otherwise(i + 1).cast("int")


def geometry(zones: DataFrame, name: str = "zone_name") -> DataFrame:
    """Box, area-weighted centroid and largest distance from it to a vertex, of rings given as xs, ys."""
    n = F.size("xs")
    x0, y0 = F.element_at("xs", 1), F.element_at("ys", 1)  # sums relative to a vertex keep their digits

    def cross(i: Column) -> Column:
        j = _next(i, n)
        return (F.element_at("xs", i) - x0) * (F.element_at("ys", j) - y0) - (F.element_at("xs", j) - x0) * (F.element_at("ys", i) - y0)

    def moment(i: Column, v: str, o: Column) -> Column:
        return (F.element_at(v, i) - o + F.element_at(v, _next(i, n)) - o) * cross(i)

    total = lambda f: F.aggregate(_edges(n), F.lit(0.0), lambda acc, i: acc + f(i.cast("int")))
    z = zones.withColumn("_a", total(cross))
    z = z.withColumn("cx", F.when(F.col("_a") != 0, x0 + total(lambda i: moment(i, "xs", x0)) / (3 * F.col("_a"))).otherwise(F.aggregate("xs", F.lit(0.0), lambda a, v: a + v) / n))
    z = z.withColumn("cy", F.when(F.col("_a") != 0, y0 + total(lambda i: moment(i, "ys", y0)) / (3 * F.col("_a"))).otherwise(F.aggregate("ys", F.lit(0.0), lambda a, v: a + v) / n))
    far = F.array_max(F.transform(_edges(n), lambda i: geo.haversine(F.col("cx"), F.col("cy"), F.element_at("xs", i.cast("int")), F.element_at("ys", i.cast("int")))))
    return z.withColumn("maxradius", far).select(
        F.col(name).alias("zone"), "xs", "ys", "cx", "cy", "maxradius",
        F.array_min("xs").alias("xmin"), F.array_max("xs").alias("xmax"), F.array_min("ys").alias("ymin"), F.array_max("ys").alias("ymax"),
    )


def require_in_range(geom: DataFrame) -> None:
    """Zones must lie between -180 and 180; those beyond are named."""
    bad = [r.zone for r in geom.where("xmin < -180 or xmax > 180 or ymin < -90 or ymax > 90").select("zone").limit(5).collect()]
    if bad:
        raise ValueError(f"zones out of range, split them at the antimeridian: {bad}")


def split_box(xmin: float, xmax: float) -> list[tuple[float, float]]:
    """Parts of a longitude span within [-180, 180]."""
    if xmin < -180:
        return [(xmin + 360, 180.0), (-180.0, xmax)]
    if xmax > 180:
        return [(xmin, 180.0), (-180.0, xmax - 360)]
    return [(xmin, xmax)]


def exploded(multi: DataFrame, name: str = "zone_name") -> DataFrame:
    """Multipolygons (``rings``: array of struct<xs, ys>) as zones name_0, name_1, ..."""
    return multi.select(name, F.posexplode("rings").alias("i", "r")).select(F.concat_ws("_", name, F.col("i").cast("string")).alias(name), "r.xs", "r.ys")


def boxes_around(points: DataFrame, radius: str = "radius", name: str = "name") -> DataFrame:
    """Square zones around points (lon, lat) by radius in metres."""
    b = geo.radial_box(F.col("lon"), F.col("lat"), F.col(radius).cast("double"))
    return points.select(
        F.col(name).alias("zone_name"), F.array(b["xmin"], b["xmin"], b["xmax"], b["xmax"]).alias("xs"), F.array(b["ymin"], b["ymax"], b["ymax"], b["ymin"]).alias("ys")
    )


def bounds(geom: DataFrame) -> DataFrame:
    """Box of the whole domain."""
    return geom.agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))


def in_zone(points: DataFrame, geom: DataFrame, name: str, cell: float = 1.0) -> DataFrame:
    """Points with ``name``, the zone they are in, null outside all; of several the one whose rim is nearest to its centroid's reach.

    Zones are laid out on grid cells, and each cell with zones holds their list; points
    meet it by equality of cells and are tested where they are, so they need not move
    if the cells are few enough to be broadcast.
    """
    spans = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int"))
    z = geom.select("*", F.explode(spans("xmin", "xmax")).alias("_cx")).select("*", F.explode(spans("ymin", "ymax")).alias("_cy"))
    lists = z.groupBy("_cx", "_cy").agg(F.collect_list(F.struct("zone", "cx", "cy", "maxradius", "xmin", "xmax", "ymin", "ymax", "xs", "ys")).alias("_zones"))
    lon, lat = F.col("lon"), F.col("lat")
    holds = lambda z: lon.between(z["xmin"], z["xmax"]) & lat.between(z["ymin"], z["ymax"]) & geo.in_polygon(lon, lat, z["xs"], z["ys"])
    reach = lambda z: F.struct(F.round(geo.haversine(lon, lat, z["cx"], z["cy"]) - z["maxradius"], 3).alias("reach"), z["zone"].alias("zone"))
    x = points.withColumn("_cx", F.floor(lon / cell).cast("int")).withColumn("_cy", F.floor(lat / cell).cast("int")).join(lists, ["_cx", "_cy"], "left")
    found = F.when(F.col("_zones").isNotNull(), F.array_min(F.transform(F.filter("_zones", holds), reach))["zone"])
    return x.withColumn(name, found).drop("_cx", "_cy", "_zones")


def zone_of(points: DataFrame, geom: DataFrame, cell: float = 1.0) -> DataFrame:
    """(row_id, in_zone) of points inside a zone."""
    return in_zone(points.select("row_id", "lon", "lat"), geom, "in_zone", cell).where("in_zone is not null").select("row_id", "in_zone")


def fence(points: DataFrame, geom: DataFrame, cell: float = 1.0) -> DataFrame:
    """``in_zone`` of every ping, Z0 outside all zones; a column that is already there stays."""
    if "in_zone" in points.columns:
        return points
    return in_zone(points, geom, "in_zone", cell).withColumn("in_zone", F.coalesce("in_zone", F.lit(OUTSIDE)))


CELL_RADIUS_M = 79_000.0  # no point of a one-degree cell lies farther from its middle


def _reach(lon: Column, lat: Column, z: Column) -> Column:
    return geo.haversine(lon, lat, z["cx"], z["cy"]) - z["r"]


def _zone_list(geom: DataFrame, most: int) -> Column:
    rows = geom.select("zone", "cx", "cy", "maxradius").orderBy("zone").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many zones to look at from one place")
    return F.array(*[F.struct(F.lit(r.zone).alias("zone"), F.lit(r.cx).alias("cx"), F.lit(r.cy).alias("cy"), F.lit(r.maxradius).alias("r")) for r in rows])


def nearest_zone(points: DataFrame, geom: DataFrame, most: int = 10_000) -> DataFrame:
    """(row_id, zone, distance): the zone with the least distance to its centroid less its radius; the zone list is size-checked.

    Each one-degree cell with points keeps the zones that may be nearest somewhere in
    it - from its middle no more than two cell radii behind the best - and points look
    at those alone.
    """
    p = points.select("row_id", "lon", "lat", F.floor("lon").cast("int").alias("_cx"), F.floor("lat").cast("int").alias("_cy"))
    seen = F.transform(_zone_list(geom, most), lambda z: F.struct(_reach(F.col("_cx") + 0.5, F.col("_cy") + 0.5, z).alias("d"), z.alias("z")))
    cells = p.select("_cx", "_cy").distinct().withColumn("_seen", seen).withColumn("_least", F.array_min(F.transform("_seen", lambda s: s["d"])))
    cells = cells.select("_cx", "_cy", F.transform(F.filter("_seen", lambda s: s["d"] <= F.col("_least") + 2 * CELL_RADIUS_M), lambda s: s["z"]).alias("_zones"))
    each = F.transform("_zones", lambda z: F.struct(F.round(_reach(F.col("lon"), F.col("lat"), z), 1).alias("distance"), z["zone"].alias("zone")))
    return p.join(cells, ["_cx", "_cy"]).select("row_id", F.array_min(each).alias("n")).select("row_id", "n.zone", "n.distance")


def zone_distances(points: DataFrame, geom: DataFrame, most: int = 10_000) -> DataFrame:
    """(row_id, zone, distance) of a few places and every zone of a list of checked size."""
    each = F.transform(_zone_list(geom, most), lambda z: F.struct(z["zone"].alias("zone"), F.round(_reach(F.col("lon"), F.col("lat"), z), 1).alias("distance")))
    return points.select("row_id", F.explode(each).alias("n")).select("row_id", "n.zone", "n.distance")


def from_vertices(vertices: DataFrame, name: str | None = None, epsg: int = 4326) -> DataFrame:
    """Zones (zone_name, xs, ys) from vertices (zone, seq, x, y), in degrees or Web Mercator metres (EPSG 3857).

    ``name`` is the column that names a zone; without it zones are zone_0, zone_1 ... in order of ``zone``.
    """
    if epsg not in (4326, 3857):
        raise ValueError("coordinates are EPSG 4326 or 3857")
    x, y = (F.col("x"), F.col("y")) if epsg == 4326 else (geo.mercator_lon(F.col("x")), geo.mercator_lat(F.col("y")))
    rings = vertices.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("seq", x.alias("x"), y.alias("y")))).alias("p"), *([F.first(name).alias("_name")] if name else []))
    label = F.col("_name") if name else F.concat(F.lit("zone_"), (F.row_number().over(Window.orderBy("zone")) - 1).cast("string"))  # few rows: one a zone
    return rings.select(label.alias("zone_name"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))


def without_land(points: DataFrame, land: DataFrame, water: DataFrame) -> DataFrame:
    """Pings but those inside land and not inside water."""
    x = in_zone(in_zone(points, land, "_land"), water, "_water")
    return x.where("_land is null or _water is not null").drop("_land", "_water")


def transits(fenced: DataFrame, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Pings with ``edge``: stretches from one change of zone to the next.

    A ping where the zone changes ends one edge and begins the next.  Pings before
    the first change belong to no edge if there is a change at all; the last edge
    (``final``) runs to the end of the track.  ``_was`` is the ping before in the edge.
    """
    moved = lambda here, was: here("in_zone") != was("in_zone")
    x = numbered(placed(fenced, track), ("lon", "lat", "time", "in_zone"), moved, "_k", track, total="_last", was="_was", broken="_c").drop("_day")
    edge = F.explode(F.when(F.col("_c") & (F.col("_k") > 1), F.array(F.col("_k") - 1, F.col("_k"))).otherwise(F.array("_k")))
    x = x.withColumn("edge", edge).where((F.col("edge") > 0) | (F.col("_last") == 0))
    opens = F.col("_c") & (F.col("edge") == F.col("_k"))
    x = x.withColumn("_was", F.when(~opens, F.col("_was"))).withColumn("final", F.col("edge") == F.col("_last"))
    return x.drop("_c", "_k", "_last")


def edge_statistics(pings: DataFrame, track: Sequence[str] = ("mmsi",), static: Sequence[str] = ()) -> DataFrame:
    """One row per edge of ``transits``: zones, times, ways, speeds and - where the columns are - depth, shore and port distances.

    Numbers are plain numbers (the CSV writer formats them); speeds and minutes of
    an edge with one ping are null, as is rcv_zone of the last edge.  src_name and
    rcv_name are the zones' names.  Edges of any length are summed map-side.
    """
    key = [*track, "edge"]
    d = geo.haversine(F.col("_was.lon"), F.col("_was.lat"), F.col("lon"), F.col("lat"))
    x = pings.withColumn("_d", d).withColumn("_kn", geo.knots(F.col("_d"), F.col("time") - F.col("_was.time")))
    at = F.struct("time", "row_id")
    end = lambda f, c: f(c, at)
    more = []
    if "km_from_shore" in pings.columns:
        s = F.col("km_from_shore")
        more += [f(s).alias(f"{n}_shore_dist") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
        # Distances from shore in km within which time is counted, one minute a ping.
        more += [F.count_if(s.between(a, b)).alias(f"minutes_within_{n}_shoredist") for n, a, b in (("10m_5km", 0.01, 5), ("30m_20km", 0.03, 20), ("100m_50km", 0.1, 50))]
    if "km_from_port" in pings.columns:
        more += [f("km_from_port").alias(f"{n}_port_dist") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    if "depth_metres" in pings.columns:
        deep = F.greatest(F.col("depth_metres"), F.lit(0.0))
        more += [f(deep).alias(f"{n}_depth") for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    g = x.groupBy(*key).agg(
        end(F.min_by, "in_zone").alias("_src"), end(F.max_by, "in_zone").alias("_rcv"), F.max("final").alias("final"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count(F.lit(1)).alias("pings"),
        end(F.min_by, "lon").alias("_x0"), end(F.min_by, "lat").alias("_y0"), end(F.max_by, "lon").alias("_x1"), end(F.max_by, "lat").alias("_y1"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).cast("long").alias("cumulative_distance_meters"),  # the way of a long edge is beyond an int
        F.min("_kn").alias("velocity_knots_min"), F.avg("_kn").alias("velocity_knots_avg"), F.max("_kn").alias("velocity_knots_max"),
        *more, *[F.min_by(c, at).alias(c) for c in static],
    )
    first = F.timestamp_seconds("first_time")
    seen = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm 'UTC'")
    src, rcv = zone_number(F.col("_src")), zone_number(F.col("_rcv"))
    return g.select(
        *key, *static, src.alias("src_zone"), F.when(~F.col("final"), rcv).alias("rcv_zone"), F.col("_src").alias("src_name"), F.when(~F.col("final"), F.col("_rcv")).alias("rcv_name"),
        F.when(F.col("final"), src.cast("string")).otherwise(F.concat_ws("_", "_src", "_rcv")).alias("transit_nodes"),
        "first_time", "last_time", seen("first_time").alias("first_seen_in_zone"), seen("last_time").alias("last_seen_in_zone"),
        F.year(first).alias("year"), F.month(first).alias("month"), F.dayofmonth(first).alias("day"), "pings",
        geo.haversine(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1")).cast("int").alias("total_distance_meters"), "cumulative_distance_meters",
        "velocity_knots_min", "velocity_knots_avg", "velocity_knots_max",
        F.when(F.col("pings") > 1, (F.col("last_time") - F.col("first_time")) / 60).alias("minutes_spent_in_zone"),
        *[c for c in g.columns if c.endswith(("_dist", "_depth", "_shoredist"))],
    )
