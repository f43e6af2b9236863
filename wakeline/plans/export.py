"""Results as CSV and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.scalar import round_floats, sanitize
from wakeline.operators.tracks import MOST_PINGS, parts

# Order of the columns of a track file; decimals of some.
ORDER = (
    "Track_ID", "mmsi", "imo", "label", "datetime", "time", "lon", "lat", "cog", "sog", "depth_metres", "km_from_shore", "km_from_port", "km_from_coast", "vessel_name",
    "ship_type", "ship_type_txt", "call_sign", "dim_bow", "dim_stern", "dim_port", "dim_star", "submerged_hull_m^2", "destination", "source",
)
DECIMALS = {"lon": 5, "lat": 5, "depth_metres": 2, "km_from_shore": 2, "km_from_port": 2, "km_from_coast": 2, "submerged_hull_m^2": 0}
STATIC_ZERO = ("imo", "ship_type", "dim_bow", "dim_stern", "dim_port", "dim_star")


def csv_rows(df: DataFrame, track: Sequence[str] = ("mmsi",), skip: Sequence[str] = ("label", "in_zone")) -> DataFrame:
    """Rows of text as they stand in a track file, with datetime and Track_ID (1-based, by track).

    Tracks are numbered over their distinct keys - few rows - and the numbers joined
    back, so no window runs over all pings in one task.
    """
    from pyspark.sql import Window

    keys = df.select(*track).distinct()
    keys = keys.withColumn("Track_ID", F.row_number().over(Window.orderBy(*track)))
    x = df.join(keys, list(track)).withColumn("datetime", F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd HH:mm:ss"))
    names = [c for c in ORDER if c in x.columns and c not in skip] + sorted(c for c in x.columns if c not in ORDER and c not in skip)

    def text(c: str) -> Column:
        if c in DECIMALS:
            return F.coalesce(F.format_string(f"%.{DECIMALS[c]}f", F.col(c).cast("double")), F.lit(""))
        v = F.col(c).cast("string")
        return sanitize(F.when(F.col(c) == 0, "").otherwise(v) if c in STATIC_ZERO else v)

    return x.select(*[text(c).alias(c) for c in names])


def write_csv(df: DataFrame, path: str, single: bool = False, compression: str = "none", **kw) -> None:
    """Track files; ``compression`` is that of the writer (gzip, ...)."""
    rows = csv_rows(df, **kw)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_csv_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append plain rows; trailing blanks, commas and number signs go."""
    clean = rows.select(*[F.rtrim(F.translate(F.col(c).cast("string"), ",#", "")).alias(c) for c in rows.columns])
    clean.write.mode(mode).csv(path)


EDGE_TWO = ("velocity_knots_min", "velocity_knots_avg", "velocity_knots_max", "minutes_spent_in_zone", "min_shore_dist", "avg_shore_dist", "max_shore_dist", "min_port_dist", "avg_port_dist", "max_port_dist", "min_depth", "avg_depth", "max_depth")


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges as text: two decimals, NULL where there is nothing."""
    null = F.lit("NULL")
    return edges.select(*[F.coalesce(F.format_string("%.2f", F.col(c).cast("double")) if c in EDGE_TWO else F.col(c).cast("string"), null).alias(c) for c in edges.columns])


def write_edges(edges: DataFrame, path: str) -> None:
    """Graph CSV in order of the nine-digit mmsi; a range-partitioned sort, written in order."""
    out = edge_rows(edges)
    out.orderBy(F.lpad("mmsi", 9, "0"), F.col("edge").cast("int")).write.mode("overwrite").option("header", True).csv(path)


def track_json(df: DataFrame, track: Sequence[str] = ("mmsi",), meta: Sequence[str] = (), precision: float | None = 1e-4, most: int = MOST_PINGS) -> DataFrame:
    """One JSON message per track: msgtype, key, x, y, t and meta; a track of more than ``most`` pings in numbered parts."""
    lon, lat = (round_floats(F.col(c), precision) if precision else F.col(c) for c in ("lon", "lat"))
    p = F.array_sort(F.collect_list(F.struct("time", "row_id", lon.alias("x"), lat.alias("y"))))
    g = parts(df, track, most).groupBy(*track, "part").agg(p.alias("p"), *[F.min_by(c, F.struct("time", "row_id")).cast("string").alias(c) for c in meta])
    m = F.to_json(F.struct(F.lit("track_vector").alias("msgtype"), F.struct(*track, *meta).alias("meta"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.time").alias("t")))
    return g.select(*track, "part", m.alias("message"))


def geojson(df: DataFrame, track: Sequence[str] = ("mmsi",), most: int = MOST_PINGS) -> DataFrame:
    """One GeoJSON line per track, or part of one."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("time", "row_id", "lon", "lat"))), lambda q: F.array(q["lon"], q["lat"]))
    g = parts(df, track, most).groupBy(*track, "part").agg(p.alias("p"))
    line = F.struct(F.lit("LineString").alias("type"), F.col("p").alias("coordinates"))
    return g.select(*track, "part", F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct(*track).alias("properties"))).alias("feature"))


def zone_json(geom: DataFrame) -> DataFrame:
    return geom.select("zone", F.to_json(F.struct(F.lit("zone").alias("msgtype"), F.struct(F.col("zone").alias("name")).alias("meta"), F.col("xs").alias("x"), F.col("ys").alias("y"))).alias("message"))
