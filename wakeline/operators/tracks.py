"""Track operators: a track is the rows of one key in order of time.

Rows are placed by (track, UTC day), so no task holds a track as a whole, whatever
share of all rows it has.  What crosses midnight goes by way of one small row per
track and day: the neighbour of a day's first or last ping, and the sums of the
days before.  Segmenting operators add integer columns and leave mmsi alone.
Rows with a null key or time have no neighbours beyond their own day.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.scalar import seconds_of

ORDER = ("time", "row_id")
DAY = 86_400


def along(track: Sequence[str] = ("mmsi",), order: Sequence[str] = ORDER):
    return Window.partitionBy(*track).orderBy(*order)


def running(w):
    """Rows up to the current one; the default range frame would merge rows of one second."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def placed(df: DataFrame, track: Sequence[str] = ("mmsi",), whole: bool = False) -> DataFrame:
    """Rows with ``_day``, placed by (track, day): one exchange that all the steps below share.

    ``whole`` leaves out rows with a null key or time - before the exchange, so that
    no later join adds that condition to one of its readers only and parts them.
    """
    x = df.withColumn("_day", F.floor(F.col("time") / DAY).cast("long"))
    for c in (*track, "_day") if whole else ():
        x = x.where(F.col(c).isNotNull())
    return x.repartition(*track, "_day")


def neighbours(x: DataFrame, columns: Sequence[str], track: Sequence[str] = ("mmsi",), before: str | None = None, after: str | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """``before`` and ``after``: structs of columns of the rows next to each of placed rows; null at a track's ends."""
    keys, at, me = [*track, "_day"], F.struct(*order), F.struct(*columns)
    w, line = along(keys, order), Window.partitionBy(*track).orderBy("_day")
    sides = [(n, look, pick) for n, look, pick in ((before, F.lag, F.max_by), (after, F.lead, F.min_by)) if n]
    ends = x.groupBy(*keys).agg(*[pick(me, at).alias(f"_{n}") for n, _, pick in sides])
    ends = ends.select(*keys, *[look(f"_{n}").over(line).alias(f"_{n}") for n, look, _ in sides])
    for n, look, _ in sides:
        x = x.withColumn(n, look(me).over(w))
    x = x.join(ends, keys, "left")
    for n, _, _ in sides:
        x = x.withColumn(n, F.coalesce(n, f"_{n}")).drop(f"_{n}")
    return x


def cumulated(x: DataFrame, value: str, name: str, track: Sequence[str] = ("mmsi",), total: str | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """``name``: sum of a column of placed rows along each track up to each row; ``total``: of the whole track."""
    keys = [*track, "_day"]
    line = Window.partitionBy(*track).orderBy("_day")
    days = x.groupBy(*keys).agg(F.sum(value).alias("_s"))
    days = days.withColumn("_o", F.sum("_s").over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_s").over(Window.partitionBy(*track))).drop("_s")
    kind = x.schema[value].dataType
    x = x.withColumn(name, F.sum(value).over(running(along(keys, order)))).join(days, keys, "left")
    x = x.withColumn(name, (F.col(name) + F.coalesce("_o", F.lit(0))).cast(kind))
    if total:
        x = x.withColumn(total, F.coalesce("_all", F.lit(0)).cast(kind))
    return x.drop("_o", "_all")


Break = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def numbered(x: DataFrame, columns: Sequence[str], breaks: Break, name: str, track: Sequence[str] = ("mmsi",), total: str | None = None, was: str | None = None, broken: str | None = None) -> DataFrame:
    """Number the runs of placed rows between breaks, from 0.

    ``breaks(here, was)`` says from ``columns`` of a row and of the one before whether
    there is a break between; null is none.  Breaks inside a day are summed along the
    day; one row a day tells of the break at its start and the sum of the days before.
    ``total``: number of the track's breaks; ``was``: struct of the row before;
    ``broken``: whether a break lies before the row.
    """
    keys, at, me = [*track, "_day"], F.struct(*ORDER), F.struct(*columns)
    w, line = along(keys), Window.partitionBy(*track).orderBy("_day")
    yes = lambda here, before: F.when(F.col(before).isNotNull(), F.coalesce(breaks(lambda c: F.col(f"{here}{c}"), lambda c: F.col(f"{before}.{c}")).cast("int"), F.lit(0))).otherwise(0)
    x = x.withColumn("_in", F.lag(me).over(w)).withColumn("_b", yes("", "_in")).withColumn(name, F.sum("_b").over(running(w)))
    days = x.groupBy(*keys).agg(F.min_by(me, at).alias("_first"), F.max_by(me, at).alias("_last"), F.sum("_b").alias("_s"))
    days = days.withColumn("_carry", F.lag("_last").over(line)).withColumn("_b0", yes("_first.", "_carry")).withColumn("_s", F.col("_s") + F.col("_b0"))
    before = F.coalesce(F.sum("_s").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_b0")
    days = days.select(*keys, "_carry", "_b0", before.alias("_o"), F.sum("_s").over(Window.partitionBy(*track)).alias("_all"))
    x = x.join(days, keys, "left").withColumn(name, (F.col(name) + F.coalesce("_o", F.lit(0))).cast("int"))
    if total:
        x = x.withColumn(total, F.coalesce("_all", F.lit(0)).cast("int"))
    if was:
        x = x.withColumn(was, F.coalesce("_in", "_carry"))
    if broken:
        x = x.withColumn(broken, F.when(F.col("_in").isNull(), F.coalesce("_b0", F.lit(0))).otherwise(F.col("_b")) == 1)
    return x.drop("_in", "_b", "_b0", "_o", "_all", "_carry")


def deltas(df: DataFrame, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """delta_seconds, delta_meters and delta_knots from the ping before; null on the first."""
    return with_deltas(placed(df, track), track).drop("_day")


def with_deltas(x: DataFrame, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    x = neighbours(x, ("lon", "lat", "time"), track, before="_was")
    d = geo.haversine(F.col("_was.lon"), F.col("_was.lat"), F.col("lon"), F.col("lat"))
    x = x.withColumn("delta_seconds", F.col("time") - F.col("_was.time")).withColumn("delta_meters", d)
    return x.withColumn("delta_knots", geo.knots(F.col("delta_meters"), F.col("delta_seconds"))).drop("_was")


def split_longitude(df: DataFrame, tolerance: float = 300.0, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """lon_seg: cut where the longitude leaps over the antimeridian."""
    return numbered(placed(df, track), ("lon",), lambda here, was: F.abs(here("lon") - was("lon")) > tolerance, "lon_seg", track).drop("_day")


def split_timedelta(df: DataFrame, maxdelta: timedelta | int = timedelta(weeks=2), track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """idx: cut where the time between pings reaches ``maxdelta``; numbered per mmsi."""
    x = numbered(placed(df, track), ("time",), lambda here, was: here("time") - was("time") >= seconds_of(maxdelta), "_seg", track).drop("_day")
    if tuple(track) == ("mmsi",):
        return x.withColumnRenamed("_seg", "idx")
    # segments are numbered as such; their rows get the numbers by a join
    names = [*track, "_seg"]
    w = Window.partitionBy("mmsi").orderBy(*[c for c in track if c != "mmsi"], "_seg")
    ranks = x.select(*names).distinct().withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    return x.join(ranks, names).drop("_seg")


def split_tracks(
    df: DataFrame,
    max_distance: float = 25_000,
    max_time: timedelta | int = timedelta(hours=24),
    max_speed: float = 50,
    min_speed: float = 0.2,
    min_segment_length: int = 15,
    min_direction_change: float = 45,
    track: Sequence[str] = ("mmsi",),
    ellipsoid: bool = False,
) -> DataFrame:
    """seg: numbers of the kept segments; pings of shorter ones are dropped.

    Cuts lie where a time gap or a leg reaches its bound, where the reported course
    turns (whole degrees), at the ping around which the track's own course turns, and
    at slow pings (sog < min_speed, among those not above max_speed).  Legs are
    measured with longitude and latitude in their places.  Courses between pings are
    bearings on the sphere, or with ``ellipsoid`` WGS84 azimuths (an Arrow step).
    """
    x = neighbours(placed(df, track), ("lon", "lat", "time", "cog", "sog"), track, before="_was", after="_then")
    leg = geo.geodesic_azimuth if ellipsoid else geo.bearing
    was, then, here = ([F.col(f"{p}lon"), F.col(f"{p}lat")] for p in ("_was.", "_then.", ""))
    into, out = F.pmod(leg(*was, *here), F.lit(360.0)), F.pmod(leg(*here, *then), F.lit(360.0))
    whole = lambda c: F.pmod(F.col(c).cast("int"), F.lit(360))
    cut = (
        F.coalesce(F.col("time") - F.col("_was.time") >= seconds_of(max_time), F.lit(False))
        | F.coalesce((F.col("sog") <= max_speed) & (F.col("sog") < min_speed), F.lit(False))
        | F.coalesce(geo.angle_between(whole("cog"), whole("_was.cog")) >= min_direction_change, F.lit(False))
        | F.coalesce(geo.angle_between(out, into) >= min_direction_change, F.lit(False))
        | F.coalesce(geo.haversine(*was, *here) >= max_distance, F.lit(False))
    )
    # the first ping opens a segment anyway; runs are numbered within the day, and the few runs tell which segment each is
    x = x.withColumn("_b", (cut & F.col("_was.time").isNotNull()).cast("int")).drop("_was", "_then")
    x = x.withColumn("_r", F.sum("_b").over(running(along([*track, "_day"]))).cast("int")).drop("_b")
    days = Window.partitionBy(*track).orderBy("_day", "_r")
    parts = x.groupBy(*track, "_day", "_r").count()
    # run 0 of a day goes on with the segment before it
    parts = parts.withColumn("_seg", F.sum((F.col("_r") > 0).cast("int")).over(running(days)))
    parts = parts.withColumn("_n", F.sum("count").over(Window.partitionBy(*track, "_seg"))).where(F.col("_n") >= min_segment_length)
    parts = parts.withColumn("seg", (F.dense_rank().over(Window.partitionBy(*track).orderBy("_seg")) - 1).cast("int"))
    names = [*track, "_day", "_r"]
    return x.join(parts.select(*names, "seg"), names).drop("_day", "_r")


def runs(df: DataFrame, value: str, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Maximal runs of one value along each track: track columns, the value, first_time, last_time, pings; null is a value."""
    change = lambda here, was: ~here(value).eqNullSafe(was(value))
    return numbered(placed(df, track), (value,), change, "_run", track).groupBy(*track, "_run").agg(
        F.first(value).alias(value), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count(F.lit(1)).alias("pings")
    ).drop("_run")


def track_id(seg: str = "seg") -> Column:
    """The segment's name on export: mmsi-k."""
    return F.concat_ws("-", F.col("mmsi").cast("string"), F.col(seg).cast("string"))


def distance_3d(df: DataFrame, lon: float, lat: float, depth: str, name: str) -> DataFrame:
    """Distance of every ping to a point, over the surface and down."""
    return df.withColumn(name, geo.distance_3d(F.col("lon"), F.col("lat"), F.lit(float(lon)), F.lit(float(lat)), F.col(depth).cast("double")))


MOST_PINGS = 1_000_000  # of a track in one row


def parts(df: DataFrame, track: Sequence[str] = ("mmsi",), most: int = MOST_PINGS) -> DataFrame:
    """Rows with ``part``: tracks cut after every ``most`` pings, so that no row made of a part is unbounded."""
    x = cumulated(placed(df, track).withColumn("_one", F.lit(1).cast("long")), "_one", "_k", track)
    return x.withColumn("part", F.floor((F.col("_k") - 1) / most).cast("int")).drop("_one", "_k", "_day")


def vectorised(df: DataFrame, track: Sequence[str] = ("mmsi",), static: Sequence[str] = (), vectors: Sequence[str] = ("lon", "lat", "sog", "cog"), most: int = MOST_PINGS) -> DataFrame:
    """One row per track: static columns of its first ping, and arrays in order of time.

    For export and inspection; analysis stays in long form.  A track of more than
    ``most`` pings is cut into numbered parts.
    """
    rows = F.array_sort(F.collect_list(F.struct("time", "row_id", *vectors)))
    g = parts(df, track, most).groupBy(*track, "part").agg(*[F.min_by(c, F.struct("time", "row_id")).alias(c) for c in static], rows.alias("_p"))
    return g.select(*track, "part", *static, F.col("_p.time").alias("time"), *[F.col(f"_p.{v}").alias(v) for v in vectors])


def summary(df: DataFrame, track: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Pings, first and last time, way and mean speed of each track."""
    return deltas(df, track).groupBy(*track).agg(
        F.count(F.lit(1)).alias("pings"), F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        F.round(F.coalesce(F.sum("delta_meters"), F.lit(0.0)), 1).alias("meters"), F.round(F.avg("delta_knots"), 3).alias("avg_knots"),
    )
