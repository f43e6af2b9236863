"""Provider CSV files, read by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.nmea import DYNAMIC_TYPES, STATIC_TYPES, eta, without_nulls

# Positions of the columns in the two layouts.
SPIRE = {
    "mmsi": 0, "msg_type": 1, "time": 3, "vessel_name": 13, "call_sign": 14, "imo": 15, "ship_type": 16, "dim_bow": 17, "dim_stern": 18, "dim_port": 19, "dim_star": 20,
    "draught": 21, "destination": 22, "ais_version": 23, "rot": 25, "sog": 26, "longitude": 28, "latitude": 29, "cog": 30, "heading": 31, "utc_second": 42,
    "eta_month": 45, "eta_day": 46, "eta_hour": 47, "eta_minute": 48,
}
NOAA = {"mmsi": 0, "time": 1, "latitude": 2, "longitude": 3, "sog": 4, "cog": 5, "heading": 6, "vessel_name": 7, "imo": 8, "call_sign": 9, "ship_type": 10, "draught": 14}


def read_rows(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Data lines with their cells (``c``: array), file and order.

    Lines are split at commas outside double quotes; the header (no digit first) is dropped.
    """
    x = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    return x.where(F.col("line").rlike(r'^"?\s*[0-9]')).select("file", "n", cells(F.col("line")).alias("c"))


def cells(line: Column) -> Column:
    """Cells of a line; commas and spaces inside double quotes belong to their cell, the quotes go.

    Every second piece between quotes is inside: its commas and spaces are put out of
    the way before the line is cut, so a line is gone through a fixed number of times.
    """
    inside = F.transform(F.split(line, '"'), lambda piece, i: F.when(i % 2 == 1, F.translate(piece, ", ", "\u0001\u0002")).otherwise(piece))
    return F.transform(F.split(F.array_join(inside, ""), ","), lambda v: F.translate(F.trim(v), "\u0001\u0002", ", "))


def cell(layout: dict[str, int], name: str) -> Column:
    """A cell by name; empty and None are null."""
    v = F.get("c", F.lit(layout[name])) if name in layout else F.lit(None).cast("string")
    return F.when((v != "") & (v != "None"), v)


def whole(v: Column, kind: str) -> Column:
    """Digits only: '25.0' is no whole number here."""
    return F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast(kind))


def spire_time(v: Column) -> Column:
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(v, F.lit("yyyyMMdd_HHmmss")), F.try_to_timestamp(v, F.lit("yyyyMMdd'T'HHmmss'Z'"))))


def noaa_time(v: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(v, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def _dynamic(rows: DataFrame, layout: dict[str, int], time: Column, source: str) -> DataFrame:
    real = lambda n: cell(layout, n).try_cast("double").alias(n)
    return rows.select(
        whole(cell(layout, "mmsi"), "bigint").alias("mmsi"), time.cast("bigint").alias("time"), real("longitude"), real("latitude"), real("rot"), real("sog"), real("cog"), real("heading"),
        F.lit(False).alias("maneuver"), whole(cell(layout, "utc_second"), "int").alias("utc_second"), F.lit(source).alias("source"),
    )


def _static(rows: DataFrame, layout: dict[str, int], time: Column, source: str) -> DataFrame:
    num = lambda n: whole(cell(layout, n), "int").alias(n)
    e = eta(*[F.floor(cell(layout, n).try_cast("double")).cast("int") for n in ("eta_month", "eta_day", "eta_hour", "eta_minute")])
    return rows.select(
        whole(cell(layout, "mmsi"), "bigint").alias("mmsi"), time.cast("bigint").alias("time"), cell(layout, "vessel_name").alias("vessel_name"), num("ship_type"), cell(layout, "call_sign").alias("call_sign"),
        whole(cell(layout, "imo"), "bigint").alias("imo"), num("dim_bow"), num("dim_stern"), num("dim_port"), num("dim_star"), num("draught"), cell(layout, "destination").alias("destination"), num("ais_version"),
        F.lit(None).cast("string").alias("fixing_device"), *[c.alias(n) for n, c in zip(("eta_month", "eta_day", "eta_hour", "eta_minute"), e)], F.lit(source).alias("source"),
    )


def spire(rows: DataFrame, source: str, keep_nulls: bool = False, keep_bad_times: bool = False) -> tuple[DataFrame, DataFrame]:
    """(dynamic, static) rows by message type; rows without a readable time are dropped, or get time 0."""
    kind = cell(SPIRE, "msg_type").try_cast("int")
    t = spire_time(cell(SPIRE, "time"))
    t = F.coalesce(t, F.lit(0)) if keep_bad_times else t
    d = _dynamic(rows.where(kind.isin(*DYNAMIC_TYPES)), SPIRE, t, source).where("mmsi is not null and time is not null")
    s = _static(rows.where(kind.isin(*STATIC_TYPES)), SPIRE, t, source).where("mmsi is not null and time is not null")
    return (d, s) if keep_nulls else (without_nulls(d), without_nulls(s))


def noaa(rows: DataFrame, source: str, keep_nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """(dynamic, static) rows: every row is a position, the first of each vessel in a file also an identity report."""
    t = noaa_time(cell(NOAA, "time"))
    good = rows.withColumn("_m", whole(cell(NOAA, "mmsi"), "bigint")).where(F.col("_m").isNotNull() & t.isNotNull())
    d = _dynamic(good, NOAA, t, source).withColumn("utc_second", F.lit(0))
    firsts = good.groupBy("file", "_m").agg(F.min_by("c", "n").alias("c"))
    s = _static(firsts, NOAA, t, source)
    return (d, s) if keep_nulls else (without_nulls(d), without_nulls(s))
