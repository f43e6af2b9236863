"""Aggregations over stored reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.schema import AGGREGATED


def static_aggregate(static: DataFrame, columns: Sequence[str] = AGGREGATED, by: Sequence[str] = ("month", "mmsi"), order: Sequence[str] = ("time", "static_id")) -> DataFrame:
    """One row per (month, mmsi): the most frequent value of each column among those that say something.

    Null, empty and zero say nothing; of equally frequent values the one met first
    wins; names are trimmed; mmsi 0 is left out; a column without any value is null.
    Counting is by value with map-side combine, so no group is gathered.
    """
    x = static.where(F.col("mmsi") != 0)
    if "vessel_name" in columns:
        x = x.withColumn("vessel_name", F.trim("vessel_name"))
    kinds = {f.name: f.dataType.simpleString() for f in static.schema.fields}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("cell")
    long = x.select(*by, F.struct(*order).alias("o"), cells).select(*by, "o", "cell.*").where("v is not null and v <> '' and v <> '0'")
    counted = long.groupBy(*by, "c", "v").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    w = Window.partitionBy(*by, "c").orderBy(F.desc("n"), "o")
    top = counted.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    wide = top.groupBy(*by).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).cast(kinds[c]).alias(c) for c in columns])
    return x.select(*by).distinct().join(wide, list(by), "left")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, as an insert that does nothing on conflict leaves it.

    One pass: a combined ``min_by`` per key carries the row along, so a key with very
    many copies sends one row a task and is never sorted in one place.
    """
    rest = [c for c in df.columns if c not in key]
    firsts = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return firsts.select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in df.columns])


def valid_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("time").alias("start"), F.max("time").alias("end"))


def date_range(df: DataFrame) -> DataFrame:
    """First day of the first month and last day of the last one."""
    m = df.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return m.select(F.to_date(F.concat("a", F.lit("01")), "yyyyMMdd").alias("first_day"), F.last_day(F.to_date(F.concat("b", F.lit("01")), "yyyyMMdd")).alias("last_day"))


def pings_per_month(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("mmsi").alias("vessels"))


def message_rate(df: DataFrame) -> DataFrame:
    """Messages, span in seconds and messages a second of each source."""
    g = df.groupBy("source").agg(F.count(F.lit(1)).alias("messages"), (F.max("time") - F.min("time")).alias("span_s"))
    return g.withColumn("per_second", F.round(F.col("messages") / F.greatest(F.col("span_s"), F.lit(1)), 6))


def heat_grid(df: DataFrame, degrees: float = 0.5) -> DataFrame:
    """Pings per grid cell."""
    cell = lambda c: (F.floor(F.col(c) / degrees)).cast("int")
    return df.groupBy(cell("lon").alias("cx"), cell("lat").alias("cy")).agg(F.count(F.lit(1)).alias("pings"))
