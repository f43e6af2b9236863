"""Places: zone files, port index, vessel registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zones_from_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Zones of text files with one ``x,y`` a line; the file's stem is the name."""
    x = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("zone_name"), F.filter(F.split("value", r"\r?\n"), lambda s: s.rlike(r"^\s*[-+0-9.eE]+\s*,\s*[-+0-9.eE]+")).alias("p")
    )
    num = lambda i: F.transform("p", lambda s: F.trim(F.get(F.split(s, ","), F.lit(i - 1))).try_cast("double"))
    return x.select("zone_name", num(1).alias("xs"), num(2).alias("ys"))


def ports_from_geojson(spark: SparkSession, paths: list[str] | str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Port index features as rows: their properties, longitude and latitude; inside (xmin, ymin, xmax, ymax) if given."""
    f = spark.read.option("multiLine", True).json(paths).select(F.explode("features").alias("f"))
    rows = f.select("f.properties.*", F.element_at("f.geometry.coordinates", 1).cast("double").alias("longitude"), F.element_at("f.geometry.coordinates", 2).cast("double").alias("latitude"))
    return rows if bbox is None else rows.where(inside(*bbox))


def inside(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return F.col("longitude").between(xmin, xmax) & F.col("latitude").between(ymin, ymax)


def registry_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registry after new rows replaced those of the same mmsi; of several new ones the last by ``seen``."""
    latest = new.groupBy("mmsi").agg(F.max_by(F.struct(*[c for c in old.columns if c != "mmsi"]), "seen").alias("r")).select("mmsi", "r.*")
    return old.join(latest.select("mmsi"), "mmsi", "left_anti").unionByName(latest.select(*old.columns))


def rows_of(registry: DataFrame, retry_404: bool = False) -> DataFrame:
    """Registry rows that say something; tombstones only on request."""
    return registry if retry_404 else registry.where(F.col("error404") != 1)
