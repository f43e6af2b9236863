"""Joins of positions with the tables around them.

Dimensions are joined without a forced hint: adaptive execution broadcasts them
when their measured size allows it and shuffles them when it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_static(dynamic: DataFrame, aggregate: DataFrame) -> DataFrame:
    """Positions with the static aggregate of their month, where there is one."""
    return dynamic.join(aggregate, ["month", "mmsi"], "left")


def with_coarse_type(df: DataFrame, types: DataFrame) -> DataFrame:
    """ship_type_txt of each row's ship_type."""
    t = types.select(F.col("coarse_type").alias("ship_type"), F.col("coarse_type_txt").alias("ship_type_txt"))
    return df.join(t, "ship_type", "left")


def with_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """All registry columns, under the prefix reg_."""
    r = registry.select("mmsi", *[F.col(c).alias(f"reg_{c}") for c in registry.columns if c != "mmsi"])
    return df.join(r, "mmsi", "left")


def registry_of(dynamic: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows of the vessels that appear, without tombstones (a null flag counts as one)."""
    return registry.where(F.col("error404") != 1).join(dynamic.select("mmsi").distinct(), "mmsi", "left_semi")


def vessel_info(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry columns with defaults: unknown vessels have error404 = 1, the reported name, and imo or 0."""
    j = with_registry(df, registry.where(F.col("error404") != 1))
    own = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    return (
        j.withColumn("reg_error404", F.coalesce("reg_error404", F.lit(1)))
        .withColumn("reg_name", F.coalesce("reg_name", own("vessel_name", "string")))
        .withColumn("reg_imo", F.coalesce("reg_imo", own("imo", "long"), F.lit(0)))
    )


def without(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet (checksums of read files, vessels with metadata)."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def require_metadata(vessels: DataFrame, registry: DataFrame) -> None:
    """Raise if a vessel has no row in the registry."""
    missing = without(vessels.select("mmsi").distinct(), registry, "mmsi").limit(5).collect()
    if missing:
        raise LookupError(f"no metadata for {[r.mmsi for r in missing]} (and perhaps others)")


def tile_lookup(points: DataFrame, tiles: DataFrame, west: str = "west", east: str = "east", south: str = "south", north: str = "north") -> DataFrame:
    """First tile by name whose box (borders included) holds the point; null where none does.

    Tiles go to one-degree cells and meet the points there by equality.
    """
    cells = tiles.select(
        "*", F.explode(F.sequence(F.floor(west).cast("int"), F.floor(east).cast("int"))).alias("_cx")
    ).select("*", F.explode(F.sequence(F.floor(south).cast("int"), F.floor(north).cast("int"))).alias("_cy"))
    p = points.withColumn("_cx", F.floor("lon").cast("int")).withColumn("_cy", F.floor("lat").cast("int"))
    hit = p.join(cells, ["_cx", "_cy"]).where(F.col("lon").between(F.col(west), F.col(east)) & F.col("lat").between(F.col(south), F.col(north)))
    first = hit.groupBy("row_id").agg(F.min("tile").alias("tile"))
    return points.join(first, "row_id", "left")


def at_nearest(points: DataFrame, grid: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Join with a gridded table on computed axis indexes; points off the grid's cells have nulls."""
    p = points
    for name, index in keys.items():
        p = p.withColumn(name, index)
    return p.join(grid, list(keys), "left")
