"""The movement graph: who went from which zone to which, and how."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.scalar import wetted_surface
from wakeline.operators import encoder, filters, joins, resample, tracks, zones


def graph(
    pings: DataFrame,
    geom: DataFrame,
    registry: DataFrame | None = None,
    enrich: Sequence = (),
    maxdelta: timedelta = timedelta(weeks=1),
    speed: float = 50,
    distance: float = 200_000,
    step: timedelta = timedelta(minutes=10),
    minscore: float = 0.0,
    drop: Sequence[Column] = (),
) -> DataFrame:
    """Edges of the graph from track rows (mmsi, time, row_id, lon, lat, sog).

    Splits by time, encodes pathways, resamples each, fences the samples and sums
    up the stretches between changes of zone.  ``enrich`` are DataFrame to
    DataFrame steps that add columns of rasters to the samples; ``drop`` are
    predicates on edges, any of which drops the edge.
    """
    x = tracks.split_timedelta(pings, maxdelta)
    key = ["mmsi", "idx", "label"]
    x = encoder.encode(x, distance, speed, minscore).select(*key, "row_id", "time", "lon", "lat", "sog")
    if pings.sparkSession.conf.get("spark.checkpoint.dir", None):
        x = x.checkpoint()  # half-way: what follows is planned and, after a loss, run from here
    samples = resample.interp_time(x, step, ("sog",), key)
    # numbers of samples are made of what they are, so they are the same on every run
    samples = samples.withColumn("row_id", F.xxhash64(*key, "time"))
    for e in enrich:
        samples = samples.transform(e)
    edges = zones.edge_statistics(zones.transits(zones.fence(samples, geom), key), key)
    if registry is not None:
        edges = joins.with_registry(edges, registry.where(F.col("error404") != 1))
        edges = edges.withColumn("submerged_hull_m^2", wetted_surface(F.col("reg_summer_dwt"), F.lit(None).cast("int"), F.col("reg_vesseltype_generic"), F.col("reg_vesseltype_detailed")))
    return filters.drop_where_any(edges, list(drop))
