"""The query service's requests, answered as DataFrames of JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import filters, joins
from wakeline.operators.aggregates import heat_grid, valid_range
from wakeline.operators.simplify import simplify
from wakeline.plans.export import track_json

REQUESTS = ("track_vectors", "track_vectors_extra", "validrange", "meta", "zones", "heatmap")


def validate(request: dict) -> dict:
    """The request, if it is one; else ValueError says what is wrong."""
    kind = request.get("msgtype")
    if kind not in REQUESTS:
        raise ValueError(f"unknown request {kind!r}")
    if kind in ("track_vectors", "track_vectors_extra", "heatmap"):
        try:
            a, b, box = int(request["start"]), int(request["end"]), request["area"]
            x0, x1, y0, y1 = (float(box[k]) for k in ("x0", "x1", "y0", "y1"))
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"missing or bad {e}") from None
        if a >= b or x0 >= x1 or y0 >= y1:
            raise ValueError("start, x0 and y0 must be less than end, x1 and y1")
    return request


def answer(request: dict, pings: DataFrame, registry: DataFrame | None = None, geom: DataFrame | None = None, decimate: float | None = 1e-4) -> DataFrame:
    """Messages that answer a request; track requests end with a ``done`` message that counts the tracks.

    Tracks are simplified by ``decimate`` (square degrees of a triangle), or whole if it is None.
    """
    kind = validate(request)["msgtype"]
    if kind == "validrange":
        return valid_range(pings).select(F.to_json(F.struct(F.lit(kind).alias("msgtype"), "start", "end")).alias("message"))
    if kind == "meta":
        r = joins.registry_of(pings, registry)
        return r.select(F.to_json(F.struct(F.lit("vesselinfo").alias("msgtype"), F.struct(*r.columns).alias("meta"))).alias("message"))
    if kind == "zones":
        from wakeline.plans.export import zone_json

        return zone_json(geom).select("message")
    box = request["area"]
    x = pings.where(filters.in_time_bbox(start=int(request["start"]), end=int(request["end"]), xmin=box["x0"], xmax=box["x1"], ymin=box["y0"], ymax=box["y1"], lon="lon", lat="lat"))
    if kind == "heatmap":
        return heat_grid(x).select(F.to_json(F.struct(F.lit(kind).alias("msgtype"), "cx", "cy", "pings")).alias("message"))
    meta = ()
    if kind == "track_vectors_extra" and registry is not None:
        x = joins.with_registry(x, registry)
        meta = tuple(c for c in x.columns if c.startswith("reg_"))
    out = track_json(x if decimate is None else simplify(x, decimate), meta=meta)
    done = out.agg(F.count(F.lit(1)).alias("count")).select(F.to_json(F.struct(F.lit("done").alias("msgtype"), "count")).alias("message"))
    return out.select("message").unionByName(done)
