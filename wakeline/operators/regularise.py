"""Irregular readings onto a regular grid.

Consecutive readings are paired with ``lead`` inside (source, window of time);
only the grid times that lie between a pair are exploded, so the work follows
the output.  Windows (a UTC day here) bound every sort, whatever share of the
rows one source has; the pair that spans two windows belongs to the earlier one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.normalise import seconds, usable_position

DAY = 86_400


def shortest_turn(a: Column, b: Column) -> Column:
    """Degrees from direction ``a`` to direction ``b``, the short way round."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def regular_grid(
    df: DataFrame,
    key: str,
    time: str,
    values: Sequence[str],
    step: int,
    max_gap: int,
    within: int = DAY,
    extend: bool = True,
    begin: bool = False,
    across: bool = True,
    circular: Sequence[str] = (),
) -> DataFrame:
    """Series at every multiple of ``step``; gaps are interpolated or marked.

    Each reading is paired with the next by ``lead`` inside its (key, window), the
    last of a window with the first of the key's next window that has any (one row
    per key and window is carried; ``across=False`` leaves windows apart); grid
    times in [time, next) are exploded.  Pairs at most ``max_gap`` apart are
    interpolated linearly, longer ones give rows with null values and state
    ``missing``; a grid time that meets a reading has state ``observed``.  With
    ``extend`` the key's last reading also fills the grid time after it, with
    ``begin`` its first one the grid time before it (state ``extended``); no grid
    time comes twice.  Values named in ``circular`` are degrees in [-180, 180] and
    go the short way round.  Rows with null key or time are left out; of readings
    with one time the one with the smallest values (nulls first) stays; null
    values interpolate to null.  Output: key, grid_time, values..., state.  Extra
    columns are dropped.  Empty in, empty out.
    """
    w = Window.partitionBy(key, "_win").orderBy("_t")
    names = [f"_v_{i}" for i in range(len(values))] or ["_none"]
    cells = [F.col(v).cast("double").alias(n) for n, v in zip(names, values)] or [F.lit(None).cast("double").alias("_none")]
    base = (
        df.select(F.col(key), F.col(time).cast("long").alias("_t"), *cells)
        .where(F.col(key).isNotNull() & F.col("_t").isNotNull())
        .withColumn("_win", F.floor(F.col("_t") / within).cast("long"))
        .repartition(key, "_win")  # serves the merging of repeats, the heads of windows and the pairing
        .groupBy(key, "_win", "_t")
        .agg(F.min(F.struct(*names)).alias("_v"))
    )
    pairs = base.withColumn("_nt", F.lead("_t").over(w)).withColumn("_nv", F.lead("_v").over(w)).withColumn("_pt", F.lag("_t").over(w))
    if across:
        # a window's rows meet the neighbouring windows by way of one row per key and window
        line = Window.partitionBy(key).orderBy("_win")
        heads = base.groupBy(key, "_win").agg(F.min(F.struct("_t", "_v")).alias("_head"))
        heads = heads.withColumn("_carry", F.lead("_head").over(line)).withColumn("_later", F.lag("_win").over(line).isNotNull()).drop("_head")
        pairs = (
            pairs.join(heads, [key, "_win"], "left")
            .withColumn("_nv", F.when(F.col("_nt").isNull(), F.col("_carry._v")).otherwise(F.col("_nv")))
            .withColumn("_nt", F.coalesce("_nt", "_carry._t"))
            .withColumn("_first", F.col("_pt").isNull() & ~F.col("_later"))
        )
    else:
        pairs = pairs.withColumn("_first", F.col("_pt").isNull())
    up = (F.ceil(F.col("_t") / step) * step).cast("long")
    down = (F.floor(F.col("_t") / step) * step).cast("long")
    first = F.when(F.col("_first"), down).otherwise(up) if begin else up
    last = F.coalesce(F.col("_nt") - 1, up if extend else F.col("_t"))
    rows = pairs.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("grid_time", F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))))
    gap = F.col("_nt") - F.col("_t")
    share = (F.col("grid_time") - F.col("_t")) / gap
    state = (
        F.when(F.col("grid_time") == F.col("_t"), "observed").when(F.col("_nt").isNull() | (F.col("grid_time") < F.col("_t")), "extended")
        .when(gap <= max_gap, "interpolated").otherwise("missing")
    )
    out = []
    for n, v in zip(names, values):
        a, b = F.col(f"_v.{n}"), F.col(f"_nv.{n}")
        between = a + (b - a) * share
        if v in circular:
            between = F.pmod(a + shortest_turn(a, b) * share + 180.0, F.lit(360.0)) - 180.0
        out.append(F.when(state.isin("observed", "extended"), a).when(state == "interpolated", between).alias(v))
    return rows.select(key, "grid_time", *out, state.alias("state"))


def empty_slots(df: DataFrame, key: str, time: Column, step: int = 600, within: int = DAY) -> DataFrame:
    """Empty slots of ``step`` seconds between the first and last filled slot of each source and window.

    The filled slots are readings that stand on the grid; what ``regular_grid`` marks
    as missing between them is empty.  Returns (key, slot_time).  Rows with a null key
    or time are ignored; an empty table gives no rows; repeated readings of a slot are
    merged map-side, so few rows are exchanged.
    """
    filled = df.select(F.col(key), (F.floor(time / step) * step).cast("long").alias("_slot")).distinct()
    grid = regular_grid(filled, key, "_slot", (), step, step, within, extend=False, across=False)
    return grid.where("state = 'missing'").select(key, F.col("grid_time").alias("slot_time"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/ais_dynamic.parquet")
    usable = d.where(usable_position(d.mmsi, d.longitude, d.latitude))
    return empty_slots(usable, "mmsi", seconds(F.col("time")))


def p5_series(spark, sf_dir: str) -> DataFrame:
    """Positions of each vessel every ten minutes, marked where silent for over an hour."""
    d = spark.read.parquet(f"{sf_dir}/ais_dynamic.parquet")
    usable = d.where(usable_position(d.mmsi, d.longitude, d.latitude)).withColumn("t", seconds(F.col("time")))
    g = regular_grid(usable, "mmsi", "t", ["longitude", "latitude"], 600, 3600, begin=True, circular=["longitude"])
    # interpolation halfway ends on a five often: a hair more than half a unit makes rounding the same everywhere
    five = lambda c: F.round(F.col(c) + 1e-9, 5).alias(c)
    return g.select("mmsi", "grid_time", five("longitude"), five("latitude"), "state")


P5_SQL = """
WITH s AS (SELECT DISTINCT mmsi, CAST(floor((CASE WHEN time >= 100000000000 THEN floor(time / 1000) ELSE time END) / 600) AS BIGINT) * 600 AS slot
           FROM ais_dynamic WHERE mmsi >= 201000000 AND mmsi < 776000000 AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90),
d AS (SELECT mmsi, slot, lead(slot) OVER (PARTITION BY mmsi, CAST(floor(slot / 86400) AS BIGINT) ORDER BY slot) AS nxt FROM s)
SELECT mmsi, unnest(generate_series(slot + 600, nxt - 600, 600)) AS slot_time FROM d WHERE nxt - slot > 600
"""

P5_SERIES_SQL = """
WITH r AS (SELECT mmsi, CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END AS t, longitude AS x, latitude AS y
           FROM ais_dynamic WHERE mmsi >= 201000000 AND mmsi < 776000000 AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90 AND time IS NOT NULL),
o AS (SELECT mmsi, t, min({'x': x, 'y': y}) AS p FROM r GROUP BY mmsi, t),
l AS (SELECT mmsi, t, p.x AS x, p.y AS y, lead(t) OVER w AS nt, lead(p.x) OVER w AS nx, lead(p.y) OVER w AS ny, lag(t) OVER w IS NULL AS opens FROM o WINDOW w AS (PARTITION BY mmsi ORDER BY t)),
g AS (SELECT *, unnest(generate_series(CASE WHEN opens THEN t // 600 * 600 ELSE (t + 599) // 600 * 600 END, coalesce(nt - 1, (t + 599) // 600 * 600), 600)) AS grid_time FROM l),
s AS (SELECT *, CASE WHEN grid_time = t THEN 'observed' WHEN nt IS NULL OR grid_time < t THEN 'extended' WHEN nt - t <= 3600 THEN 'interpolated' ELSE 'missing' END AS state,
  (grid_time - t) / CAST(nt - t AS DOUBLE) AS f, nx - x + CASE WHEN nx - x >= 180 THEN -360 WHEN nx - x < -180 THEN 360 ELSE 0 END AS turn FROM g),
v AS (SELECT *, CASE state WHEN 'interpolated' THEN x + turn * f WHEN 'missing' THEN NULL ELSE x END AS lon, CASE state WHEN 'interpolated' THEN y + (ny - y) * f WHEN 'missing' THEN NULL ELSE y END AS lat FROM s)
SELECT mmsi, grid_time, round(CASE WHEN state <> 'interpolated' THEN lon WHEN lon >= 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END + 1e-9, 5) AS longitude, round(lat + 1e-9, 5) AS latitude, state FROM v
"""
