import gzip
import math
import zipfile
from datetime import datetime

import numpy as np
import pytest
from helpers import T0, metres
from pyspark.sql import functions as F

from wakeline.functions import geo, hexgrid, scalar
from wakeline.operators import aggregates, encoder, filters, joins, resample, simplify, tracks, zones
from wakeline.plans import export, query, service
from wakeline.plans.store import Store, ingest
from wakeline.sources import files, grids, nmea, places
from wakeline.streaming import receiver

PING = "row_id long, mmsi long, time long, lon double, lat double, sog double, cog double, source string"


def pings(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], PING)


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


# -- scalars -------------------------------------------------------------------

def test_shift_coordinate_oracle(spark):
    xs = [-360, -270, -180, -90, 0, 90, 180, 270, 360]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    assert [r[0] for r in df.select(geo.shift_coordinate(F.col("x"))).collect()] == [0, 90, 180, -90, 0, 90, -180, -90, 0]


@pytest.mark.parametrize("axis,x,want", [([1, 2, 3], 2, 1), ([1, 2, 3], 5, 2), ([1, 2, 3], -10, 0), ([3, 2, 1], 10, 0), ([3, 2, 1], -5, 2), ([3, 2, 1], 2, 1), ([], 1, -1)])
def test_binary_search_oracle(spark, axis, x, want):
    assert value(spark, scalar.first_at_least(axis, F.lit(float(x)))) == want


def test_haversine_and_nulls(spark):
    assert value(spark, geo.haversine(F.lit(-60.0), F.lit(45.0), F.lit(-61.0), F.lit(46.0))) == pytest.approx(metres(-60, 45, -61, 46), rel=1e-12)
    assert value(spark, geo.haversine(F.lit(None).cast("double"), F.lit(45.0), F.lit(-61.0), F.lit(46.0))) is None


def test_geodesic_azimuth_known_values():
    assert geo.geodesic_azimuth_np([0.0], [0.0], [1.0], [0.0])[0] == pytest.approx(90)
    assert geo.geodesic_azimuth_np([0.0], [0.0], [0.0], [1.0])[0] == pytest.approx(0)
    assert geo.geodesic_azimuth_np([-71.1], [42.25], [-123.6833], [45.5167])[0] == pytest.approx(-66.53, abs=0.1)


def test_text_and_epoch_helpers(spark):
    assert value(spark, scalar.sanitize(F.lit("a,b#\"c'\n"))) == "abc" and value(spark, scalar.sanitize(F.lit("-"))) == "" and value(spark, scalar.sanitize(F.lit(None).cast("string"))) == ""
    assert value(spark, scalar.zone_number(F.lit("zone_12"))) == 12 and value(spark, scalar.zone_number(F.lit("none"))) is None
    assert scalar.epoch(datetime(2021, 11, 1)) == 1635724800 and scalar.from_epoch(1635724800) == datetime(2021, 11, 1)
    assert scalar.months_between(datetime(2020, 11, 30), datetime(2021, 2, 1)) == ["202011", "202012", "202101", "202102"]
    assert len(scalar.coarse_types()) == 81


def test_wetted_surface_classes(spark):
    rows = [(100, 25, None, None), (1000, 30, None, None), (1000, 70, "Cargo", "Container Ship"), (1000, 84, None, None), (1000, 80, "Tanker", "Crude Oil"), (None, 70, None, None), (1000, None, None, None)]
    df = spark.createDataFrame(rows, "dwt long, t int, g string, d string")
    got = [r[0] for r in df.select(scalar.wetted_surface(F.col("dwt"), F.col("t"), F.col("g"), F.col("d"))).collect()]
    want = [0, 15.58 * 1000**0.602, 5.39 * 1000**0.698, 5.41 * 1000**0.699, 5.41 * 1000**0.699, 0, 0]
    assert got == pytest.approx(want)


def test_hex_cells_hold_their_points(spark):
    q, r = hexgrid.hex_axial(F.lit(-62.1), F.lit(46.2), 5000.0)
    row = spark.range(1).select(q.alias("q"), r.alias("r")).first()
    corners = hexgrid.hex_polygon(int(row.q), int(row.r), 5000.0)
    assert min(x for x, _ in corners) < -62.1 < max(x for x, _ in corners) and min(y for _, y in corners) < 46.2 < max(y for _, y in corners)


# -- filters -------------------------------------------------------------------

def test_bbox_wraps_and_validates(spark):
    df = pings(spark, [(1, 1, 0, 179.0, 0.0, 1.0, 0.0), (2, 1, 0, -179.0, 0.0, 1.0, 0.0), (3, 1, 0, 0.0, 0.0, 1.0, 0.0), (4, 1, 0, None, None, 1.0, 0.0)])
    hit = df.where(filters.in_bbox(170, 190, -1, 1, lon="lon", lat="lat")).select("row_id").collect()
    assert sorted(r[0] for r in hit) == [1, 2]
    with pytest.raises(ValueError):
        filters.in_bbox(5, 4, 0, 1)


def test_min_speed_filter_single_ping_and_last(spark):
    step = 10 / 1.9438445 * 100 / 111195.08  # ten knots for 100 s
    rows = [(1, 1, 0, 0.0, 0.0, 1.0, 0.0), (2, 1, 100, step, 0.0, 1.0, 0.0), (3, 1, 200, step, 0.0, 1.0, 0.0), (4, 1, 300, 2 * step, 0.0, 1.0, 0.0), (9, 2, 0, 0.0, 0.0, 1.0, 0.0)]
    assert sorted(r.row_id for r in filters.min_speed_filter(pings(spark, rows), 5).collect()) == [1, 3, 4, 9]


def test_drop_where_any_null_is_false(spark):
    df = pings(spark, [(1, 1, 0, 0.0, 0.0, None, 0.0), (2, 1, 0, 0.0, 0.0, 60.0, 0.0)])
    assert [r.row_id for r in filters.drop_where_any(df, [F.col("sog") > 50]).collect()] == [1]


# -- tracks --------------------------------------------------------------------

def test_islands_split_at_the_bound(spark):
    rows = [(k, 1, t, 0.0, 0.0, 1.0, 0.0) for k, t in enumerate((0, 10, 3610, 7209, 7209))]
    got = {r.row_id: r.idx for r in tracks.split_timedelta(pings(spark, rows), 3600).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    assert tracks.split_timedelta(pings(spark, []), 10).count() == 0


def test_split_longitude_and_timedelta_in_a_chain(spark):
    rows = [(1, 1, 0, 179.9, 0.0, 1.0, 0.0), (2, 1, 10, -179.9, 0.0, 1.0, 0.0), (3, 1, 20, -179.8, 0.0, 1.0, 0.0)]
    x = tracks.split_timedelta(tracks.split_longitude(tracks.deltas(pings(spark, rows))), 3600)
    assert {r.row_id: r.lon_seg for r in x.collect()} == {1: 0, 2: 1, 3: 1}


def test_no_task_holds_a_whole_track(spark):
    """Pings are placed by track and day: no exchange of rows and no window over them goes by the track alone."""
    plan = tracks.deltas(pings(spark, [(1, 1, 0, 0.0, 0.0, 1.0, 0.0)]))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_day#" in line.split("], [")[1] or "_carry" in line or "__was" in line for line in windows)


def test_tracks_over_many_days_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m in (1, 1, 1, 2, 3):  # one vessel with most of the rows
        n = 300
        t = np.sort(rng.integers(T0, T0 + 9 * 86_400, n))
        rows += [(len(rows) + k, m, int(t[k]), float(rng.normal(0, 0.3)), float(rng.normal(40, 0.3)), float(rng.integers(0, 5)), float(rng.integers(0, 360))) for k in range(n)]
    rows += [(9000, 2, T0 + 86_400, 0.0, 40.0, 1.0, 0.0), (9001, 2, T0 + 86_400, 0.0, 40.0, 1.0, 0.0)]  # on midnight, twice
    df = pings(spark, rows).repartition(5)
    d = {r.row_id: r for r in tracks.deltas(df).collect()}
    idx = {r.row_id: r.idx for r in tracks.split_timedelta(df, 7200).collect()}
    total = {r.mmsi: r.meters for r in tracks.summary(df).collect()}
    seg = {r.row_id: r.seg for r in tracks.split_tracks(df, max_distance=1e9, min_direction_change=181, min_speed=1, min_segment_length=3).collect()}
    for m in (1, 2, 3):
        line = sorted((r[2], r[0], r) for r in rows if r[1] == m)
        number, way, runs_ = 0, 0.0, [[]]
        for k, (t, i, r) in enumerate(line):
            before = line[k - 1][2] if k else None
            if before is None:
                assert d[i].delta_meters is None and d[i].delta_seconds is None
            else:
                far = metres(before[3], before[4], r[3], r[4])
                assert d[i].delta_seconds == t - before[2] and d[i].delta_meters == pytest.approx(far, abs=1e-6)
                way += far
                number += t - before[2] >= 7200
                if t - before[2] >= 86_400 or r[5] < 1:
                    runs_.append([])
            assert idx[i] == number
            runs_[-1].append(i)
        assert total[m] == pytest.approx(way, abs=0.06)
        kept = [g for g in runs_ if len(g) >= 3]
        assert {i: seg.get(i) for _, i, _ in line} == {i: next((n for n, g in enumerate(kept) if i in g), None) for _, i, _ in line}


def test_simplify_over_days_and_live(spark):
    line = [(k, 1, T0 + 3600 * k, 0.01 * k, 10.0, 1.0, 0.0) for k in range(100)]  # straight, over five days
    assert sorted(r.row_id for r in simplify.simplify(pings(spark, line), 1e-4).collect()) == [0, 99]
    bend = [(k, 1, T0 + 60 * k, 0.01 * min(k, 60), 10.0 + 0.01 * max(0, k - 60), 1.0, 0.0) for k in range(120)]
    assert sorted(r.row_id for r in simplify.simplify(pings(spark, bend), 1e-4).collect()) == [0, 60, 119]
    assert sorted(r.row_id for r in simplify.simplify_live(pings(spark, bend)).collect()) == [0, 60, *range(99, 120)]
    assert simplify.simplify(pings(spark, []), 1e-4).count() == simplify.simplify_live(pings(spark, [])).count() == 0
    x, y = np.array([0.0, 1, 2, 3, 3]), np.array([0.0, 0.1, 0, 0, 5])
    assert simplify.farthest_first(x, y, 0.5).tolist() == [True, False, False, True, True]


def test_split_tracks_keeps_long_segments(spark):
    rows = [(k, 1, 60 * k, 0.001 * k, 0.0, 5.0, 90.0) for k in range(20)] + [(100 + k, 1, 10**6 + 60 * k, 0.001 * k, 0.0, 5.0, 90.0) for k in range(5)]
    got = tracks.split_tracks(pings(spark, rows)).select("row_id", "seg", tracks.track_id().alias("id")).collect()
    assert {r.seg for r in got} == {0} and {r.id for r in got} == {"1-0"} and len(got) == 19  # the last ping is where the course turns


def test_encoder_parts_two_vessels_under_one_number(spark):
    rows = []
    for k in range(20):
        rows += [(2 * k, 1, 600 * k, -60 + 0.01 * k, 45.0, 5.0, 0.0), (2 * k + 1, 1, 600 * k + 300, -40 + 0.01 * k, 45.0, 5.0, 0.0)]
    got = {r.row_id: r.label for r in encoder.encode(pings(spark, rows)).collect()}
    assert {got[2 * k] for k in range(20)} == {0} and {got[2 * k + 1] for k in range(20)} == {1}


def test_simplify_keeps_ends_and_corners():
    x = np.array([0, 1, 2, 3, 3, 3.0])
    y = np.array([0, 0, 0, 0, 1, 2.0])
    assert simplify.kept(x, y, 1e-4).tolist() == [True, False, False, True, False, True]
    assert simplify.kept(x[:2], y[:2], 1).all()


def test_vectorised_keeps_every_ping(spark):
    v = tracks.vectorised(pings(spark, [(k, 1, k, float(k), 0.0, 1.0, 0.0) for k in range(7)]), most=3, static=("source",)).orderBy("part").collect()
    assert [len(r.time) for r in v] == [3, 3, 1] and [x for r in v for x in r.lon] == list(map(float, range(7)))


# -- resampling ----------------------------------------------------------------

def test_interpolation_meets_the_mercator_midpoint(spark):
    df = pings(spark, [(1, 1, 0, -45.0, 60.0, 1.0, 0.0), (2, 1, 3600, -44.0, 61.0, 3.0, 0.0), (3, 2, 0, 1.0, 1.0, 1.0, 0.0)])
    rows = resample.interp_time(df, 1800).orderBy("time").collect()
    y = lambda p: math.log(math.tan(math.pi / 4 + math.radians(p) / 2))
    mid = math.degrees(2 * math.atan(math.exp((y(60) + y(61)) / 2)) - math.pi / 2)
    assert [r.time for r in rows] == [0, 1800, 3600] and {r.mmsi for r in rows} == {1}
    assert rows[1].lat == pytest.approx(mid, abs=1e-9) and abs(rows[1].lat - 60.5) > 1e-3 and rows[1].sog == pytest.approx(2)
    spl = resample.interp_cubic_spline(df, 1800).where("mmsi = 1").orderBy("time").collect()
    assert spl[1].lat == pytest.approx(mid, abs=1e-6)


def test_last_sample_is_clamped(spark):
    df = pings(spark, [(1, 1, 0, 0.0, 0.0, 1.0, 10.0), (2, 1, 1000, 1.0, 0.0, 2.0, 77.0)])
    rows = resample.geo_interp_time(df, 600).orderBy("time").collect()
    assert [r.time for r in rows] == [0, 600, 1200] and rows[-1].lon == pytest.approx(1) and rows[-1].cog == 77.0 and rows[0].cog == pytest.approx(90)


def test_spacing_is_constant_and_ends_at_the_end(spark):
    df = pings(spark, [(k, 1, 60 * k, 0.01 * k, 0.0, 1.0, 0.0) for k in range(10)])
    way = [r.way for r in resample.interp_spacing(df, 2500.0).orderBy("way").collect()]
    assert np.allclose(np.diff(way[:-1]), 2500) and way[-1] == pytest.approx(6378137 * math.radians(0.09)) and way[-1] - way[-2] <= 2500
    assert resample.interp_spacing(df, 1e6).count() == 0


def test_resampling_queries_take_every_track(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(8)
    rows, ids = [], (201000001, 316000001, 563000001, 775999999)
    for m in ids:
        t = np.sort(rng.integers(T0, T0 + 200_000, 60))
        lon, lat = np.cumsum(rng.normal(0, 0.2, 60)), 40 + np.cumsum(rng.normal(0, 0.1, 60))
        rows += [(len(rows) + k, m, int(t[k]), float(lon[k]), float(lat[k]), float(rng.integers(0, 20)), 1.0, 1.0, "feed") for k in range(60)]
    rows.append((len(rows), ids[0], rows[5][2], 9.0, 9.0, 9.0, 1.0, 1.0, "feed"))  # a second ping of one time
    spark.createDataFrame(rows, "row_id long, mmsi long, time long, longitude double, latitude double, sog double, cog double, heading double, source string").write.parquet(f"{tmp_path}/ais_dynamic.parquet")
    samples, ways = {}, {}
    for m in ids:
        one = {}
        for r in rows:
            if r[1] == m:
                one.setdefault(r[2], r)
        t = np.array(sorted(one))
        lon, lat, sog = (np.array([one[k][c] for k in t]) for c in (3, 4, 5))
        x, y = 6378137 * np.radians(lon), 6378137 * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
        at = t[0] + 1800 * np.arange(math.ceil((t[-1] - t[0]) / 1800) + 1)
        back = np.degrees(2 * np.arctan(np.exp(np.interp(at, t, y) / 6378137)) - np.pi / 2)
        samples |= {(m, int(k)): v for k, *v in zip(at, np.degrees(np.interp(at, t, x) / 6378137), back, np.interp(at, t, sog))}
        total = np.hypot(np.diff(x), np.diff(y)).sum()
        ways[m] = (math.ceil(total / 50_000) + 1, total)
    q = entry.queries()
    got = {(r.mmsi, r.time): [r.lon, r.lat, r.sog] for r in q["interp_time"](spark, str(tmp_path)).collect()}
    assert set(got) == set(samples) and all(np.allclose(got[k], samples[k], atol=1e-4, rtol=0) for k in got)
    spaced = q["interp_spacing"](spark, str(tmp_path)).groupBy("mmsi").agg(F.count(F.lit(1)).alias("samples"), F.max("way").alias("metres"))
    got = {r.mmsi: (r.samples, r.metres) for r in spaced.collect()}
    assert set(got) == set(ids) and all(got[m][0] == ways[m][0] and abs(got[m][1] - ways[m][1]) <= 1 for m in ids)
    assert sorted(map(tuple, q["coarse_types"](spark, str(tmp_path)).collect())) == scalar.coarse_types()


def test_spline_passes_through_cubics():
    t = np.array([0.0, 1, 3, 4, 7])
    f = lambda u: (u**3 - 2 * u**2 + 5)[:, None]
    at = np.linspace(0, 8, 30)
    assert np.allclose(resample.spline(t, f(t), at), f(at))
    assert np.allclose(resample.spline(t[:3], (t[:3] ** 2)[:, None], at)[:, 0], at**2)


# -- zones ---------------------------------------------------------------------

def test_fence_transits_and_edges(spark):
    z = spark.createDataFrame([("zone_1", [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0]), ("zone_2", [2.0, 3.0, 3.0, 2.0], [0.0, 0.0, 1.0, 1.0])], "zone_name string, xs array<double>, ys array<double>")
    g = zones.geometry(z)
    assert g.where("zone = 'zone_1'").first().cx == pytest.approx(0.5)
    rows = [(k, 1, 600 * k, 0.25 * k - 0.5, 0.5, 1.0, 0.0) for k in range(20)]
    f = zones.fence(pings(spark, rows), g)
    assert {r.in_zone for r in f.collect()} == {"Z0", "zone_1", "zone_2"}
    e = zones.edge_statistics(zones.transits(f)).orderBy("edge").collect()
    assert [(r.src_zone, r.rcv_zone) for r in e] == [(1, 0), (0, 2), (2, 0), (0, None)] and e[0].transit_nodes == "zone_1_Z0"
    alone = zones.edge_statistics(zones.transits(zones.fence(pings(spark, [(1, 5, 0, 9.0, 9.0, 1.0, 0.0)]), g))).collect()
    assert len(alone) == 1 and alone[0].velocity_knots_avg is None and alone[0].rcv_zone is None


def test_ways_beyond_an_int(spark, tmp_path):
    import __spark_entry__ as entry

    # one edge of 120 legs half round the earth, and a short one
    rows = [(k, 201000001, T0 + 600 * k, 180.0 * (k % 2), 0.0, 1.0, 1.0, 1.0, "feed") for k in range(121)] + [(200 + k, 201000002, T0 + 600 * k, 0.1 * k, 50.0, 1.0, 1.0, 1.0, "feed") for k in range(3)]
    spark.createDataFrame(rows, "row_id long, mmsi long, time long, longitude double, latitude double, sog double, cog double, heading double, source string").write.parquet(f"{tmp_path}/ais_dynamic.parquet")
    spark.createDataFrame([("zone_1", [-9.0, -8.0, -8.0], [70.0, 70.0, 71.0])], "zone_name string, xs array<double>, ys array<double>").write.parquet(f"{tmp_path}/zones.parquet")
    got = {r.mmsi: (r.pings, r.cumulative_distance_meters) for r in entry.queries()["transit_edges"](spark, str(tmp_path)).collect()}
    far, near = 120 * metres(0, 0, 180, 0), metres(0, 50, 0.1, 50) + metres(0.1, 50, 0.2, 50)
    assert far > 2**31 and got == {201000001: (121, int(far)), 201000002: (3, int(near))}


def test_zone_helpers(spark):
    assert zones.split_box(170, 190) == [(170, 180.0), (-180.0, -170)]
    m = spark.createDataFrame([("mz", [([-64.0, -63.0, -63.0, -64.0], [45.0, 45.0, 46.0, 46.0]), ([-62.0, -61.0, -61.0, -62.0], [44.0, 44.0, 45.0, 45.0])])], "zone_name string, rings array<struct<xs: array<double>, ys: array<double>>>")
    g = zones.geometry(zones.exploded(m))
    assert sorted(r.zone for r in g.collect()) == ["mz_0", "mz_1"] and tuple(zones.bounds(g).first()) == (-64, -61, 44, 46)
    got = {r.row_id: r.in_zone for r in zones.zone_of(pings(spark, [(1, 1, 0, -63.5, 45.5, 1.0, 0.0), (2, 1, 0, -61.5, 44.5, 1.0, 0.0), (3, 1, 0, 0.0, 0.0, 1.0, 0.0)]), g).collect()}
    assert got == {1: "mz_0", 2: "mz_1"}
    wide = zones.geometry(spark.createDataFrame([("w", [-200.0, -170.0, -170.0], [0.0, 0.0, 1.0])], "zone_name string, xs array<double>, ys array<double>"))
    with pytest.raises(ValueError):
        zones.require_in_range(wide)


# -- aggregates and joins ------------------------------------------------------

def test_static_mode_ties_go_to_the_first(spark):
    rows = [("200401", 1, 10, 1, " ALFA ", 5), ("200401", 1, 20, 2, "BETA", 0), ("200401", 1, 30, 3, "BETA", None), ("200401", 1, 5, 4, "ALFA", 7), ("200401", 0, 5, 5, "X", 7), ("200402", 1, 5, 6, "", 0)]
    df = spark.createDataFrame(rows, "month string, mmsi long, time long, static_id long, vessel_name string, ship_type int")
    got = {(r.month, r.mmsi): (r.vessel_name, r.ship_type) for r in aggregates.static_aggregate(df, ("vessel_name", "ship_type")).collect()}
    assert got == {("200401", 1): ("ALFA", 7), ("200402", 1): (None, None)}


def test_registry_joins(spark):
    reg = spark.createDataFrame([(1, 11, "A", 0), (2, 22, "B", 1), (3, 33, "C", None)], "mmsi long, imo long, name string, error404 int")
    p = pings(spark, [(k, m, 0, 0.0, 0.0, 1.0, 0.0) for k, m in enumerate((1, 2, 3, 4, 1))])
    assert [r.mmsi for r in joins.registry_of(p, reg).collect()] == [1]
    info = {r.mmsi: (r.reg_error404, r.reg_imo) for r in joins.vessel_info(p, reg).collect()}
    assert info == {1: (0, 11), 2: (1, 0), 3: (1, 0), 4: (1, 0)}
    with pytest.raises(LookupError):
        joins.require_metadata(p, reg)


# -- sources -------------------------------------------------------------------

LINE = r"\s:1,c:1635883083*6C\!AIVDM,1,1,,A,15MgK45P3@G?fl0E`JbR0OwT0@MS,0*4E"
PART1 = r"\s:1,c:1635883090*6C\!AIVDM,2,1,1,A,55?MbV02;H;s<HtKR20EHE:0@T4@Dn2222222216L961O5Gf0NSQEp6ClRp8,0*1C"
PART2 = r"\s:1,c:1635883091*6C\!AIVDM,2,2,1,A,88888888880,2*25"


def messages(spark, lines):
    x = spark.createDataFrame([(v, "f", n) for n, v in enumerate(lines)], "line string, file string, n long")
    return nmea.reassembled(nmea.parsed(x, now=2_000_000_000))


def test_decode_position_and_voyage(spark):
    m = messages(spark, [LINE, PART1, LINE, PART2, PART2, "garbage", r"\c:2*1\!AIVDM,1,1,,A,1,0*1", ""])
    d = nmea.dynamic_rows(m, "t").collect()
    assert len(d) == 2 and d[0].mmsi == 366730000 and d[0].longitude == pytest.approx(-122.392533, abs=1e-6) and d[0].sog == 20.8 and d[0].heading == 0
    s = nmea.static_rows(m, "t").collect()
    assert len(s) == 1 and s[0].mmsi == 351759000 and s[0].vessel_name == "EVER DIADEM" and s[0].imo == 9134270 and s[0].call_sign == "3FOF8" and s[0].ship_type == 70 and s[0].destination == "NEW YORK" and (s[0].eta_month, s[0].eta_day) == (5, 15)


def test_eta_guard(spark):
    df = spark.createDataFrame([(2, 29, 1, 1), (2, 30, 1, 1), (13, 1, 1, 1), (5, 5, 24, 60), (None, 1, 1, 1)], "a int, b int, c int, d int")
    got = [tuple(r) for r in df.select(*nmea.eta(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [(2, 29, 1, 1)] + [(1, 1, 0, 0)] * 4


def test_store_round_trip(spark, tmp_path):
    plain, packed, archive = tmp_path / "a.nm4", tmp_path / "b.nm4.gz", tmp_path / "c.zip"
    plain.write_text("\n".join([LINE, PART1, PART2, LINE]))
    with gzip.open(packed, "wt") as f:
        f.write(LINE.replace("1635883083", "1638883083"))
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("d.nm4", LINE.replace("1635883083", "1635883999"))
    csv = tmp_path / "e.csv"
    csv.write_text("MMSI,BaseDateTime\n338000001,2021-12-01T00:01:01,30.5,-88.25,1.5,10.0,511,STAR,9000001,WX1,70,0,20,5,2.5,70,A\n")
    store = Store(spark, str(tmp_path / "store"))
    assert store.dynamic().count() == 0
    ingest(store, [str(plain), str(packed)], "coast")
    ingest(store, [str(plain)], "coast")  # again
    assert store.dynamic().count() == 2 and store.static().count() == 1
    assert sorted(r.month for r in store.dynamic().select("month").distinct().collect()) == ["202111", "202112"]
    store.spark.conf.get("spark.sql.session.timeZone")
    q = query.Query(store, datetime(2021, 11, 1), datetime(2021, 12, 31), filters.in_timerange_validmmsi)
    assert q.dataframe().count() == 2 and q.tracks().count() == 2 and q.dataframe(limit=1).count() == 1
    store.aggregate_static()
    assert query.Query(store, datetime(2021, 11, 1), datetime(2021, 11, 30)).dataframe(query.crawl_dynamic_static).first().month == "202111"
    with pytest.raises(ValueError):
        query.Query(store, datetime(2021, 11, 2), datetime(2021, 11, 1))
    ingest(store, [str(csv)], "noaa_2021")
    assert store.dynamic().where("source = 'noaa_2021'").count() == 1
    assert files.zipped_lines(spark, str(archive)).count() == 1
    assert files.select_formats(["a.nm4", "b.CSV", "c.pdf", "d.nmea.gz"], "csv") == ["b.CSV"]
    sums = files.checksums(spark, [str(plain)]).first()
    assert sums.hash == files.checksum(plain.read_bytes())


def test_raster_and_tiles(spark, tmp_path):
    r = grids.Raster(np.arange(12, dtype=float).reshape(3, 4), grids.Axis(-10.0, 5.0, 4), grids.Axis(20.0, -10.0, 3))
    for deflate in (False, True):
        grids.write_geotiff(str(tmp_path / "r.tif"), r, deflate)
        back = grids.read_geotiff(str(tmp_path / "r.tif"))
        assert (back.values == r.values).all() and back.lon == r.lon and back.lat == r.lat
    p = pings(spark, [(1, 1, 0, -10.0, 20.0, 1.0, 0.0), (2, 1, 0, -4.0, 5.0, 1.0, 0.0), (3, 1, 0, 99.0, -99.0, 1.0, 0.0)])
    got = {x.row_id: x.km for x in grids.with_raster(p, r.table(spark), r.lon, r.lat, "km").collect()}
    assert got == {1: 0.0, 2: 10.0, 3: 11.0}
    assert grids.parse_tile_name("gebco_n90.0_s0.0_w-90.0_e0.0.tif") == {"n": 90.0, "s": 0.0, "w": -90.0, "e": 0.0}


def test_zone_files_ports_and_requests(spark, tmp_path):
    (tmp_path / "bay.txt").write_text("0,0\n1,0\n1,1\n")
    z = places.zones_from_text(spark, str(tmp_path / "bay.txt")).first()
    assert z.zone_name == "bay" and list(z.xs) == [0, 1, 1] and list(z.ys) == [0, 0, 1]
    (tmp_path / "p.json").write_text('{"features":[{"properties":{"PORT_NAME":"A"},"geometry":{"type":"Point","coordinates":[1.5,2.5]}},{"properties":{"PORT_NAME":"B"},"geometry":{"type":"Point","coordinates":[9.0,9.0]}}]}')
    rows = places.ports_from_geojson(spark, str(tmp_path / "p.json"), (0, 0, 5, 5)).collect()
    assert [(r.PORT_NAME, r.longitude) for r in rows] == [("A", 1.5)]
    req = grids.weather_request(["t2m"], datetime(2021, 1, 1), datetime(2021, 2, 1), (60, -70, 40, -50))
    assert [(r["year"], r["month"], len(r["day"])) for r in req] == [("2021", "01", 31), ("2021", "02", 28)]
    with pytest.raises(ValueError):
        service.validate({"msgtype": "track_vectors", "start": 5, "end": 4, "area": {"x0": 0, "x1": 1, "y0": 0, "y1": 1}})
    with pytest.raises(ValueError):
        service.validate({"msgtype": "nonsense"})


# -- streaming -----------------------------------------------------------------

def test_receiver_end_to_end(spark, tmp_path):
    src, store, out = tmp_path / "in", Store(spark, str(tmp_path / "store")), []
    src.mkdir()
    (src / "1.txt").write_text("\n".join([LINE, PART1, LINE]))
    lines = spark.readStream.text(str(src)).select(F.col("value").alias("line"), F.current_timestamp().alias("arrival"))
    ck = str(tmp_path / "ck")
    receiver.start(lines, store, ck, publish=lambda df, n: out.extend(r.value for r in df.collect()), interval=None).awaitTermination()
    (src / "2.txt").write_text("\n".join([PART2, LINE]))
    receiver.start(lines, store, ck, publish=lambda df, n: out.extend(r.value for r in df.collect()), interval=None).awaitTermination()
    assert store.dynamic().count() == 1 and store.static().first().vessel_name == "EVER DIADEM"
    assert out and '"heading":-1' in out[0]


def test_fragments_of_one_second_and_stale_ones():
    import pandas as pd

    class State:
        def __init__(self, value=None):
            self.value, self.hasTimedOut = value, False

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, v):
            self.value = v

        def remove(self):
            self.value = None

        def setTimeoutTimestamp(self, t):
            self.until = t

        def getCurrentWatermarkMs(self):
            return 0

    def run(rows, state):
        out = list(receiver.join_fragments(("1", "A", 2), iter([pd.DataFrame(rows, columns=["no", "payload", "time"])]), state))
        return [tuple(r) for p in out for r in p[["time", "payload"]].itertuples(index=False)]

    s = State()
    assert run([(1, "a", 5), (2, "b", 5), (1, "c", 5), (2, "d", 5)], s) == [(5, "ab"), (5, "cd")] and not s.exists
    assert run([(1, "lost", 6)], s) == [] and s.exists
    assert run([(1, "x", 9), (2, "y", 9)], s) == [(9, "xy")]  # not with the part of another message
    s = State()
    assert run([(1, "a", 5)], s) == [] and run([(2, "b", 6)], s) == [(6, "ab")] and not s.exists


def test_failed_batch_can_be_tried_again(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    src.mkdir()
    (src / "1.txt").write_text("\n".join([LINE, PART1, PART2]))
    lines = spark.readStream.text(str(src)).select(F.col("value").alias("line"), F.current_timestamp().alias("arrival"))
    monkeypatch.setattr(store, "insert", lambda *a, **k: 1 / 0)
    receiver.start(lines, store, str(tmp_path / "ck"), interval=None).awaitTermination()
    monkeypatch.undo()
    assert store.dynamic().count() == 0
    receiver.retry(spark, store)
    receiver.retry(spark, store)
    assert store.dynamic().count() == 1 and store.static().first().vessel_name == "EVER DIADEM"


def test_lines_from_datagrams(spark, tmp_path):
    import socket
    import time

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    spark.dataSource.register(receiver.UdpSource)
    q = spark.readStream.format("udp_lines").option("host", "127.0.0.1").option("port", port).load().writeStream.format("memory").queryName("datagrams").start()
    try:
        until = time.time() + 60
        while time.time() < until:
            receiver.to_udp("127.0.0.1", port)(spark.createDataFrame([("one",), ("two",)], "value string"), 0)
            if {r.line for r in spark.table("datagrams").collect()} == {"one", "two"}:
                break
            time.sleep(1)
        assert {r.line for r in spark.table("datagrams").collect()} == {"one", "two"}
    finally:
        q.stop()


def test_weather_catalogue(spark):
    c = spark.createDataFrame([("t2m", "2m_temperature"), ("t2m", "2m_temperature"), ("u10", "10m_u_component_of_wind"), (None, "x")], "short_name string, variable string")
    assert grids.variables_of(c, ["u10", "t2m"]) == {"u10": "10m_u_component_of_wind", "t2m": "2m_temperature"}
    with pytest.raises(ValueError):
        grids.variables_of(c, ["nope"])


def test_datagram_batches_are_bounded():
    import socket
    import time

    reader = receiver.UdpReader({"host": "127.0.0.1", "port": "0", "rows": "3"})
    assert list(reader.read({"n": 0})[0]) == []
    to = reader.socket.getsockname()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for k in range(5):
            s.sendto(f"line {k}\r\n".encode(), to)
    time.sleep(0.2)
    rows, end = reader.read({"n": 0})
    assert [r[0] for r in rows] == ["line 0", "line 1", "line 2"] and end == {"n": 3}
    assert [r[0] for r in reader.readBetweenOffsets({"n": 0}, end)] == ["line 0", "line 1", "line 2"]
    rows, end = reader.read(end)
    assert [r[0] for r in rows] == ["line 3", "line 4"] and end == {"n": 5}
    reader.commit(end)
    assert list(reader.readBetweenOffsets({"n": 3}, end)) == []
    reader.socket.close()


def test_cells_of_provider_lines(spark):
    from wakeline.sources import provider_csv

    lines = ['1,"A, B", c ,"",', '"x"," y ",""', "", 'a,"b"']
    got = [list(r[0]) for r in spark.createDataFrame([(v,) for v in lines], "line string").select(provider_csv.cells(F.col("line"))).collect()]
    assert got == [["1", "A, B", "c", "", ""], ["x", " y ", ""], [""], ["a", "b"]]


def lzw(body):
    """A plain encoder with a growing table, as TIFF wants it."""
    table, codes, width, word = {bytes([k]): k for k in range(256)}, [(256, 9)], 9, b""
    n = 258
    for c in body:
        one = word + bytes([c])
        if one in table:
            word = one
            continue
        codes.append((table[word], width))
        table[one], n, word = n, n + 1, bytes([c])
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            codes.append((256, width))
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
    codes += [(table[word], width)]
    n += 1
    codes += [(257, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12)]
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_lzw_streams():
    rng = np.random.default_rng(1)
    for body in (b"abababababab" * 50, rng.integers(0, 4, 20_000, dtype=np.uint8).tobytes(), rng.integers(0, 256, 9000, dtype=np.uint8).tobytes()):
        assert grids.unlzw(lzw(body)) == body and grids.unlzw(grids.relzw(body)) == body


@pytest.mark.parametrize("pack", ["plain", "deflate", "lzw"])
@pytest.mark.parametrize("block", [None, 16])
def test_rasters_read_by_workers(spark, tmp_path, pack, block):
    r = grids.Raster(np.arange(35 * 50, dtype=float).reshape(35, 50), grids.Axis(0.0, 0.5, 50), grids.Axis(30.0, -0.5, 35))
    path = tmp_path / "gebco_2022_n30.0_s12.5_w0.0_e25.0.tif"
    path.write_bytes(grids.geotiff_bytes(r, pack, block))
    assert (grids.read_geotiff(str(path)).values == r.values).all()
    got = {(c.ix, c.iy): c.value for c in grids.raster_cells(spark, str(path)).collect()}
    assert got == {(x, y): float(r.values[y, x]) for x in range(50) for y in range(35)}
    p = pings(spark, [(1, 1, 0, 3.2, 28.4, 1.0, 0.0)])
    assert grids.with_depth(p, spark, str(path)).first().depth_metres == -float(r.values[4, 7])
    with pytest.raises(Exception, match="no raster tile"):
        grids.with_depth(pings(spark, [(1, 1, 0, 99.0, 28.4, 1.0, 0.0)]), spark, str(path)).collect()


def test_nearest_zone_from_candidates_of_cells(spark):
    rng = np.random.default_rng(5)
    z = [(f"z{k}", [float(x), float(x) + 1, float(x) + 1], [float(y), float(y), float(y) + 1]) for k, (x, y) in enumerate(zip(rng.uniform(-170, 170, 40), rng.uniform(-80, 80, 40)))]
    g = zones.geometry(spark.createDataFrame(z, "zone_name string, xs array<double>, ys array<double>"))
    p = pings(spark, [(k, 1, 0, float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90)), 1.0, 0.0) for k in range(300)])
    every = zones.zone_distances(p, g).groupBy("row_id").agg(F.min(F.struct("distance", "zone")).alias("n")).select("row_id", "n.zone", "n.distance")
    assert sorted(map(tuple, zones.nearest_zone(p, g).collect())) == sorted(map(tuple, every.collect()))
    with pytest.raises(ValueError):
        zones.zone_distances(p, g, 5)


def test_zones_from_vertices(spark):
    v = spark.createDataFrame([(7, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])] + [(9, 0, 5.0, 5.0)], "zone int, seq int, x double, y double")
    got = {r.zone_name: (list(r.xs), list(r.ys)) for r in zones.from_vertices(v).collect()}
    assert got == {"zone_0": ([0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), "zone_1": ([5.0], [5.0])}
    with pytest.raises(ValueError):
        zones.from_vertices(v, epsg=2154)


def test_export(spark, tmp_path):
    p = pings(spark, [(1, 7, T0, -60.123456789, 45.0, 1.0, 0.0), (2, 8, T0, 1.0, 2.0, 1.0, 0.0), (3, 7, T0 + 5, -60.2, 45.0, None, 0.0)])
    rows = {r.row_id: r for r in export.csv_rows(p).collect()}
    assert rows["1"].lon == "-60.12346" and rows["1"].Track_ID == "1" and rows["2"].Track_ID == "2" and rows["3"].sog == ""
    export.write_csv(p, str(tmp_path / "out"), single=True)
    assert "Track_ID" in next((tmp_path / "out").glob("*.csv")).read_text()
    assert '"coordinates":[[-60.123456789,45.0],[-60.2,45.0]]' in {r.mmsi: r.feature for r in export.geojson(p).collect()}[7]
