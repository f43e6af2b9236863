import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import REPORT, T0, at, leg, metres, reports, rest
from pyspark.sql import functions as F

from wakeline.operators import exactly_once, known_at, plausibility, proximity, regularise, stays

M = 280000001


def ids(df):
    return sorted(r[0] for r in df.collect())


# -- plausibility ------------------------------------------------------------

def faults(spark, rows):
    return {r.row_id: r.fault for r in plausibility.implausible_reports(reports(spark, rows)).collect()}


def test_clean_track_has_no_faults(spark):
    rows = rest(M, T0, 60, -60.0, 45.0) + leg(M, T0 + 60 * 240, 80, -60.0, 45.0, first_id=100) + rest(M, T0 + 60 * 240 + 80 * 120, 60, -59.3, 45.0, first_id=300)
    assert faults(spark, rows[:140]) == {}


@pytest.mark.parametrize("move", [(0.3, 0.1), (120.0, 0.0), (0.0, -90.0)])
def test_single_spike_and_plateau(spark, move):
    rows = leg(M, T0, 80, -60.0, 45.0)
    for k in (20, 50, 51, 52):
        rows[k][3] = (rows[k][3] + move[0] + 180) % 360 - 180
        rows[k][4] += move[1]
    assert set(faults(spark, rows)) == {21, 51, 52, 53}


def test_zero_position_and_swapped_coordinates(spark):
    rows = rest(M, T0, 60, -60.0, 45.0)
    rows[10][3:5] = [0.0, 0.0]
    rows[30][3:5] = [45.0, -60.0]
    assert set(faults(spark, rows)) == {11, 31}


def test_bounds_and_not_available(spark):
    rows = leg(M, T0, 40, -60.0, 45.0)
    rows[5][5], rows[6][5], rows[7][5], rows[8][5] = 1023.0, -1.0, 102.3, None
    rows[10][3:5], rows[11][3:5], rows[12][3:5], rows[13][3:5] = [181.0, 91.0], [200.0, 45.0], [-59.5, 95.0], [None, None]
    f = faults(spark, rows)
    assert set(f) == {6, 7, 12, 13} and set(f.values()) == {"impossible"}


def test_speed_spikes_but_not_departures(spark):
    rows = rest(M, T0, 60, -60.0, 45.0) + leg(M, T0 + 60 * 240, 60, -60.0, 45.0, first_id=100)
    rows[20][5] = 33.0
    rows[90][5] = 44.0
    assert faults(spark, rows) == {21: "speed", 130: "speed"}


def test_stuck_position_and_stuck_speed(spark):
    rows = leg(M, T0, 100, -60.0, 45.0)
    for k in range(31, 38):
        rows[k][3:5] = rows[30][3:5]
    rows[59][5], rows[60][5], rows[75][5] = 11.8, 12.5, 12.1
    for k in range(61, 75):
        rows[k][5] = rows[60][5]
    assert set(faults(spark, rows)) == {*range(32, 39), *range(62, 76)}


def test_lying_still_is_not_stuck(spark):
    rows = [[k, M, T0 + 200 * k, -60.0, 45.0, 0.0] for k in range(1, 200)]
    assert faults(spark, rows) == {}


def test_antimeridian_and_repeats_and_milliseconds(spark):
    rows = leg(M, T0, 80, 179.7, 45.0)
    for r in rows:
        r[3] = (r[3] + 180) % 360 - 180
    rows[40][4] += 1.0
    again = [list(rows[40]), list(rows[10])]
    again[0][0], again[0][2] = 500, rows[40][2] * 1000
    again[1][0] = 501
    assert set(faults(spark, rows + again)) == {41, 500}


def test_plausibility_edges(spark):
    assert plausibility.implausible_reports(spark.createDataFrame([], REPORT)).count() == 0
    rows = [[1, None, T0, 1.0, 1.0, 500.0], [2, 5, T0, 1.0, 1.0, 500.0], [3, M, None, 1.0, 1.0, 500.0], [4, M, T0, None, None, 500.0], [5, M, T0, None, None, None]]
    df = reports(spark, rows).withColumn("t", F.lit("clash")).withColumn("bucket", F.lit(None)).withColumn("own", F.lit(1))
    assert ids(plausibility.implausible_reports(df)) == [4]


# -- known at -----------------------------------------------------------------

ATTR = "mmsi long, field string, valid long, known long, static_id long"
EVENT = "row_id long, mmsi long, time long"


def brute_known(events, attrs, fields):
    out = set()
    for rid, m, t in events:
        if m is None or t is None:
            continue
        for f in fields:
            best = [(v, -i) for mm, ff, v, k, i in attrs if mm == m and ff == f and None not in (v, k) and v <= t and k <= t]
            if best:
                out.add((rid, f, -max(best)[1]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_known_at_against_brute_force(spark, seed):
    rng = random.Random(seed)
    span = 6 * 86_400
    attrs = []
    for i in range(300):
        v = T0 + rng.randrange(0, span, 3600)
        attrs.append((rng.choice([1, 1, 1, 2, 3]), rng.choice("ab"), v, v + rng.choice([0, 60, 90_000, 300_000, -50]), i))
    attrs += [(1, "a", T0, T0, 1000), (1, "a", T0, T0, 999), (None, "a", T0, T0, 1), (1, "a", None, T0, 2), (1, "a", T0, None, 3)]
    events = [(k, rng.choice([1, 1, 2, 3, 4]), T0 + rng.randrange(0, span)) for k in range(400)] + [(900, None, T0), (901, 1, None), (902, 1, T0)]
    got = known_at.as_known(spark.createDataFrame(events, EVENT).withColumn("field", F.lit("x")), spark.createDataFrame(attrs, ATTR).withColumn("extra", F.lit(1)), ("a", "b"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_known(events, attrs, ("a", "b"))


def test_known_at_empty(spark):
    e, a = spark.createDataFrame([], EVENT), spark.createDataFrame([], ATTR)
    assert known_at.as_known(e, a, ("a",)).count() == 0
    assert known_at.as_known(spark.createDataFrame([(1, 1, T0)], EVENT), a, ("a",)).count() == 0


def test_persistent_tree_keeps_old_versions():
    tree, roots, seen = known_at.PersistentTree(), [-1], []
    rng = random.Random(5)
    for k in range(200):
        seen.append((rng.randrange(50), -k))
        roots.append(tree.insert(roots[-1], seen[-1]))
    for n, root in enumerate(roots):
        for t in (0, 13, 49):
            assert tree.last_not_after(root, t) == max((s for s in seen[:n] if s[0] <= t), default=None)


# -- proximity ----------------------------------------------------------------

POINT = "row_id long, mmsi long, t long, lon double, lat double"
ZONE = "zone_id long, xs array<double>, ys array<double>"


def brute_near(pts):
    return {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(pts, 2) if a[1] != b[1] and abs(a[2] - b[2]) <= 120 and metres(a[3], a[4], b[3], b[4]) <= 250}


@pytest.mark.parametrize("hot", [200_000, 40])
def test_near_pairs_against_brute_force(spark, hot):
    rng = random.Random(1)
    pts = []
    for lon, lat in ((-60.0, 45.0), (179.9995, 10.0), (-180.0, 10.0), (20.0, 89.9995), (-170.0, 89.9995), (5.0, -90.0), (0.0, 0.0)):
        for _ in range(45):
            pts.append((len(pts) + 1, rng.randrange(1, 9), T0 + 21_600 * 3 + rng.randrange(-200, 200), max(-180.0, min(180.0, lon + rng.uniform(-0.002, 0.002))), max(-90.0, min(90.0, lat + rng.uniform(-0.002, 0.002)))))
    pts += [(900, 1, T0, 7.0, 7.0), (901, 2, T0, 7.0, 7.0), (902, 2, T0, 7.0, 7.0)]
    df = spark.createDataFrame(pts, POINT).withColumn("cell", F.lit(1)).withColumn("home", F.lit("x"))
    got = [(r.left_id, r.right_id) for r in proximity.near(df, spark.createDataFrame([], ZONE), 250.0, 120, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(pts)


def test_a_crowded_cell_copies_rows_at_borders_only(spark, monkeypatch):
    """A third of all rows in one coarse cell, spread over it: fine cells, no pairs of blocks."""
    rng = random.Random(9)
    pts = [(k, rng.randrange(50), T0 + 21_600 * 5 + rng.randrange(200, 20_000), 7.02 + rng.random() * 0.4, 45.05 + rng.random() * 0.4) for k in range(4000)]
    pts += [(4000 + k, rng.randrange(50), pts[k][2] + rng.randrange(-100, 100), pts[k][3] + 0.001, pts[k][4]) for k in range(2000)]
    seen = {}
    real = proximity.grouped_blocks
    monkeypatch.setattr(proximity, "grouped_blocks", lambda df, *a, **k: (seen.update(n=df.count(), two=df.agg(F.max("two")).first()[0]), real(df, *a, **k))[1])
    got = [(r.left_id, r.right_id) for r in proximity.near(spark.createDataFrame(pts, POINT), spark.createDataFrame([], ZONE), 250.0, 120, 500).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(pts)
    assert seen["two"] == 0 and seen["n"] < 4 * len(pts)


def test_too_many_zones_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(proximity, "MOST_ZONES", 2)
    zones = spark.createDataFrame([(1, None, None), (2, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), (3, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])], ZONE)
    with pytest.raises(ValueError):
        proximity.near(spark.createDataFrame([], POINT), zones, 1.0, 0)


def test_points_in_zones(spark):
    rng = random.Random(2)
    pts = [(k, 1, T0, rng.uniform(-1, 3), rng.uniform(-1, 3)) for k in range(2000)]
    ell = ([0.0, 2.0, 2.0, 1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 0.0])  # concave, closed
    box = ([2.5, 2.5, 0.5, 0.5, 0.5], [0.5, 2.5, 2.5, 0.5, 0.5])  # the other way round, a vertex repeated
    zones = [(1, *ell), (2, *box), (3, None, None), (4, [1.0], [1.0]), (5, [1.0, None, 2.0], [1.0, 2.0, 3.0])]
    got = {(r.left_id, r.right_id) for r in proximity.near(spark.createDataFrame(pts, POINT), spark.createDataFrame(zones, ZONE), 1.0, 0).where("kind = 'zone'").collect()}
    want = {(p[0], 1) for p in pts if 0 < p[3] < 2 and 0 < p[4] < 2 and not (p[3] > 1 and p[4] > 1)} | {(p[0], 2) for p in pts if 0.5 < p[3] < 2.5 and 0.5 < p[4] < 2.5}
    assert got == want


def test_near_empty_and_nulls(spark):
    z = spark.createDataFrame([], ZONE)
    assert proximity.near(spark.createDataFrame([], POINT), z, 250.0, 120).count() == 0
    assert proximity.near(spark.createDataFrame([(1, None, T0, 1.0, 1.0), (2, 3, None, 1.0, 1.0), (3, 3, T0, None, 1.0)], POINT), z, 250.0, 120).count() == 0


# -- stays --------------------------------------------------------------------

def visits(spark, rows):
    return sorted((r.kind, r.start_time, r.end_time) for r in stays.stops_and_trips(reports(spark, rows)).collect())


def test_stops_and_trip(spark):
    a = rest(M, T0 + 80_000, 60, -60.0, 45.0)  # over midnight
    b = leg(M, a[-1][2] + 120, 60, -59.99, 45.0, first_id=200)
    c = rest(M, b[-1][2] + 120, 30, b[-1][3] + 0.02, 45.0, first_id=400)
    b[20][3] += 1.0
    a[5][4] -= 2.0  # implausible positions do not part a stop
    want = [("stop", a[0][2], a[-1][2]), ("stop", c[0][2], c[-1][2]), ("trip", a[-1][2], c[0][2])]
    assert visits(spark, a + b + c) == want
    assert visits(spark, (a + b + c) * 2) == want


def test_silence_ends_stops_and_voids_trips(spark):
    a = rest(M, T0, 20, -60.0, 45.0)
    b = rest(M, a[-1][2] + 20 * 3600, 20, -60.0, 45.0, first_id=100)
    c = rest(M, b[-1][2] + 25 * 3600, 20, -60.0, 45.0, first_id=200)
    assert visits(spark, a + b + c) == [("stop", a[0][2], b[-1][2]), ("stop", c[0][2], c[-1][2])]


def test_short_rest_is_no_stop(spark):
    a = rest(M, T0, 6, -60.0, 45.0)
    b = leg(M, a[-1][2] + 120, 30, -59.99, 45.0, first_id=100)
    assert visits(spark, a + b) == []


def test_recurring_place_has_one_number(spark):
    a = rest(M, T0, 30, -60.0, 45.0)
    b = leg(M, a[-1][2] + 120, 30, -59.99, 45.0, first_id=100)
    c = rest(M, b[-1][2] + 120, 30, -59.5, 45.2, first_id=200)
    d = leg(M, c[-1][2] + 3600, 30, -60.5, 45.0, first_id=300)
    e = rest(M, d[-1][2] + 3600, 30, -60.0, 45.0, first_id=400)
    stops = [r for r in stays.stops_and_trips(reports(spark, a + b + c + d + e)).where("kind = 'stop'").orderBy("start_time").collect()]
    assert len(stops) == 3 and stops[0].place == stops[2].place != stops[1].place


def test_places_of_many_visits_take_linear_time():
    import time

    rng = np.random.default_rng(3)
    n = 100_000
    lon = np.where(np.arange(n) % 2 == 0, 179.9999, -60.0) + rng.normal(0, 0.0002, n)
    lat = np.where(np.arange(n) % 2 == 0, 10.0, 45.0) + rng.normal(0, 0.0002, n)
    began = time.time()
    label = stays.communities((lon + 180) % 360 - 180, lat, np.ones(n))
    assert time.time() - began < 30
    assert np.bincount(label[::2]).max() > 0.99 * n / 2 and np.bincount(label[1::2]).max() > 0.99 * n / 2 and label[0] != label[1]
    apart = stays.communities(np.arange(3000) * 0.1 - 150, np.zeros(3000), np.ones(3000))
    assert len(set(apart.tolist())) == 3000


def test_stays_edges(spark):
    assert stays.stops_and_trips(spark.createDataFrame([], REPORT)).count() == 0
    rows = [[1, None, T0, 1.0, 1.0, 0.0], [2, M, None, 1.0, 1.0, 0.0], [3, M, T0, None, 1.0, 0.0], [4, M, T0, 181.0, 91.0, 0.0], [5, M, T0, 1.0, 1.0, None]]
    assert visits(spark, rows) == []


# -- regular grid -------------------------------------------------------------

def test_empty_slots_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(T0, T0 + 3 * 86_400, 977)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "mmsi long, t long").withColumn("_slot", F.lit("clash"))
    got = {(r.mmsi, r.slot_time) for r in regularise.empty_slots(df, "mmsi", F.col("t")).collect()}
    want = set()
    for m in (1, 2):
        for day in range(T0 // 86_400, T0 // 86_400 + 4):
            full = {t // 600 * 600 for mm, t in rows if mm == m and t is not None and t // 86_400 == day}
            want |= {(m, s) for s in range(min(full), max(full), 600) if s not in full} if full else set()
    assert got == want


def test_regular_grid_goes_on_over_midnight(spark):
    day = 86_400
    rows = [("a", day - 900, 0.0), ("a", day + 900, 18.0), ("a", 4 * day, 5.0), ("b", day - 600, 1.0), ("b", day, 2.0), ("c", day - 30, 3.0)]
    g = regularise.regular_grid(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", ["v"], 600, 3600)
    got = {k: [tuple(r)[1:] for r in g.where(g.k == k).orderBy("grid_time").collect()] for k in "abc"}
    assert got["a"][:3] == [(day - 600, 3.0, "interpolated"), (day, 9.0, "interpolated"), (day + 600, 15.0, "interpolated")]
    assert got["a"][3:-1] == [(t, None, "missing") for t in range(day + 1200, 4 * day, 600)] and got["a"][-1] == (4 * day, 5.0, "observed")
    assert got["b"] == [(day - 600, 1.0, "observed"), (day, 2.0, "observed")] and got["c"] == [(day, 3.0, "extended")]


def test_regular_grid_states(spark):
    rows = [("a", T0, 0.0), ("a", T0 + 1200, 2.0), ("a", T0 + 1200, 9.0), ("a", T0 + 9000, 4.0), ("a", T0 + 9050, None), (None, T0, 1.0), ("b", None, 1.0)]
    g = regularise.regular_grid(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", ["v"], 600, 3600)
    got = [(r.grid_time - T0, r.v, r.state) for r in g.orderBy("grid_time").collect()]
    assert got[:3] == [(0, 0.0, "observed"), (600, 1.0, "interpolated"), (1200, 2.0, "observed")]
    assert got[3] == (1800, None, "missing") and got[-2][0] == 9000 and got[-1] == (9600, None, "extended")
    assert regularise.regular_grid(spark.createDataFrame([], "k string, t long, v double"), "k", "t", ["v"], 600, 3600).count() == 0


def brute_grid(rows, step, max_gap):
    """Every pair of readings of a source, one after the other."""
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        best = {}
        for kk, t, x in rows:
            if kk == k and t is not None:
                best[t] = min(best.get(t, x), x)
        line = sorted(best.items())
        if not line:
            continue
        out += [(k, line[0][0] // step * step, line[0][1], "extended")] if line[0][0] % step else []
        for (t, x), (nt, nx) in zip(line, line[1:]):
            for g in range(-(-t // step) * step, nt, step):
                turn = (nx - x + 180) % 360 - 180
                v = x if g == t else None if nt - t > max_gap else (x + turn * (g - t) / (nt - t) + 180) % 360 - 180
                out.append((k, g, v, "observed" if g == t else "missing" if v is None else "interpolated"))
        t, x = line[-1]
        out.append((k, -(-t // step) * step, x, "extended" if t % step else "observed"))
    return sorted(out)


def test_regular_grid_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(T0 - 86_400, T0 + 3 * 86_400, 331)]), rng.choice([179.5, -179.5, -170.0, 60.0])) for _ in range(600)]
    rows += [("c", T0 + 86_400 - 1500, 1.0), ("c", T0 + 86_400 + 1500, 3.0), ("d", T0 + 86_400 - 300, 1.0), ("d", T0 + 86_400, 2.0), ("e", T0, 5.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double").withColumn("state", F.lit("clash")).withColumn("_win", F.lit(1)).repartition(3)
    g = regularise.regular_grid(df, "k", "t", ["v"], 600, 3600, begin=True, circular=["v"])
    got = sorted((r.k, r.grid_time, r.v, r.state) for r in g.collect())
    want = brute_grid(rows, 600, 3600)
    assert [(k, t, s) for k, t, _, s in got] == [(k, t, s) for k, t, _, s in want]
    assert len({(k, t) for k, t, _, _ in got}) == len(got)
    for (_, _, a, _), (_, _, b, _) in zip(got, want):
        assert (a is None) == (b is None) and (a is None or abs((a - b + 180) % 360 - 180) < 1e-9)


# -- exactly once -------------------------------------------------------------

def test_repeated_messages_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        m = 7 if rng.random() < 0.34 else rng.choice([None, 1, 2, -5, 2**62])
        t = T0 if m == 7 else rng.choice([None, T0, T0 + 1, (T0 + 1) * 1000 + 7, T0 + 2])
        rows.append((k, m, t, rng.choice(["Feed A", "feed-a", "FEED_A ", "b", None]), at(T0 + rng.randrange(5)) if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "row_id long, mmsi long, time long, source string, received timestamp").withColumn("copy", F.lit(1)).withColumn("shard", F.lit("x")).repartition(5)
    best = {}
    norm = lambda s: None if s is None else s.lower().translate(str.maketrans("", "", " -_"))
    for k, m, t, s, r in rows:
        key = (m, t // 1000 if t and t > 10**11 else t, norm(s))
        rank = (r is None, r.timestamp() if r else 0, k)
        best[key] = min(best.get(key, rank), rank)
    keep = {b[2] for b in best.values()}
    assert ids(exactly_once.repeated_messages(df)) == sorted(k for k, *_ in rows if k not in keep)
    assert ids(exactly_once.keep_first(df).select("row_id")) == sorted(keep)


def test_exactly_once_empty(spark):
    assert exactly_once.repeated_messages(spark.createDataFrame([], REPORT)).count() == 0


def test_permutation_loses_nothing():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, 20_000), rng.integers(-5, 5, 20_000)
    x, y = exactly_once.permute(a, b)
    assert len({*zip(x.tolist(), y.tolist())}) == len({*zip(a.tolist(), b.tolist())})


def test_quotient_table_is_exact_and_gives_identifiers_back():
    rng = np.random.default_rng(2)
    n = 30_000
    a = np.where(rng.random(n) < 0.5, rng.integers(0, 1 << 30, n), rng.integers(-(2**62), 2**62, n))[rng.integers(0, n // 3, n)]
    b = rng.integers(-2, 3, n)
    high, low, wide = exactly_once.identifiers(a, b)
    code, received, row = rng.integers(0, 2, n) * 2 + wide, rng.integers(0, 4, n), rng.permutation(n)
    table, gone = exactly_once.QuotientTable(4), []
    for part in np.array_split(np.arange(n), 7):  # grows as it goes
        gone.append(table.insert(high[part], low[part], code[part], received[part], row[part]))
    best = {}
    for k, r in zip(zip(a.tolist(), b.tolist(), code.tolist()), zip(received.tolist(), row.tolist())):
        best[k] = min(best.get(k, r), r)
    gone = np.concatenate(gone)
    assert len(table) == len(best) and len(gone) == len(set(gone.tolist())) == n - len(best)
    assert set(range(n)) - set(gone.tolist()) == {r for _, r in best.values()}
    back = zip(*(x.tolist() for x in table.identifier(table.taken())))
    assert set(back) == set(zip(high.tolist(), low.tolist(), code.tolist()))
    q, rest = table.cut(high)
    assert len({*zip(q.tolist(), rest.tolist(), low.tolist(), wide.tolist())}) == len({*zip(a.tolist(), b.tolist())})
    shard = int(high[0] >> np.uint64(64 - exactly_once.SHARD_BITS))
    table.keep_shard(shard)
    assert set(table.row[table.taken()].tolist()) == {r for (x, y, c), (_, r) in best.items() if int(exactly_once.identifiers(np.array([x]), np.array([y]))[0][0] >> np.uint64(44)) == shard}


def test_rows_of_one_shard_that_span_many_batches():
    rng = random.Random(6)
    rows = [(5 if rng.random() < 0.4 else rng.randrange(300), T0, "ab"[rng.randrange(2)], rng.randrange(50), k) for k in range(4000)]
    staged = []
    for k in range(0, 4000, 500):  # eight scan tasks
        a, b, f, rec, row = map(list, zip(*rows[k : k + 500]))
        staged += exactly_once.local_pass(iter([pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "feed": f, "received": pa.array(rec, pa.int64()), "row_id": pa.array(row, pa.int64())})]))
    whole = pa.Table.from_batches(staged)
    high = [None if v is None else v % 2**64 >> 44 for v in whole["high"].to_pylist()]
    order = sorted(range(len(high)), key=lambda i: -1 if high[i] is None else high[i])
    cut = whole.take(order).combine_chunks().to_batches(max_chunksize=7)
    got = sorted(v for b in exactly_once.shard_pass(iter(cut)) for v in b["row_id"].to_pylist())
    best = {}
    for m, t, f, rec, row in rows:
        best[m, f] = min(best.get((m, f), (rec, row)), (rec, row))
    assert got == sorted(set(range(4000)) - {r for _, r in best.values()})
