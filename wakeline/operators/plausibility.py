"""Implausible readings in position reports: spikes, stuck values, impossible values.

Method: phase-space thresholding.  Around each report its value (less the
running median), first and second difference are placed in phase space; points
outside the ellipsoid whose semi-axes are the universal threshold
``sqrt(2 ln n)`` times a robust scale of that source are candidates.  A candidate
is a spike if the source's own pace does not let it be reached from its trusted
neighbours; spikes are removed and the rest is judged again until nothing
changes.  Stuck values are runs of zero differences which the other readings of
the same source contradict; impossible values fail fixed bounds.

Work is cut into (vessel, day) with a margin of reports from the neighbouring
days, so no task depends on the size of a vessel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.grouped import as_numpy, grouped_blocks, key_change
from wakeline.operators.normalise import seconds, valid_mmsi

DAY = 86_400
MARGIN = 3 * 3600  # seconds of neighbouring days seen by each day
SIDE = 6  # neighbours on each side
M_PER_DEG = 6371008.8 * np.pi / 180
KNOT = 1852 / 3600
SLACK_M = 500.0  # position noise allowed on top of the pace
PACE_KN = 40.0  # least pace allowed for any vessel
SOG_TOL = 6.0  # least departure of a speed from what positions and neighbours say


def distance(lon1, lat1, lon2, lat2):
    """Great-circle metres between arrays of degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def neighbours(group: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(n, 2*side) indexes of the neighbours within the same group, -1 where there is none."""
    n = len(group)
    off = np.r_[np.arange(-side, 0), np.arange(1, side + 1)]
    at = np.arange(n)[:, None] + off
    ok = (at >= 0) & (at < n)
    at = np.where(ok, at, 0)
    return np.where(ok & (group[at] == group[:, None]), at, -1)


def by_group(group: np.ndarray, x: np.ndarray, q: float) -> np.ndarray:
    """Quantile of each group's non-NaN values, spread back to its rows; groups are contiguous."""
    out = np.full(len(x), np.nan)
    if not len(x):
        return out
    size = np.bincount(group)
    ok = ~np.isnan(x)
    order = np.lexsort((x, ~ok, group))
    good = np.bincount(group, weights=ok, minlength=len(size)).astype(int)
    start = np.r_[0, np.cumsum(size)[:-1]]
    pick = np.minimum(start + np.maximum(np.ceil(q * good).astype(int) - 1, 0), len(x) - 1)
    val = np.where(good > 0, x[order][pick], np.nan)
    return val[group]


def ellipsoid(group: np.ndarray, x: np.ndarray, floor: float) -> np.ndarray:
    """True where (value, first, second difference) lies outside the group's ellipsoid."""
    n = len(x)
    nb = neighbours(group)
    around = np.where(nb >= 0, x[nb], np.nan)
    full = np.concatenate([around, x[:, None]], axis=1)
    r = x - np.nanmedian(full, axis=1)
    same_next = np.r_[group[1:] == group[:-1], False]
    d1 = np.where(same_next, np.r_[np.diff(x), 0.0], 0.0)
    d1 = np.where(np.r_[False, same_next[:-1]], np.where(np.abs(np.r_[0.0, d1[:-1]]) > np.abs(d1), np.r_[0.0, d1[:-1]], d1), d1)
    d2 = np.where(same_next, np.r_[np.diff(d1), 0.0], 0.0)
    count = np.bincount(group)[group]
    lam2 = 2 * np.log(np.maximum(count, 3))
    total = np.zeros(n)
    for part in (r, d1, d2):
        scale = np.maximum(1.4826 * by_group(group, np.abs(part), 0.5), floor)
        total += (part / scale) ** 2 / lam2
    return total > 1


def unwrap(group: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Longitude relative to the group's middle, so that the antimeridian is no jump."""
    mid = by_group(group, lon, 0.5)
    far = by_group(group, np.abs((lon - mid + 180) % 360 - 180), 0.5)
    mid = np.where(np.isnan(far), 0.0, mid)
    return (lon - mid + 180) % 360 - 180


def steps(group: np.ndarray, t, lon, lat):
    """Metres and seconds from the row before; NaN at the start of a group."""
    if not len(t):
        return np.zeros(0), np.zeros(0)
    same = np.r_[False, group[1:] == group[:-1]]
    d = np.full(len(t), np.nan)
    dt = np.full(len(t), np.nan)
    i = np.flatnonzero(same)
    d[i] = distance(lon[i - 1], lat[i - 1], lon[i], lat[i])
    dt[i] = t[i] - t[i - 1]
    return d, dt


def runs(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run number, run length) of equal neighbouring values within a group."""
    head = key_change([group, x])
    no = np.cumsum(head) - 1
    return no, np.bincount(no)[no] if len(no) else no


def stuck_positions(group, t, lon, lat, sog) -> np.ndarray:
    """Instants whose longitude, latitude or both repeat while the vessel moves; never the first of a run."""
    n = len(t)
    bad = np.zeros(n, dtype=bool)
    if n < 4:
        return bad
    gone = np.where((sog >= 0) & (sog < 102.3), sog, np.nan)
    run_lon, len_lon = runs(group, lon)
    run_lat, len_lat = runs(group, lat)
    for run, size, other in ((run_lon, len_lon, lat), (run_lat, len_lat, lon)):
        first = key_change([run])
        start = np.flatnonzero(first)
        at = start[run]
        stepped = np.r_[0, np.cumsum(np.abs(np.diff(other)) > 2e-6)]
        last = np.r_[start[1:], n][run] - 1
        # one coordinate alone stands still while the other one goes on
        bad |= (size >= 4) & (stepped[last] - stepped[at] > 0.6 * (size - 1)) & (np.arange(n) > at)
    both, size = runs(group, np.r_[0, np.cumsum((np.diff(lon) != 0) | (np.diff(lat) != 0))])
    start = np.flatnonzero(key_change([both]))
    end = np.r_[start[1:], n] - 1
    length = end - start + 1
    cand = np.flatnonzero(length >= 3)
    for k in cand:
        a, b = start[k], end[k]
        s = gone[a + 1 : b + 1]
        s = s[~np.isnan(s)]
        if len(s) and np.median(s) > 1.5:
            bad[a + 1 : b + 1] = True
            continue
        if len(s) >= 0.5 * (b - a):  # its own speed says that it lies still
            continue
        if b + 1 < n and group[b + 1] == group[a]:
            d = distance(lon[a], lat[a], lon[b + 1], lat[b + 1])
            if d > 400 and d / max(1, t[b + 1] - t[b]) / KNOT > 1.8 * (d / max(1, t[b + 1] - t[a]) / KNOT) and d / max(1, t[b + 1] - t[b]) / KNOT > 25:
                bad[a + 1 : b + 1] = True
    return bad


def position_spikes(group, t, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """(spikes, metres a second allowed) by iterated phase-space thresholding."""
    n = len(t)
    bad = np.zeros(n, dtype=bool)
    pace_all = np.full(n, PACE_KN * KNOT)
    left = np.arange(n)
    while len(left) >= 3:  # every round but the last takes a report out
        g = np.cumsum(key_change([group[left]])) - 1
        tt, lo, la = t[left], lon[left], lat[left]
        x = unwrap(g, lo)
        d, dt = steps(g, tt, lo, la)
        pace = np.maximum(PACE_KN * KNOT, np.nan_to_num(2 * by_group(g, d / np.maximum(dt, 1), 0.9)))
        pace = np.minimum(pace, 120 * KNOT)
        pace_all[left] = pace
        cand = ellipsoid(g, x, 50 / M_PER_DEG) | ellipsoid(g, la, 50 / M_PER_DEG)
        i = np.flatnonzero(cand)
        if not len(i):
            break
        nb = neighbours(g)[i]
        have = nb >= 0
        j = np.where(have, nb, 0)
        far = distance(lo[i][:, None], la[i][:, None], lo[j], la[j]) > pace[i][:, None] * np.abs(tt[i][:, None] - tt[j]) + SLACK_M
        hit = np.zeros(len(i), dtype=bool)
        for side in (2, 3, SIDE):  # near neighbours see small jumps, far ones long plateaus
            cols = slice(SIDE - side, SIDE + side)
            seen = have[:, cols].sum(1)
            hit |= (2 * (far & have)[:, cols].sum(1) > seen) & (seen >= 2)
        if not hit.any():
            break
        bad[left[i[hit]]] = True
        # only groups that lost a report can come to another verdict
        left = left[np.isin(g, g[i[hit]])]
        left = left[~bad[left]]
    return bad, pace_all


def instants(key: np.ndarray, t: np.ndarray, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """(instant number of each row, row that stands for each instant): the first with a usable position, else the first."""
    head = key_change([key, t])
    no = np.cumsum(head) - 1
    start = np.flatnonzero(head)
    usable = (np.abs(lon) <= 180) & (np.abs(lat) <= 90)
    first = np.full(len(start), len(t), dtype=np.int64)
    i = np.flatnonzero(usable)
    np.minimum.at(first, no[i], i)
    return no, np.where(first < len(t), first, start)


def between(group, t, lon, lat, good, at_group, at_t):
    """Indexes of the good instants before and after given times (-1 if none), never at the time itself."""
    gi = np.flatnonzero(good)
    if not len(gi):
        return np.full(len(at_t), -1), np.full(len(at_t), -1)
    span = np.int64(1) << 40
    base = group[gi].astype(np.int64) * span + t[gi]
    want = at_group.astype(np.int64) * span + at_t
    a = np.searchsorted(base, want, side="left") - 1
    b = np.searchsorted(base, want, side="right")
    before = np.where((a >= 0), gi[np.clip(a, 0, len(gi) - 1)], -1)
    after = np.where((b < len(gi)), gi[np.clip(b, 0, len(gi) - 1)], -1)
    before = np.where((before >= 0) & (group[before] == at_group), before, -1)
    after = np.where((after >= 0) & (group[after] == at_group), after, -1)
    return before, after


def clean_track(table: pa.Table) -> dict:
    """Instants of a block with usable positions, judged; shared with the stop finder."""
    mmsi, bucket = as_numpy(table["mmsi"]), as_numpy(table["bucket"])
    t, lon, lat, sog = (as_numpy(table[c]) for c in ("t", "longitude", "latitude", "sog"))
    lon, lat, sog = (np.asarray(x, dtype=float) for x in (lon, lat, sog))
    key = np.cumsum(key_change([mmsi, bucket])) - 1
    no, rep = instants(key, t, lon, lat)
    pos = (np.abs(lon[rep]) <= 180) & (np.abs(lat[rep]) <= 90)
    k = np.flatnonzero(pos)
    r = rep[k]
    stuck = stuck_positions(key[r], t[r], lon[r], lat[r], sog[r])
    spike = np.zeros(len(r), dtype=bool)
    free = np.flatnonzero(~stuck)
    spike[free], pace = position_spikes(key[r][free], t[r][free], lon[r][free], lat[r][free])
    pace_all = np.full(len(r), PACE_KN * KNOT)
    pace_all[free] = pace
    return {"mmsi": mmsi, "bucket": bucket, "key": key, "t": t, "lon": lon, "lat": lat, "sog": sog, "no": no, "rep": rep, "k": k, "r": r, "stuck": stuck, "spike": spike, "pace": pace_all}


def judge(table: pa.Table) -> pa.Table:
    """Row ids of a block's own rows with an implausible reading, and the fault of each field."""
    c = clean_track(table)
    key, t, lon, lat, sog, no, r = (c[x] for x in ("key", "t", "lon", "lat", "sog", "no", "r"))
    n = len(t)
    gk, gt, glo, gla = key[r], t[r], lon[r], lat[r]
    good = ~c["stuck"] & ~c["spike"]
    has_lon, has_lat = ~np.isnan(lon) & (lon != 181), ~np.isnan(lat) & (lat != 91)
    impossible = (has_lon & (np.abs(lon) > 180)) | (has_lat & (np.abs(lat) > 90)) | (sog < 0) | (sog > 102.3)
    # positions: every row against the trusted instants around it
    before, after = between(gk, gt, glo, gla, good, key, t)
    usable = (np.abs(lon) <= 180) & (np.abs(lat) <= 90)
    state = np.full(int(no[-1]) + 1, -1) if n else np.zeros(0, int)
    state[c["k"]] = np.arange(len(r))
    own = state[no]  # judged instant of each row, -1 if none
    off = np.zeros(n, dtype=bool)
    same = np.zeros(n, dtype=bool)
    i = np.flatnonzero(usable & (own >= 0))
    same[i] = distance(lon[i], lat[i], glo[own[i]], gla[own[i]]) < 50
    spike_row = same & (own >= 0) & c["spike"][np.maximum(own, 0)] if len(r) else same
    stuck_row = same & (own >= 0) & c["stuck"][np.maximum(own, 0)] if len(r) else same
    # rows that differ from the instant's position, and rows with one coordinate only
    i = np.flatnonzero((usable & ~same) | ((has_lon ^ has_lat) & ~impossible))
    i = i[(before[i] >= 0) & (after[i] >= 0)]
    if len(i):
        a, b = before[i], after[i]
        share = (t[i] - gt[a]) / np.maximum(gt[b] - gt[a], 1)
        plo = glo[a] + ((glo[b] - glo[a] + 180) % 360 - 180) * share
        pla = gla[a] + (gla[b] - gla[a]) * share
        allow = np.minimum(t[i] - gt[a], gt[b] - t[i]) * c["pace"][a] + SLACK_M
        olo, ola = np.where(has_lon[i], lon[i], plo), np.where(has_lat[i], lat[i], pla)
        off[i] = distance(olo, ola, plo, pla) > allow
    # speeds: against what trusted positions and neighbouring speeds say
    out_sog = judge_speed(c, good)
    flag = impossible | off | spike_row | stuck_row | out_sog
    rows = as_numpy(table["row_id"])
    mine = as_numpy(table["own"]) & flag
    kind = np.where(impossible, "impossible", np.where(spike_row | off, "position_spike", np.where(stuck_row, "position_stuck", "speed")))
    return pa.table({"row_id": pa.array(rows[mine]), "fault": pa.array(kind[mine].tolist(), pa.string())})


def judge_speed(c: dict, good: np.ndarray) -> np.ndarray:
    """Rows whose speed over ground is a spike or stuck."""
    key, t, sog, no, r, lon, lat = (c[x] for x in ("key", "t", "sog", "no", "r", "lon", "lat"))
    n = len(t)
    out = np.zeros(n, dtype=bool)
    valid = (sog >= 0) & (sog < 102.3)
    first = np.full(int(no[-1]) + 1 if n else 0, n, dtype=np.int64)
    i = np.flatnonzero(valid)
    np.minimum.at(first, no[i], i)
    s = first[first < n]  # the row that gives each instant's speed
    if not len(s):
        return out
    sk, st, sv = key[s], t[s], sog[s]
    gk, gt, glo, gla = key[r], t[r], lon[r], lat[r]
    before, after = between(gk, gt, glo, gla, good, sk, st)
    # the own position, where trusted
    at = np.full(len(s), -1)
    pos = np.full(int(no[-1]) + 1, -1)
    pos[c["k"]] = np.where(good, np.arange(len(r)), -1)
    at = pos[no[s]]
    speed_in = np.full(len(s), np.nan)
    speed_out = np.full(len(s), np.nan)
    for a, b, into in ((before, np.where(at >= 0, at, after), speed_in), (np.where(at >= 0, at, before), after, speed_out)):
        ok = (a >= 0) & (b >= 0)
        dt = np.where(ok, gt[b] - gt[a], 1)
        ok &= (dt > 0) & (dt <= 3600)
        d = distance(glo[a], gla[a], glo[b], gla[b])
        into[ok] = (d / np.maximum(dt, 1) / KNOT)[ok]
    low, high = np.fmin(speed_in, speed_out), np.fmax(speed_in, speed_out)
    gap = np.maximum(np.maximum(sv - high, low - sv), 0)
    known = ~np.isnan(gap)
    bad = np.zeros(len(s), dtype=bool)
    left = np.arange(len(s))
    while len(left) >= 3:
        g = np.cumsum(key_change([sk[left]])) - 1
        v = sv[left]
        nb = neighbours(g, 3)
        around = np.where(nb >= 0, v[nb], np.nan)
        cand = ellipsoid(g, v, 0.5)
        mid = np.nanmedian(np.concatenate([around, v[:, None]], axis=1), axis=1)
        lone = np.abs(v - mid) > SOG_TOL + 0.25 * mid
        tol = SOG_TOL + 0.25 * np.nan_to_num(high[left])
        hit = cand & np.where(known[left], gap[left] > tol, lone & (np.abs(v - mid) > 10))
        if not hit.any():
            break
        bad[left[hit]] = True
        left = left[np.isin(g, g[hit])]
        left = left[~bad[left]]
    # stuck: a run of one value which the track's pace contradicts
    run, size = runs(sk, sv)
    start = np.flatnonzero(key_change([run]))
    pace = np.where(np.isnan(speed_in), speed_out, np.where(np.isnan(speed_out), speed_in, (speed_in + speed_out) / 2))
    for k in np.flatnonzero(np.bincount(run) >= 5):
        a = start[k]
        b = a + size[a]
        p = pace[a:b]
        p = p[~np.isnan(p)]
        if not len(p) or bad[a:b].any():
            continue
        v = sv[a]
        i0, i1 = before[a] if at[a] < 0 else at[a], after[b - 1] if at[b - 1] < 0 else at[b - 1]
        if i0 < 0 or i1 <= i0:
            continue
        # the way made good over the whole run: noise of positions at rest does not add up in it
        made = distance(glo[i0], gla[i0], glo[i1], gla[i1])
        net = made / max(1, gt[i1] - gt[i0]) / KNOT
        off = abs(net - v) > 1.0 + 0.08 * max(v, 1.0)
        if v > 1.5:
            if b - a >= 7 or (off and (np.abs(p - v) > 0.8 + 0.08 * v).mean() > 0.3):
                bad[a + 1 : b] = True
        elif off and made > 600 and np.median(p) > v + 1.5:
            bad[a + 1 : b] = True
    # each row of an instant with that value shares the verdict; other values of the instant are judged by the track
    verdict = np.zeros(int(no[-1]) + 1, dtype=bool)
    value = np.full(int(no[-1]) + 1, np.nan)
    lo_all, hi_all = np.full(len(verdict), np.nan), np.full(len(verdict), np.nan)
    verdict[no[s]], value[no[s]] = bad, sv
    lo_all[no[s]], hi_all[no[s]] = low, high
    same = valid & (np.abs(sog - value[no]) < 0.05)
    out |= same & verdict[no]
    other = valid & ~same
    gap_row = np.maximum(sog - hi_all[no], lo_all[no] - sog)
    out |= other & (gap_row > SOG_TOL + 0.25 * np.nan_to_num(hi_all[no]))
    return out


def day_chunks(df: DataFrame, *extra: str) -> DataFrame:
    """Rows with (mmsi, bucket = UTC day); rows near midnight also go to the neighbouring day, with own = false."""
    t = seconds(F.col("time"))
    base = df.where(valid_mmsi(F.col("mmsi")) & F.col("time").isNotNull()).select(
        "row_id", "mmsi", t.alias("t"), "longitude", "latitude", "sog", F.col("received").cast("long").alias("rank"), *extra
    )
    day = F.floor(F.col("t") / DAY).cast("long")
    into = F.col("t") - day * DAY
    days = F.array_compact(F.array(day, F.when(into < MARGIN, day - 1), F.when(into >= DAY - MARGIN, day + 1)))
    return base.withColumn("bucket", F.explode(days)).withColumn("own", F.col("bucket") == day)


def implausible_reports(df: DataFrame) -> DataFrame:
    """(row_id, fault) of reports with an implausible sog, longitude or latitude.

    ``df`` needs row_id, mmsi, time, longitude, latitude, sog, received; further
    columns are ignored.  Rows with an invalid or null mmsi or null time are not
    judged; null and not-available values are never faults; repeated deliveries
    get the same verdict row by row; vessels with fewer than three instants are
    only checked against the bounds.  An empty table gives no rows.
    """
    return grouped_blocks(day_chunks(df), ["mmsi", "bucket"], ["t", "rank", "row_id"], judge, "row_id long, fault string")


def p1_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/ais_dynamic.parquet")
    return implausible_reports(d).select("row_id")
