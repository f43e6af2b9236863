"""Other scalar functions of the toolkit as expressions and plain Python helpers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(dt: datetime) -> int:
    """Epoch seconds; a naive datetime is UTC."""
    return int((dt if dt.tzinfo else dt.replace(tzinfo=timezone.utc)).timestamp())


def from_epoch(t: float) -> datetime:
    return datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)


def iso8601(dt: datetime) -> str:
    return dt.strftime("%Y-%m-%dT%H:%M:%S.000000000")


def months_between(start: datetime, end: datetime) -> list[str]:
    """All yyyyMM that hold a moment of [start, end]."""
    if start > end:
        raise ValueError("start is after end")
    y, m, out = start.year, start.month, []
    while (y, m) <= (end.year, end.month):
        out.append(f"{y}{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def seconds_of(delta: timedelta | int | float) -> int:
    return int(delta.total_seconds()) if isinstance(delta, timedelta) else int(delta)


def month_key(time: Column) -> Column:
    """yyyyMM of epoch seconds, UTC."""
    return F.date_format(F.timestamp_seconds(time), "yyyyMM")


def sanitize(text: Column) -> Column:
    """Text for a CSV cell: null and '-' are empty; separators, quotes and line ends go."""
    return F.when(text.isNull() | (text == "-"), "").otherwise(F.translate(text.cast("string"), ",\u0082#\"'\n", ""))


def zone_number(name: Column) -> Column:
    """Digits of a zone's name as a number; null if it has none."""
    return F.regexp_replace(name, "[^0-9]", "").try_cast("bigint")


def round_floats(x: Column, precision: float = 1e-4) -> Column:
    """Multiples of 1 / round(1 / precision)."""
    m = float(round(1 / precision))
    return F.round(x * m) / m


def first_at_least(axis: Sequence[float], x: Column) -> Column:
    """Index of the first axis value >= x, held within the axis; a falling axis is searched from its end; -1 if empty.

    The axis is a literal of bounded length (a raster's or cube's own axis).
    """
    n = len(axis)
    if n == 0:
        return F.lit(-1)
    up = axis[0] <= axis[-1]
    values = F.lit([float(v) for v in axis])
    before = F.size(F.filter(values, lambda a: a < x if up else a > x))
    return F.least(before, F.lit(n - 1))


def cell_index(x: Column, x0: float, dx: float, n: int) -> Column:
    """The same on a regular axis x0, x0 + dx, ..., without any search."""
    return F.least(F.greatest(F.ceil((x - x0) / dx), F.lit(0)), F.lit(n - 1)).cast("int")


def nearest_index(axis: Sequence[float], x: Column) -> Column:
    """Index of the nearest value of a rising axis; halfway goes to the lower one."""
    values = F.lit([float(v) for v in axis])
    mids = F.lit([(a + b) / 2 for a, b in zip(axis[:-1], axis[1:])]) if len(axis) > 1 else None
    return F.lit(0) if mids is None else F.least(F.size(F.filter(mids, lambda m: m < x)), F.size(values) - 1)


# Coefficient and exponent of the wetted-surface power law by class of vessel.
SURFACE = {
    "fishing": (15.58, 0.602),
    "tug": (19.36, 0.553),
    "passenger": (14.64, 0.671),
    "container": (5.39, 0.698),
    "bulk": (9.57, 0.63),
    "cargo": (14.24, 0.596),
    "gas": (5.41, 0.699),
    "tanker": (9.56, 0.63),
    "other": (26.2, 0.551),
}


def wetted_surface(dwt: Column, ship_type: Column, generic: Column | None = None, detail: Column | None = None) -> Column:
    """Wetted hull surface in square metres from deadweight; the registry's generic type goes before the code."""
    known = generic.isNotNull() if generic is not None else F.lit(False)
    name = F.coalesce(generic, F.lit("")) if generic is not None else F.lit("")
    extra = F.when(known, F.coalesce(detail, F.lit(""))).otherwise("") if detail is not None else F.lit("")
    code = F.when(~known, F.coalesce(ship_type, F.lit(0)))
    between = lambda a, b: F.coalesce(code.between(a, b), F.lit(False))
    law = lambda k: F.lit(SURFACE[k][0]) * F.pow(F.coalesce(dwt, F.lit(0)).cast("double"), F.lit(SURFACE[k][1]))
    tanker = name.contains("Tanker")
    return (
        F.when(F.coalesce(code < 30, F.lit(False)) | (name == "Wing In Grnd"), F.lit(0.0))
        .when(between(30, 30) | (name == "Fishing"), law("fishing"))
        .when(between(52, 53) | (name == "Tug"), law("tug"))
        .when(between(60, 69) | (name == "Passenger"), law("passenger"))
        .when(extra.contains("Container"), law("container"))
        .when(extra.contains("Bulk") | extra.contains("Cement"), law("bulk"))
        .when(between(70, 79) | name.contains("Cargo"), law("cargo"))
        .when(between(84, 84) | (tanker & (extra.contains("Oil") | extra.contains("LNG") | extra.contains("LPG"))), law("gas"))
        .when(between(80, 89) | tanker, law("tanker"))
        .otherwise(law("other"))
    )


# Codes of ship types with their texts, as they are stored.
COARSE_TYPES = """
20 Wing In Grnd
21 Wing In Grnd, hazardous category A
22 Wing In Grnd, hazardous category B
23 Wing In Grnd, hazardous category C
24 Wing In Grnd, hazardous category D
25 Wing In Grnd
26 Wing In Grnd
27 Wing In Grnd
28 Wing In Grnd
29 Wing In Grnd
30 Fishing
31 Towing
32 Towing - length >200m or breadth >25m
33 Dredger
34 Dive Vessel
35 Military Ops
36 Sailing Vessel
37 Pleasure Craft
38 Reserved for future use
39 Reserved for future use
40 High speed craft
41 High speed craft, hazardous category A
42 High speed craft, hazardous category B
43 High speed craft, hazardous category C
44 High speed craft, hazardous category D
45 High speed craft
46 High speed craft
47 High speed craft
48 High speed craft
49 High speed craft
50 Pilot vessel
51 SAR
52 Tug
53 Port Tender
54 Anti-Pollution
55 Law Enforce
56 Spare - local vessels
57 Spare - local vessels
58 Medical Trans)
59 Ships and aircraft of States not parties to an armed conflict
60 Passenger
61 Passenger, hazardous category A
62 Passenger, hazardous category B
63 Passenger, hazardous category C
64 Passenger, hazardous category D
65 Passenger
66 Passenger
67 Passenger
68 Passenger
69 Passenger
70 Cargo
71 Cargo, hazardous category A
72 Cargo, hazardous category B
73 Cargo, hazardous category C
74 Cargo, hazardous category D
75 Cargo
76 Cargo
77 Cargo
78 Cargo
79 Cargo
80 Tanker
81 Tanker, hazardous category A
82 Tanker, hazardous category B
83 Tanker, hazardous category C
84 Tanker, hazardous category D
85 Tanker
86 Tanker
87 Tanker
88 Tanker
89 Tanker
90 Other
91 Other, hazardous category A
92 Other, hazardous category B
93 Other, hazardous category C
94 Other, hazardous category D
95 Other
96 Other
97 Other
98 Other
99 Other
100 Unknown
"""


def coarse_types() -> list[tuple[int, str]]:
    """Codes 20 to 100 with their class of vessel."""
    lines = (line.partition(" ") for line in COARSE_TYPES.strip().splitlines())
    return [(int(code), text) for code, _, text in lines]
