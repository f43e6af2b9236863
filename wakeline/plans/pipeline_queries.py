"""Queries over the vessel tables for the operators of large data sets, with their SQL where it exists."""

from __future__ import annotations

from wakeline.operators import exactly_once, known_at, plausibility, proximity, regularise, stays


def queries() -> dict:
    return {
        "p1_found": plausibility.p1_found,
        "p2_found": known_at.p2_found,
        "p3_found": proximity.p3_found,
        "p4_found": stays.p4_found,
        "p5_found": regularise.p5_found,
        "p5_series": regularise.p5_series,
        "p6_found": exactly_once.p6_found,
    }


def oracle_sql() -> dict:
    return {"p2_found": known_at.P2_SQL, "p3_found": proximity.P3_SQL, "p5_found": regularise.P5_SQL, "p5_series": regularise.P5_SERIES_SQL, "p6_found": exactly_once.P6_SQL}
