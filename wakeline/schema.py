"""Stored tables and the columns that are constant along a track."""

from __future__ import annotations

# Names and types of the stored columns.
DYNAMIC = "mmsi long, time long, longitude double, latitude double, rot double, sog double, cog double, heading double, maneuver boolean, utc_second int, source string"
STATIC = (
    "mmsi long, time long, vessel_name string, ship_type int, call_sign string, imo long, dim_bow int, dim_stern int, dim_port int, dim_star int, "
    "draught int, destination string, ais_version int, fixing_device string, eta_month int, eta_day int, eta_hour int, eta_minute int, source string"
)
REGISTRY = (
    "mmsi long, imo long, name string, vesseltype_generic string, vesseltype_detailed string, callsign string, flag string, gross_tonnage long, "
    "summer_dwt long, length_breadth string, year_built int, home_port string, error404 int"
)
#: Columns of the static aggregate, besides mmsi.
AGGREGATED = (
    "imo", "vessel_name", "ship_type", "call_sign", "dim_bow", "dim_stern", "dim_port", "dim_star", "draught", "destination", "eta_month", "eta_day", "eta_hour", "eta_minute",
)
#: Keys by which a repeated row is the same row, by flavour of the store.
DYNAMIC_KEY = {"strict": ("mmsi", "time", "longitude", "latitude", "sog", "cog", "source"), "position": ("mmsi", "time", "longitude", "latitude")}
STATIC_KEY = {"strict": ("mmsi", "time", "imo", "source"), "time": ("mmsi", "time")}
