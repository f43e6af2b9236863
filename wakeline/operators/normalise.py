"""Shared normalisations of report columns, as Spark expressions.

Null in gives null out everywhere in this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch values at or beyond this are milliseconds (seconds would be the year 5138).
MILLIS_FROM = 100_000_000_000
#: Range of vessel identifiers: first country prefix to the last one.
MMSI_FROM, MMSI_TO = 201_000_000, 776_000_000


def seconds(time: Column) -> Column:
    """Epoch seconds; values in milliseconds are cut to whole seconds."""
    return F.when(time >= MILLIS_FROM, F.floor(time / 1000).cast("long")).otherwise(time.cast("long"))


def feed(source: Column) -> Column:
    """Feed name without regard to letter case, spaces, hyphens and underscores."""
    return F.translate(F.lower(source), " -_", "")


def valid_mmsi(mmsi: Column) -> Column:
    return (mmsi >= MMSI_FROM) & (mmsi < MMSI_TO)


def usable_position(mmsi: Column, lon: Column, lat: Column) -> Column:
    """Valid identifier and a position on the globe; NaN and null fail."""
    return valid_mmsi(mmsi) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
