"""Reports as AIS sentences: the way back from stored rows to lines that can be read again.

Fields become strings of bits, six of which make a character of the payload; all of
it is Spark expressions.  Values beyond a field's range are held at its ends, null is
the field's not-available value (zero where it has none).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.sources.nmea import SIXBIT


def unsigned(value: Column | int, length: int) -> Column:
    if isinstance(value, int):
        return F.lit(format(value, f"0{length}b"))
    v = F.coalesce(value.cast("long"), F.lit(0))
    return F.lpad(F.bin(F.least(F.greatest(v, F.lit(0)), F.lit((1 << length) - 1))), length, "0")


def signed(value: Column, length: int) -> Column:
    half = 1 << (length - 1)
    v = F.least(F.greatest(value.cast("long"), F.lit(-half)), F.lit(half - 1))
    return unsigned(F.when(v < 0, v + 2 * half).otherwise(v), length)


def letters(value: Column, chars: int) -> Column:
    """Six-bit text, filled up with '@'; characters it does not know are '@' too and so end it."""
    text = F.upper(F.coalesce(value, F.lit("")))
    one = lambda i: F.greatest(F.position(F.substring(text, i, F.lit(1)), F.lit(SIXBIT)) - 1, F.lit(0))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(chars)), lambda i: F.lpad(F.bin(one(i).cast("long")), 6, "0")), "")


def payload(*fields: Column) -> Column:
    """Characters of the fields' bits, filled up with zeros to whole characters."""
    def packed(bits: Column) -> Column:
        six = lambda k: F.conv(F.rpad(F.substring(bits, k * 6 + 1, F.lit(6)), 6, "0"), 2, 10).cast("int")
        steps = F.sequence(F.lit(0), (F.ceil(F.length(bits) / 6) - 1).cast("int"))
        codes = F.transform(steps, six)
        return F.array_join(F.transform(codes, lambda v: F.when(v < 40, F.char(v + 48)).otherwise(F.char(v + 56))), "")

    # the bits are an element of an array so that they are made once, not for every character
    return F.element_at(F.transform(F.array(F.concat(*fields)), packed), 1)


def sentence(payload: Column, total: int = 1, no: int = 1, seq: Column | None = None, channel: str = "A") -> Column:
    body = F.concat_ws(",", F.lit("AIVDM"), F.lit(str(total)), F.lit(str(no)), F.lit("") if seq is None else seq.cast("string"), F.lit(channel), payload, F.lit("0"))
    check = F.aggregate(F.filter(F.split(body, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc.bitwiseXOR(F.ascii(c)))
    return F.concat(F.lit("!"), body, F.lit("*"), F.lpad(F.hex(check), 2, "0"))


def tagged(sentence: Column, time: Column, station: str = "base") -> Column:
    """The sentence behind a tag block with its time (seconds or milliseconds)."""
    return F.concat(F.lit(f"\\s:{station},c:"), time.cast("string"), F.lit("*00\\"), sentence)


def scaled(value: Column, factor: float, gone: int) -> Column:
    """A measurement in units of the field; null is the field's not-available value."""
    return F.coalesce(F.floor(value * factor + 0.5).cast("long"), F.lit(gone))


def position_payload(kind: int, mmsi: Column, lon: Column, lat: Column, sog: Column, cog: Column, heading: Column, second: Column, rot: Column | None = None, maneuver: Column | None = None) -> Column:
    """Payload of a position report of type 1, 18, 19 or 27."""
    head = [unsigned(kind, 6), unsigned(0, 2), unsigned(mmsi, 30)]
    if kind == 27:
        return payload(
            *head, unsigned(0, 6), signed(scaled(lon, 600, 108_600), 18), signed(scaled(lat, 600, 54_600), 17), unsigned(scaled(sog, 1, 63), 6), unsigned(scaled(cog, 1, 511), 9), unsigned(0, 2)
        )
    place = [signed(scaled(lon, 600_000, 108_600_000), 28), signed(scaled(lat, 600_000, 54_600_000), 27), unsigned(scaled(cog, 10, 3600), 12), unsigned(scaled(heading, 1, 511), 9)]
    tail = unsigned(F.coalesce(second.cast("long"), F.lit(60)), 6)
    speed = unsigned(scaled(sog, 10, 1023), 10)
    if kind == 1:
        turn = F.when(rot.isNull(), -128).otherwise(F.signum(rot) * F.floor(F.sqrt(F.abs(rot)) * 4.733 + 0.5)) if rot is not None else F.lit(-128)
        swing = F.when(maneuver, 2).when(~maneuver, 1).otherwise(0) if maneuver is not None else F.lit(0)
        return payload(*head, unsigned(0, 4), signed(turn, 8), speed, unsigned(0, 1), *place, tail, unsigned(swing, 2), unsigned(0, 23))
    if kind not in (18, 19):
        raise ValueError("position reports have type 1, 18, 19 or 27")
    return payload(*head, unsigned(0, 8), speed, unsigned(0, 1), *place, tail, unsigned(0, 29 if kind == 18 else 173))


def voyage_payload(mmsi: Column, imo: Column, call_sign: Column, name: Column, ship_type: Column, sides: list[Column], eta: list[Column], draught: Column, destination: Column, version: Column) -> Column:
    """Payload of a voyage report (type 5); ``sides``: bow, stern, port, starboard; ``eta``: month, day, hour, minute."""
    return payload(
        unsigned(5, 6), unsigned(0, 2), unsigned(mmsi, 30), unsigned(version, 2), unsigned(imo, 30), letters(call_sign, 7), letters(name, 20), unsigned(ship_type, 8),
        *[unsigned(s, n) for s, n in zip(sides, (9, 9, 6, 6))], unsigned(0, 4), *[unsigned(e, n) for e, n in zip(eta, (4, 5, 5, 6))], unsigned(draught, 8), letters(destination, 20), unsigned(0, 2),
    )


def class_b_payloads(mmsi: Column, name: Column, ship_type: Column, call_sign: Column, sides: list[Column], maker: Column) -> tuple[Column, Column]:
    """Payloads of parts A and B of a class B identity report (type 24)."""
    head = [unsigned(24, 6), unsigned(0, 2), unsigned(mmsi, 30)]
    a = payload(*head, unsigned(0, 2), letters(name, 20), unsigned(0, 8))
    b = payload(*head, unsigned(1, 2), unsigned(ship_type, 8), letters(maker, 3), unsigned(0, 24), letters(call_sign, 7), *[unsigned(s, n) for s, n in zip(sides, (9, 9, 6, 6))], unsigned(0, 6))
    return a, b
