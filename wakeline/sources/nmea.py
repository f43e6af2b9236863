"""Raw AIS sentences: headers, pre-filter, reassembly of fragments, and the payload as fields.

Everything is Spark expressions: a payload becomes an array of six-bit numbers,
and a field is arithmetic on the few numbers it touches.  The same expressions
serve batch and streaming.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EARLIEST = 946_731_600  # no report is older than this
# Six-bit characters in order of their codes.
SIXBIT = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&'()*+,-./0123456789:;<=>?"
DYNAMIC_TYPES, STATIC_TYPES = (1, 2, 3, 18, 19, 27), (5, 24)
SKIPPED_HEADS = (";", "I", "J")


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of text files (gzip too) with their file and order: line, file, n."""
    return spark.read.text(paths).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")
    )


def _epoch_of(digits: Column, now: int) -> Column:
    """Epoch seconds of 10 digits, or of more that are cut to 10; null if not plausible."""
    n = F.length(digits)
    e = F.when(digits.rlike("^[0-9]{10}$"), digits.try_cast("bigint")).when(
        digits.rlike("^[0-9]{11,18}$"), F.floor(digits.try_cast("bigint") / F.pow(F.lit(10.0), (n - 10).cast("double"))).cast("bigint")
    )
    return F.when((e >= EARLIEST) & (e <= now), e)


def nm4_header(line: Column, now: int | None = None) -> tuple[Column, Column]:
    """(epoch, sentence) of a line with a tag block; epoch is null where no c: tag is valid, the last valid one counts."""
    now = int(datetime.now(timezone.utc).timestamp()) if now is None else now
    sentence = F.substring_index(line, "\\", -1)
    block = F.regexp_extract(line, r"^(.*)\\", 1)
    tags = F.transform(F.split(block, ","), lambda t: F.substring_index(t, "*", 1))
    values = F.transform(
        F.filter(tags, lambda t: (F.length(t) > 3) & t.contains("c:")),
        lambda t: F.coalesce(
            _epoch_of(F.substring(t, 3, 100), now), _epoch_of(F.substring(t, 4, 100), now), _epoch_of(F.substring_index(F.substring(t, 3, 100), " ", 1), now)
        ),
    )
    good = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(good) > 0, F.element_at(good, -1)), sentence


def nmea_header(line: Column) -> tuple[Column, Column]:
    """(epoch, sentence) of a bare sentence: the first field after the checksum above a billion, else 0; null if it does not start with '!'."""
    rest = F.split(F.when(F.instr(line, "*") > 0, F.regexp_extract(line, r"\*(.*)$", 1)).otherwise(""), ",")
    numbers = F.filter(F.transform(rest, lambda v: v.try_cast("int")), lambda v: v > 1_000_000_000)
    e = F.when(F.size(numbers) > 0, F.element_at(numbers, 1)).otherwise(0).cast("bigint")
    return F.when(line.startswith("!"), e), line


def worth_decoding(sentence: Column) -> Column:
    """False for payloads of two characters or less and single-fragment messages of unused types; odd sentences pass."""
    f = F.split(sentence, ",")
    at = lambda i: F.try_element_at(f, F.lit(i))
    payload = F.coalesce(at(6), F.lit(""))
    unused = (at(2) == "1") & F.substring(payload, 1, 1).isin(*SKIPPED_HEADS)
    return (F.size(f) < 6) | ((F.length(payload) > 2) & ~F.coalesce(unused, F.lit(False)))


def parsed(lines: DataFrame, now: int | None = None) -> DataFrame:
    """file, n, time, total, no, seq, channel, payload of every usable sentence; both kinds of lines are told apart by the tag block."""
    tagged = F.col("line").contains("\\")
    e4, s4 = nm4_header(F.col("line"), now)
    eb, sb = nmea_header(F.col("line"))
    x = lines.select("file", "n", F.when(tagged, e4).otherwise(eb).alias("time"), F.when(tagged, s4).otherwise(sb).alias("s")).where(F.col("time").isNotNull())
    x = x.where(F.col("s").rlike(r"^[!$]..VD[MO],[1-9],[1-9],") & worth_decoding(F.col("s")))
    f = F.split("s", ",")
    return x.select(
        "file", "n", "time", F.try_element_at(f, F.lit(2)).try_cast("int").alias("total"), F.try_element_at(f, F.lit(3)).try_cast("int").alias("no"), F.try_element_at(f, F.lit(4)).alias("seq"),
        F.try_element_at(f, F.lit(5)).alias("channel"), F.try_element_at(f, F.lit(6)).alias("payload"),
    ).where("no <= total")


def reassembled(sentences: DataFrame) -> DataFrame:
    """file, n, time, payload of whole messages.

    Fragments of one file, sequence id, channel and count belong together from one
    first fragment to the next; a message lacks none of its parts.  Single
    sentences, nearly all, pass by without a shuffle.
    """
    single = sentences.where("total = 1").select("file", "n", "time", "payload")
    parts = sentences.where("total > 1")
    w = Window.partitionBy("file", "seq", "channel", "total").orderBy("n")
    x = parts.withColumn("_run", F.sum((F.col("no") == 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("file", "seq", "channel", "total", "_run").agg(
        F.array_sort(F.collect_set(F.struct("no", "payload"))).alias("p"), F.min("n").alias("n"), F.max_by("time", "no").alias("time"), F.countDistinct("no").alias("k")
    )
    whole = g.where((F.col("k") == F.col("total")) & (F.size("p") == F.col("total")) & (F.col("_run") > 0))
    return single.unionByName(whole.select("file", "n", "time", F.array_join("p.payload", "").alias("payload")))


def numbers(payload: Column) -> Column:
    """Six-bit numbers of a payload."""
    v = lambda c: F.ascii(c) - 48
    return F.transform(F.split(payload, ""), lambda c: F.when(v(c) > 40, v(c) - 8).otherwise(v(c)).cast("long"))


def bits(v: Column, start: int, length: int, signed: bool = False) -> Column:
    """Unsigned or two's-complement number of ``length`` bits (at most 48) from bit ``start``; null beyond the payload's end."""
    a, b = start // 6, (start + length - 1) // 6
    total = F.lit(0).cast("long")
    for k in range(a, b + 1):
        total = total * 64 + F.get(v, F.lit(k))
    over = (b + 1) * 6 - (start + length)
    out = F.shiftright(total, over).bitwiseAND(F.lit((1 << length) - 1)) if over else total.bitwiseAND(F.lit((1 << length) - 1))
    return F.when(out >= (1 << (length - 1)), out - (1 << length)).otherwise(out) if signed else out


def sixbit_text(v: Column, start: int, chars: int) -> Column:
    """Text of six-bit characters up to the first '@', trimmed; characters beyond the payload's end are left out."""
    letters = [F.coalesce(F.substring(F.lit(SIXBIT), (bits(v, start + 6 * k, 6) + 1).cast("int"), 1), F.lit("")) for k in range(chars)]
    return F.trim(F.substring_index(F.concat(*letters), "@", 1))


def decoded(messages: DataFrame) -> DataFrame:
    """Messages with msg_type, mmsi and the payload's numbers ``v``; only types that are used."""
    first = F.ascii("payload") - 48
    kind = F.when(first > 40, first - 8).otherwise(first)
    # the type is the first character, and mmsi ends in the seventh: both are known without unpacking the rest
    x = messages.where(kind.isin(*DYNAMIC_TYPES, *STATIC_TYPES) & (F.length("payload") >= 7)).withColumn("msg_type", kind.cast("int"))
    x = x.withColumn("v", numbers(F.col("payload")))
    return x.withColumn("mmsi", bits(F.col("v"), 8, 30))


def dynamic_rows(messages: DataFrame, source: str, keep_nulls: bool = False) -> DataFrame:
    """Position reports as rows of the dynamic table; not-available values are null, and zero unless ``keep_nulls``."""
    m = decoded(messages).where(F.col("msg_type").isin(*DYNAMIC_TYPES))
    v, t = F.col("v"), F.col("msg_type")
    a, b, long_range = t.isin(1, 2, 3), t.isin(18, 19), t == 27

    def pick(fa, fb, fc):
        return F.when(a, fa).when(b, fb).when(long_range, fc) if fc is not None else F.when(a, fa).when(b, fb)

    na = lambda c, gone, scale: F.when(c != gone, c / scale)
    lon = pick(na(bits(v, 61, 28, True), 108_600_000, 600_000.0), na(bits(v, 57, 28, True), 108_600_000, 600_000.0), na(bits(v, 44, 18, True), 108_600, 600.0))
    lat = pick(na(bits(v, 89, 27, True), 54_600_000, 600_000.0), na(bits(v, 85, 27, True), 54_600_000, 600_000.0), na(bits(v, 62, 17, True), 54_600, 600.0))
    sog = pick(na(bits(v, 50, 10), 1023, 10.0), na(bits(v, 46, 10), 1023, 10.0), na(bits(v, 79, 6), 63, 1.0))
    cog = pick(na(bits(v, 116, 12), 3600, 10.0), na(bits(v, 112, 12), 3600, 10.0), na(bits(v, 85, 9), 511, 1.0))
    heading = pick(na(bits(v, 128, 9), 511, 1.0), na(bits(v, 124, 9), 511, 1.0), None)
    r = bits(v, 42, 8, True)
    rot = F.when(a & (r != -128), F.signum(r) * F.pow(r / 4.733, F.lit(2.0)))
    second = pick(bits(v, 137, 6), bits(v, 133, 6), None)
    out = m.select(
        "mmsi", F.col("time").cast("long").alias("time"), lon.alias("longitude"), lat.alias("latitude"), rot.alias("rot"), sog.alias("sog"), cog.alias("cog"), heading.alias("heading"),
        F.when(a, bits(v, 143, 2) == 2).alias("maneuver"), F.when(second < 60, second).cast("int").alias("utc_second"), F.lit(source).alias("source"),
    )
    return out if keep_nulls else without_nulls(out)


def static_rows(messages: DataFrame, source: str, keep_nulls: bool = False) -> DataFrame:
    """Identity reports as rows of the static table; parts A and B of type 24 are rows of their own."""
    m = decoded(messages).where(F.col("msg_type").isin(*STATIC_TYPES))
    v, t = F.col("v"), F.col("msg_type")
    five = t == 5
    part_a, part_b = (t == 24) & (bits(v, 38, 2) == 0), (t == 24) & (bits(v, 38, 2) == 1)
    two = lambda x, y: F.when(five, x).when(part_b, y)
    out = m.where(five | part_a | part_b).select(
        "mmsi", F.col("time").cast("long").alias("time"), F.when(five, sixbit_text(v, 112, 20)).when(part_a, sixbit_text(v, 40, 20)).alias("vessel_name"),
        two(bits(v, 232, 8), bits(v, 40, 8)).cast("int").alias("ship_type"), two(sixbit_text(v, 70, 7), sixbit_text(v, 90, 7)).alias("call_sign"),
        F.when(five, bits(v, 40, 30)).alias("imo"), two(bits(v, 240, 9), bits(v, 132, 9)).cast("int").alias("dim_bow"), two(bits(v, 249, 9), bits(v, 141, 9)).cast("int").alias("dim_stern"),
        two(bits(v, 258, 6), bits(v, 150, 6)).cast("int").alias("dim_port"), two(bits(v, 264, 6), bits(v, 156, 6)).cast("int").alias("dim_star"),
        F.when(five, bits(v, 294, 8)).cast("int").alias("draught"), F.when(five, sixbit_text(v, 302, 20)).alias("destination"), F.when(five, bits(v, 38, 2)).cast("int").alias("ais_version"),
        F.when(part_b, sixbit_text(v, 48, 3)).alias("fixing_device"),
        *[c.alias(n) for n, c in zip(("eta_month", "eta_day", "eta_hour", "eta_minute"), eta(*[F.when(five, bits(v, s, n)).cast("int") for s, n in ((274, 4), (278, 5), (283, 5), (288, 6))]))],
        F.lit(source).alias("source"),
    )
    return out if keep_nulls else without_nulls(out)


def eta(month: Column, day: Column, hour: Column, minute: Column) -> tuple[Column, Column, Column, Column]:
    """Arrival as four numbers; what is no moment of a leap year is (1, 1, 0, 0)."""
    days = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = F.coalesce(month.between(1, 12) & (day >= 1) & (day <= days) & hour.between(0, 23) & minute.between(0, 59), F.lit(False))
    return tuple(F.when(ok, c).otherwise(d).cast("int") for c, d in ((month, 1), (day, 1), (hour, 0), (minute, 0)))


def without_nulls(df: DataFrame) -> DataFrame:
    """Stored rows have no nulls: numbers are 0, texts empty, flags false."""
    zero = {"string": F.lit(""), "boolean": F.lit(False)}
    return df.select(*[F.coalesce(F.col(f.name), zero.get(f.dataType.simpleString(), F.lit(0)).cast(f.dataType)).alias(f.name) for f in df.schema.fields])
