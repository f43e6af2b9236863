"""Queries of the way in: whole tables written as sentences and provider files, read back, stored and asked again.

Every row makes the round trip; the SQL says what must come out of the tables alone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators import filters
from wakeline.operators.normalise import seconds, valid_mmsi
from wakeline.plans import query as asked
from wakeline.plans.catalogue import BOX, END, MONTH, START, STATIC, registrar, static, table
from wakeline.plans.shipping import fresh_folder
from wakeline.plans.store import Store
from wakeline.sources import files, nmea, provider_csv, sentences

Q: dict = {}
SQL: dict = {}
query = registrar(Q, SQL)
KINDS = (1, 18, 19, 27)
_SECS = "CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END"


def _reports(spark, d: str) -> DataFrame:
    a = table(spark, d, "ais_dynamic")
    return a.where(valid_mmsi(a.mmsi) & a.time.isNotNull())


def _log(spark, lines: DataFrame) -> DataFrame:
    """The lines written as text files to the shared folder and read as a log."""
    out = fresh_folder(spark, "log")
    lines.repartition("file").sortWithinPartitions("file", "n").select("line").write.text(out)
    return nmea.read_lines(spark, out)


def position_lines(spark, d: str) -> DataFrame:
    """line, file, n: every report as a sentence of type 1, 18, 19 or 27 by its number; times as they are, in seconds or milliseconds."""
    a = _reports(spark, d)
    cols = [F.col(c) for c in ("mmsi", "longitude", "latitude", "sog", "cog", "heading", "utc_second")]
    kind = F.col("row_id") % 4
    p = F.when(kind == 0, sentences.position_payload(1, *cols, F.col("rot"), F.col("maneuver")))
    for k in (1, 2, 3):
        p = p.when(kind == k, sentences.position_payload(KINDS[k], *cols))
    return a.select(sentences.tagged(sentences.sentence(p), F.col("time")).alias("line"), (F.col("row_id") % 64).cast("string").alias("file"), F.col("row_id").alias("n"))


def _positions_sql() -> str:
    raw = lambda c, f: f"CAST(floor({c} * {f} + 0.5) AS BIGINT)"
    wide = {"longitude": ("600000", -(1 << 27), (1 << 27) - 1, 108_600_000, "600000e0"), "latitude": ("600000", -(1 << 26), (1 << 26) - 1, 54_600_000, "600000e0"), "sog": ("10", 0, 1023, 1023, "10e0"), "cog": ("10", 0, 4095, 3600, "10e0"), "heading": ("1", 0, 511, 511, "1e0")}
    far = {"longitude": ("600", -(1 << 17), (1 << 17) - 1, 108_600, "600e0"), "latitude": ("600", -(1 << 16), (1 << 16) - 1, 54_600, "600e0"), "sog": ("1", 0, 63, 63, "1e0"), "cog": ("1", 0, 511, 511, "1e0")}

    def both(c: str) -> str:
        cases = []
        for spec, when in ((far.get(c), "k = 3"), (wide[c], "k <> 3")):
            if spec is None:
                cases.append(f"WHEN {when} THEN NULL")
                continue
            f, low, high, gone, scale = spec
            v = f"least(greatest({raw(c, f)}, {low}), {high})"
            cases.append(f"WHEN {when} THEN CASE WHEN {c} IS NULL OR {v} = {gone} THEN NULL ELSE {v} / {scale} END")
        return f"CASE {' '.join(cases)} END"

    turn = "sign(rot) * least(greatest(floor(sqrt(abs(rot)) * 4.733e0 + 0.5), -128), 127)"
    return f"""WITH r AS (SELECT *, row_id % 4 AS k, {_SECS} AS secs FROM ais_dynamic WHERE mmsi >= 201000000 AND mmsi < 776000000 AND time IS NOT NULL)
SELECT mmsi, secs AS time, {both('longitude')} AS longitude, {both('latitude')} AS latitude, round(CASE WHEN k = 0 AND rot IS NOT NULL THEN sign(rot) * power(({turn}) / 4.733e0, 2) END, 6) + 0 AS rot, {both('sog')} AS sog, {both('cog')} AS cog, {both('heading')} AS heading,
  CASE WHEN k = 0 THEN coalesce(maneuver, false) END AS maneuver, CASE WHEN k <> 3 AND utc_second < 60 THEN CAST(utc_second AS INTEGER) END AS utc_second FROM r"""


@query(_positions_sql())
def ais_positions(spark, d):
    """Headers, pre-filter and payloads of position reports of types 1, 18, 19 and 27."""
    m = nmea.reassembled(nmea.parsed(_log(spark, position_lines(spark, d))))
    return nmea.dynamic_rows(m, "x", keep_nulls=True).drop("source").withColumn("rot", F.round("rot", 6) + F.lit(0.0))


def voyage_lines(spark, d: str) -> DataFrame:
    """line, file, n: identity reports; even numbers as type 5 in two fragments, odd ones as both parts of type 24."""
    s = table(spark, d, "ais_static").where(F.col("time").isNotNull())
    s = s.where(valid_mmsi(s.mmsi))
    sides = [F.col(c) for c in ("dim_bow", "dim_stern", "dim_port", "dim_star")]
    eta = [F.col(c) for c in ("eta_month", "eta_day", "eta_hour", "eta_minute")]
    five = sentences.voyage_payload(F.col("mmsi"), F.col("imo"), F.col("call_sign"), F.col("vessel_name"), F.col("ship_type"), sides, eta, F.col("draught"), F.col("destination"), F.col("ais_version"))
    a, b = sentences.class_b_payloads(F.col("mmsi"), F.col("vessel_name"), F.col("ship_type"), F.col("call_sign"), sides, F.col("fixing_device"))
    seq = F.col("static_id") % 10
    parts = F.array(sentences.sentence(F.substring(five, 1, 60), 2, 1, seq), sentences.sentence(F.substring(five, 61, 60), 2, 2, seq))
    lines = F.when(F.col("static_id") % 2 == 0, parts).otherwise(F.array(sentences.sentence(a), sentences.sentence(b)))
    x = s.select("static_id", "time", F.posexplode(lines).alias("k", "s"))
    # fragments of many messages lie between each other, as they do in a log
    return x.select(sentences.tagged(F.col("s"), F.col("time")).alias("line"), F.floor(F.col("static_id") / 1000).cast("string").alias("file"), (F.col("k") * 10 + F.col("static_id") % 10 + F.floor(F.col("static_id") % 1000 / 10) * 20).cast("long").alias("n"))


def _text_sql(c: str, chars: int) -> str:
    return f"trim(split_part(regexp_replace(substr(upper(coalesce({c}, '')), 1, {chars}), '[^ -?A-Z\\[\\\\\\]^_]', '@', 'g'), '@', 1), ' ')"


def _num_sql(c: str, bits: int) -> str:
    return f"CAST(least(greatest(coalesce({c}, 0), 0), {(1 << bits) - 1}) AS INTEGER)"


_VALID_ETA = "eta_month BETWEEN 1 AND 12 AND eta_day BETWEEN 1 AND CASE WHEN eta_month = 2 THEN 29 WHEN eta_month IN (4, 6, 9, 11) THEN 30 ELSE 31 END AND eta_hour BETWEEN 0 AND 23 AND eta_minute BETWEEN 0 AND 59"
_GUARDED = ", ".join(f"CASE WHEN coalesce({_VALID_ETA}, false) THEN {c} ELSE {e} END AS {c}" for c, e in (("eta_month", 1), ("eta_day", 1), ("eta_hour", 0), ("eta_minute", 0)))
# a field that is missing goes out as zero
_ETA0 = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("eta_month", "eta_day", "eta_hour", "eta_minute"))
_SIDES = ", ".join(f"{_num_sql(c, n)} AS {c}" for c, n in (("dim_bow", 9), ("dim_stern", 9), ("dim_port", 6), ("dim_star", 6)))


@query(f"""WITH r AS (SELECT * REPLACE ({_SECS} AS time) FROM ais_static WHERE mmsi >= 201000000 AND mmsi < 776000000 AND time IS NOT NULL),
z AS (SELECT * REPLACE ({_ETA0}) FROM r)
SELECT mmsi, time, {_text_sql('vessel_name', 20)} AS vessel_name, {_num_sql('ship_type', 8)} AS ship_type, {_text_sql('call_sign', 7)} AS call_sign, CAST(least(greatest(coalesce(imo, 0), 0), 1073741823) AS BIGINT) AS imo, {_SIDES},
  {_num_sql('draught', 8)} AS draught, {_text_sql('destination', 20)} AS destination, {_num_sql('ais_version', 2)} AS ais_version, CAST(NULL AS VARCHAR) AS fixing_device, {_GUARDED} FROM z WHERE static_id % 2 = 0
UNION ALL SELECT mmsi, time, {_text_sql('vessel_name', 20)}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1, 1, 0, 0 FROM z WHERE static_id % 2 = 1
UNION ALL SELECT mmsi, time, NULL, {_num_sql('ship_type', 8)}, {_text_sql('call_sign', 7)}, NULL, {_num_sql('dim_bow', 9)}, {_num_sql('dim_stern', 9)}, {_num_sql('dim_port', 6)}, {_num_sql('dim_star', 6)}, NULL, NULL, NULL, {_text_sql('fixing_device', 3)}, 1, 1, 0, 0 FROM z WHERE static_id % 2 = 1""")
def ais_voyages(spark, d):
    """Identity reports of types 5 (from fragments) and 24 (parts A and B), with the guard of arrival times."""
    m = nmea.reassembled(nmea.parsed(_log(spark, voyage_lines(spark, d))))
    return nmea.static_rows(m, "x", keep_nulls=True).drop("source")


# -- provider files ---------------------------------------------------------

def _spire_lines(rows: DataFrame, kind: int, values: dict[str, Column], time: Column) -> DataFrame:
    """Quoted lines of the layout's 132 cells; nulls are None in even rows and empty in odd ones."""
    at = {provider_csv.SPIRE[k]: v for k, v in {**values, "msg_type": F.lit(kind), "time": F.date_format(F.timestamp_seconds(time), "yyyyMMdd_HHmmss")}.items()}
    gone = F.when(F.col("_n") % 2 == 0, "None").otherwise("")
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(at[k].cast("string"), gone), F.lit('"')) if k in at else F.lit('""') for k in range(132)])
    return rows.select(line.alias("line"), F.lit("f").alias("file"), F.col("_n").alias("n"))


def _cells(lines: DataFrame) -> DataFrame:
    return lines.select("file", "n", provider_csv.cells(F.col("line")).alias("c"))


_REAL = ("longitude", "latitude", "rot", "sog", "cog", "heading")


@query(f"SELECT mmsi, {_SECS} AS time, {', '.join(f'coalesce({c}, 0) + 0 AS {c}' for c in _REAL)}, coalesce(utc_second, 0) AS utc_second FROM ais_dynamic WHERE mmsi IS NOT NULL AND time IS NOT NULL")
def spire_positions(spark, d):
    a = table(spark, d, "ais_dynamic").where("mmsi is not null and time is not null").withColumn("_n", F.col("row_id"))
    lines = _spire_lines(a, 1, {c: F.col(c) for c in ("mmsi", *_REAL, "utc_second")}, seconds(F.col("time")))
    return provider_csv.spire(_cells(lines), "x")[0].select("mmsi", "time", *[(F.col(c) + F.lit(0.0)).alias(c) for c in _REAL], "utc_second")


_WORDS = ("vessel_name", "call_sign", "destination")
_NUMBERS = ("ship_type", "dim_bow", "dim_stern", "dim_port", "dim_star", "draught", "ais_version")
_word_sql = lambda c: f"coalesce(CASE WHEN {c} IN ('', 'None') THEN NULL ELSE {c} END, '')"


@query(f"SELECT mmsi, {_SECS} AS time, {', '.join(f'{_word_sql(c)} AS {c}' for c in _WORDS)}, coalesce(imo, 0) AS imo, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _NUMBERS)}, {_GUARDED} FROM ais_static WHERE mmsi IS NOT NULL AND time IS NOT NULL")
def spire_identities(spark, d):
    s = table(spark, d, "ais_static").where("mmsi is not null and time is not null").withColumn("_n", F.col("static_id"))
    eta = ("eta_month", "eta_day", "eta_hour", "eta_minute")
    lines = _spire_lines(s, 5, {**{c: F.col(c) for c in ("mmsi", "imo", *_WORDS, *_NUMBERS)}, **{c: F.col(c).cast("double") for c in eta}}, seconds(F.col("time")))
    return provider_csv.spire(_cells(lines), "x")[1].select("mmsi", "time", *_WORDS, "imo", *_NUMBERS, *eta)


def _noaa_lines(spark, d: str) -> DataFrame:
    a = table(spark, d, "ais_dynamic").where("mmsi is not null and time is not null")
    stamp = F.date_format(F.timestamp_seconds(seconds(F.col("time"))), "yyyy-MM-dd'T'HH:mm:ss")
    cells = [F.col("mmsi"), stamp, F.col("latitude"), F.col("longitude"), F.col("sog"), F.col("cog"), F.col("heading"), F.concat(F.lit('"SHIP, '), F.col("mmsi").cast("string"), F.lit('"')), F.col("row_id") % 1000, F.lit("CALL"), F.col("row_id") % 100]
    return a.select(F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells], F.lit("0"), F.lit("20"), F.lit("5"), F.lit("7"), F.lit("70"), F.lit("A")).alias("line"), F.lit("f").alias("file"), F.col("row_id").alias("n"))


@query(f"SELECT mmsi, {_SECS} AS time, {', '.join(f'coalesce({c}, 0) + 0 AS {c}' for c in _REAL if c != 'rot')} FROM ais_dynamic WHERE mmsi IS NOT NULL AND time IS NOT NULL")
def noaa_positions(spark, d):
    return provider_csv.noaa(_cells(_noaa_lines(spark, d)), "noaa")[0].select("mmsi", "time", *[(F.col(c) + F.lit(0.0)).alias(c) for c in _REAL if c != "rot"])


@query(f"SELECT mmsi, arg_min({_SECS}, row_id) AS time, 'SHIP, ' || mmsi AS vessel_name, min(row_id) % 1000 AS imo, CAST(min(row_id) % 100 AS INTEGER) AS ship_type, 7 AS draught FROM ais_dynamic WHERE mmsi IS NOT NULL AND time IS NOT NULL GROUP BY mmsi")
def noaa_identities(spark, d):
    return provider_csv.noaa(_cells(_noaa_lines(spark, d)), "noaa")[1].select("mmsi", "time", "vessel_name", "imo", "ship_type", "draught")


# -- files ------------------------------------------------------------------

@query("SELECT kind, md5(substr(string_agg(line, chr(10) ORDER BY row_id) || chr(10), CASE WHEN kind = 'csv' THEN 1601 ELSE 1 END, 1000)) AS hash FROM (SELECT row_id, row_id || ',' || coalesce(CAST(mmsi AS VARCHAR), '') AS line, unnest(['csv', 'txt']) AS kind FROM ais_dynamic) GROUP BY kind")
def file_checksums(spark, d):
    out = fresh_folder(spark, "files")
    x = table(spark, d, "ais_dynamic").orderBy("row_id").select(F.concat(F.col("row_id").cast("string"), F.lit(","), F.coalesce(F.col("mmsi").cast("string"), F.lit(""))).alias("value"))
    frames = []
    for kind in ("csv", "txt"):
        # one file a kind; the writer that names its files csv quotes nothing here
        (x.coalesce(1).write.option("quote", "\u0000").option("sep", "\u0001").csv(f"{out}/{kind}") if kind == "csv" else x.coalesce(1).write.text(f"{out}/{kind}"))
        frames.append(files.checksums(spark, f"{out}/{kind}/part-*").select(F.lit(kind).alias("kind"), "hash"))
    return frames[0].unionByName(frames[1])


@query(f"SELECT source AS file, CAST(make_timestamp(min({_SECS}) * 1000000) AS DATE) AS date FROM ais_dynamic WHERE {_SECS} > 0 GROUP BY source")
def file_dates(spark, d):
    return files.file_dates(table(spark, d, "ais_dynamic").select(F.col("source").alias("file"), seconds(F.col("time")).alias("time")))


# -- the store --------------------------------------------------------------

def _stored(spark, d: str) -> Store:
    """A store filled with overlapping batches of the reports, so that repeats come within a batch and across."""
    store = Store(spark, fresh_folder(spark, "store"))
    a = table(spark, d, "ais_dynamic")
    a = a.where(valid_mmsi(a.mmsi) & a.time.isNotNull()).withColumn("time", seconds(a.time))
    rows = nmea.without_nulls(a.select(*[c.split()[0] for c in nmea_columns()]))
    store.insert(rows, "dynamic")
    store.insert(rows, "dynamic")
    s = static(spark, d).where(valid_mmsi(F.col("mmsi")))
    store.insert(nmea.without_nulls(s.select(*[c.split()[0] for c in static_columns()])), "static")
    return store


def nmea_columns() -> list[str]:
    from wakeline.schema import DYNAMIC

    return DYNAMIC.split(", ")


def static_columns() -> list[str]:
    from wakeline.schema import STATIC as columns

    return columns.split(", ")


_KEPT = f"""kept AS (SELECT DISTINCT mmsi, {_SECS} AS time, coalesce(longitude, 0) AS longitude, coalesce(latitude, 0) AS latitude, coalesce(sog, 0) AS sog, coalesce(cog, 0) AS cog, coalesce(source, '') AS source
  FROM ais_dynamic WHERE mmsi >= 201000000 AND mmsi < 776000000 AND time IS NOT NULL)"""
_DAY = lambda t: datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)


@query(f"WITH {_KEPT} SELECT mmsi, time, longitude, latitude, sog, cog, source, {MONTH.format('time')} AS month FROM kept")
def store_dynamic(spark, d):
    """Every report once, in its month, after the same rows were inserted twice."""
    return _stored(spark, d).dynamic().select("mmsi", "time", "longitude", "latitude", "sog", "cog", "source", "month")


@query(f"WITH {STATIC} SELECT DISTINCT mmsi, time, coalesce(imo, 0) AS imo, coalesce(source, '') AS source, month FROM st WHERE mmsi >= 201000000 AND mmsi < 776000000")
def store_static(spark, d):
    return _stored(spark, d).static().select("mmsi", "time", "imo", "source", "month")


@query(f"WITH {_KEPT} SELECT mmsi, time, longitude AS lon, latitude AS lat, CAST(trunc(cog) AS INTEGER) AS cog FROM kept WHERE time BETWEEN {START} AND {END} AND longitude BETWEEN {BOX['xmin']} AND {BOX['xmax']} AND latitude BETWEEN {BOX['ymin']} AND {BOX['ymax']}")
def store_tracks(spark, d):
    """Tracks of a box and span of time by way of the query object."""
    q = asked.Query(_stored(spark, d), _DAY(START), _DAY(END), filters.in_time_bbox_validmmsi, **BOX)
    return q.tracks().select("mmsi", "time", "lon", "lat", "cog")


@query(f"""WITH {_KEPT}, {STATIC}, n AS (SELECT month, mmsi, ship_type AS v, count(*) AS n, min({{'t': time, 's': coalesce(source, '')}}) AS o FROM st WHERE mmsi >= 201000000 AND mmsi < 776000000 AND ship_type <> 0
  AND (mmsi, time, coalesce(imo, 0), coalesce(source, ''), static_id) IN (SELECT (mmsi, time, coalesce(imo, 0), coalesce(source, ''), min(static_id)) FROM st GROUP BY mmsi, time, coalesce(imo, 0), coalesce(source, '')) GROUP BY ALL),
m AS (SELECT month, mmsi, v, row_number() OVER (PARTITION BY month, mmsi ORDER BY n DESC, o) AS rn FROM n)
SELECT k.mmsi, k.time, k.source, m.v AS ship_type FROM kept k LEFT JOIN m ON m.rn = 1 AND m.mmsi = k.mmsi AND m.month = {MONTH.format('k.time')} WHERE k.time BETWEEN {START} AND {END}""", "store_dynamic_static")
def store_dynamic_static(spark, d):
    q = asked.Query(_stored(spark, d), _DAY(START), _DAY(END), filters.in_timerange_validmmsi)
    return q.dataframe(asked.crawl_dynamic_static, distinct=False, ordered=False).dropDuplicates(["mmsi", "time", "longitude", "latitude", "sog", "cog", "source"]).select("mmsi", "time", "source", "ship_type")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)
