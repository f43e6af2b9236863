"""Best representative of each group of duplicate records, field by field.

The fields are unpivoted to long rows, every row votes for its normalised value,
the votes of a value are tallied, ``max_by`` chooses each field's winner, and the
winners are pivoted back.  A row's vote is the trust of its source times a
recency decay.  Two tallies:

* ``summed``: the votes of a value add up.
* ``leading``: trust and decay are infinitely steep, so that a sum is worth its
  largest vote - the order is trust, then time, then completeness, then the
  smallest id, which finite sums cannot express.

Votes are combined map-side by value (and span of time), so that a group of any
size sends a few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.known_at import code_list, filled_text, filler_lists
from wakeline.operators.normalise import feed, seconds

FIELDS = ("vessel_name", "imo", "call_sign", "ship_type")


def imo_holds(imo: Column) -> Column:
    """Seven digits, the last of which is the check digit of the first six; null fails."""
    total = sum((7 - i) * (F.floor(imo / 10 ** (6 - i)) % 10) for i in range(6))
    return F.coalesce((imo >= 1_000_000) & (imo <= 9_999_999) & (total % 10 == imo % 10), F.lit(False))


def unpivoted(df: DataFrame, group: Sequence[str], fields: Mapping[str, tuple[Column, Column]], trust: Column, time: Column, ident: Column) -> DataFrame:
    """One row per filled field: group columns, field_name, value, norm, trust, time, complete, ident.

    ``fields`` gives of each field its value and whether it is filled.
    """
    complete = sum(F.coalesce(ok, F.lit(False)).cast("int") for _, ok in fields.values())
    each = F.array_compact(F.array(*[
        F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("value"))) for name, (value, ok) in fields.items()
    ]))
    return df.select(*group, F.explode(each).alias("_f"), trust.alias("trust"), time.alias("time"), complete.alias("complete"), ident.alias("ident")).select(
        *group, "_f.field_name", "_f.value", F.upper(F.trim("_f.value")).alias("norm"), "trust", "time", "complete", "ident"
    )


HALF_LIFE_S = 30 * 86_400


def _row_vote() -> Column:
    return F.struct("trust", "time", "complete", (-F.col("ident")).alias("neg"), "value")


def leading(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, field_name, norm, votes, best): each value with the largest of its votes and the row that cast it."""
    return long.groupBy(*group, "field_name", "norm").agg(F.max(_row_vote()).alias("best")).withColumn("votes", F.col("best"))


def summed(long: DataFrame, group: Sequence[str], half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """(group, field_name, norm, votes, best): each value with the sum of trust x 2^(-age / half-life) and its best row.

    Votes are summed per span of one half-life first, each span from its own start,
    and the few sums are then brought to the group's newest span: no power can
    overflow, and no row needs the group's newest time.
    """
    span = F.floor(F.col("time") / half_life_s)
    weight = F.col("trust") * F.pow(F.lit(2.0), F.col("time") / half_life_s - F.col("_span"))
    spans = long.withColumn("_span", span).groupBy(*group, "field_name", "norm", "_span").agg(F.sum(weight).alias("_s"), F.max(_row_vote()).alias("best"))
    newest = F.max("_span").over(Window.partitionBy(*group))
    scaled = spans.withColumn("_s", F.col("_s") * F.pow(F.lit(2.0), (F.col("_span") - newest).cast("double")))
    return scaled.groupBy(*group, "field_name", "norm").agg(F.round(F.sum("_s"), 6).alias("votes"), F.max("best").alias("best"))


def survivors(tally: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One surviving record per group: of each field a struct (value, ident) of the value with most votes; null where nobody filled it.

    Values with equal votes are told apart by their best rows.
    """
    won = tally.groupBy(*group, "field_name").agg(F.max_by("best", F.struct("votes", "best")).alias("best"))
    chosen = F.struct(F.col("best.value").alias("value"), (-F.col("best.neg")).alias("ident"))
    return won.groupBy(*group).agg(*[F.max(F.when(F.col("field_name") == f, chosen)).alias(f) for f in fields])


def winners(records: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(group, field_name, ident, value) of surviving records, a row for each filled field."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.ident").alias("ident"), F.col(f"{f}.value").alias("value")) for f in fields]))
    return records.select(*group, each.alias("_w")).select(*group, "_w.*").where("ident is not null")


def best_votes(long: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return winners(survivors(leading(long, group), group, fields), group, fields)


def summed_votes(long: DataFrame, group: Sequence[str], fields: Sequence[str], half_life_s: float = HALF_LIFE_S) -> DataFrame:
    return winners(survivors(summed(long, group, half_life_s), group, fields), group, fields)


def static_votes(spark, sf_dir: str) -> DataFrame:
    """ais_static as votes per (mmsi, month); rows without mmsi or time have no group, unknown feeds the least trust."""
    s = spark.read.parquet(f"{sf_dir}/ais_static.parquet").where("mmsi is not null and time is not null")
    names = filler_lists(spark.read.parquet(f"{sf_dir}/placeholders.parquet"))
    types = code_list(spark.read.parquet(f"{sf_dir}/coarsetype_ref.parquet"), "coarse_type")
    feeds = spark.read.parquet(f"{sf_dir}/feeds.parquet").groupBy(feed(F.col("source")).alias("_feed")).agg(F.max("trust").alias("_trust"))
    s = s.withColumn("_feed", feed(F.col("source"))).join(feeds, "_feed", "left")
    t = seconds(F.col("time"))
    s = s.withColumn("month", F.date_format(F.timestamp_seconds(t), "yyyyMM").cast("long"))
    ok = {
        "vessel_name": filled_text(F.col("vessel_name"), names.get("vessel_name", [])),
        "imo": imo_holds(F.col("imo")),
        "call_sign": filled_text(F.col("call_sign"), names.get("call_sign", [])),
        "ship_type": F.coalesce(F.col("ship_type").isin(types), F.lit(False)),
    }
    return unpivoted(s, ["mmsi", "month"], {f: (F.col(f), ok[f]) for f in FIELDS}, F.coalesce("_trust", F.lit(-1)), t, F.col("static_id"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    won = best_votes(static_votes(spark, sf_dir), ["mmsi", "month"], FIELDS)
    return won.select("mmsi", "month", "field_name", F.col("ident").alias("static_id"))


def p7_survivors(spark, sf_dir: str) -> DataFrame:
    """Surviving records by summed votes, one row per vessel and month."""
    records = survivors(summed(static_votes(spark, sf_dir), ["mmsi", "month"]), ["mmsi", "month"], FIELDS)
    return records.select("mmsi", "month", *[F.col(f"{f}.value").alias(f) for f in FIELDS])


P7_VOTES = """
WITH s AS (SELECT a.static_id, a.mmsi, CASE WHEN a.time >= 100000000000 THEN CAST(floor(a.time / 1000) AS BIGINT) ELSE a.time END AS t, a.imo, a.ship_type, a.vessel_name, a.call_sign,
    trim(a.vessel_name, ' @') AS vn, trim(a.call_sign, ' @') AS cs, coalesce(f.trust, -1) AS trust
  FROM ais_static a LEFT JOIN feeds f ON replace(replace(replace(lower(f.source), ' ', ''), '-', ''), '_', '') = replace(replace(replace(lower(a.source), ' ', ''), '-', ''), '_', '')),
k AS (SELECT *, CAST(strftime(make_timestamp(t * 1000000), '%Y%m') AS BIGINT) AS month,
    coalesce(vn <> '' AND upper(vn) NOT IN (SELECT upper(filler) FROM placeholders WHERE field_name = 'vessel_name'), false) AS f1,
    coalesce(imo BETWEEN 1000000 AND 9999999 AND ((imo // 1000000 % 10) * 7 + (imo // 100000 % 10) * 6 + (imo // 10000 % 10) * 5
      + (imo // 1000 % 10) * 4 + (imo // 100 % 10) * 3 + (imo // 10 % 10) * 2) % 10 = imo % 10, false) AS f2,
    coalesce(cs <> '' AND upper(cs) NOT IN (SELECT upper(filler) FROM placeholders WHERE field_name = 'call_sign'), false) AS f3,
    coalesce(ship_type IN (SELECT coarse_type FROM coarsetype_ref), false) AS f4 FROM s),
u AS (SELECT *, CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) + CAST(f4 AS INT) AS n FROM k),
l AS (SELECT mmsi, month, 'vessel_name' AS field_name, static_id, trust, t, n, vessel_name AS val FROM u WHERE f1
  UNION ALL SELECT mmsi, month, 'imo', static_id, trust, t, n, CAST(imo AS VARCHAR) FROM u WHERE f2
  UNION ALL SELECT mmsi, month, 'call_sign', static_id, trust, t, n, call_sign FROM u WHERE f3
  UNION ALL SELECT mmsi, month, 'ship_type', static_id, trust, t, n, CAST(ship_type AS VARCHAR) FROM u WHERE f4)
"""
P7_SQL = P7_VOTES + """
SELECT mmsi, month, field_name, static_id FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi, month, field_name ORDER BY trust DESC, t DESC, n DESC, static_id) AS rn FROM l) WHERE rn = 1 AND mmsi IS NOT NULL AND month IS NOT NULL
"""
P7_SURVIVORS_SQL = P7_VOTES + """,
g AS (SELECT *, upper(trim(val, ' ')) AS norm, max(floor(t / 2592000e0)) OVER (PARTITION BY mmsi, month) AS newest FROM l WHERE mmsi IS NOT NULL AND month IS NOT NULL),
v AS (SELECT mmsi, month, field_name, norm, round(sum(trust * power(2e0, t / 2592000e0 - newest)), 6) AS votes, max({'trust': trust, 't': t, 'n': n, 'neg': -static_id, 'val': val}) AS best FROM g GROUP BY ALL),
w AS (SELECT mmsi, month, field_name, best.val AS val, row_number() OVER (PARTITION BY mmsi, month, field_name ORDER BY votes DESC, best DESC) AS rn FROM v)
SELECT mmsi, month, max(CASE WHEN field_name = 'vessel_name' THEN val END) AS vessel_name, max(CASE WHEN field_name = 'imo' THEN val END) AS imo,
  max(CASE WHEN field_name = 'call_sign' THEN val END) AS call_sign, max(CASE WHEN field_name = 'ship_type' THEN val END) AS ship_type FROM w WHERE rn = 1 GROUP BY mmsi, month
"""
