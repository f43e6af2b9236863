"""Attributes as they were known at the time of an event.

Two times matter: the time an attribute row speaks of (valid time) and the time
it was received (known time).  Per entity and shard a persistent search tree is
built by path copying: rows are inserted in order of known time into a treap
keyed by (valid time, id), every insertion copies only the path it changes and
leaves the earlier roots intact.  An event picks the last root known at its time
and searches the greatest valid time not after it.

Shards are spans of time, so neither a vessel's history nor its events gather
in one task.  A shard gets the rows it must know - those whose valid or known
time lies in it - and, as its first root, the one earlier row that wins for
everything before (a running maximum over shards, not over rows).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.grouped import as_numpy, grouped_blocks, key_change
from wakeline.operators.normalise import seconds, valid_mmsi

SHARD_S = 86_400


class PersistentTree:
    """Treap with path copying; nodes are rows of parallel lists, a version is a root index."""

    def __init__(self) -> None:
        self.key: list = []
        self.pri: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []

    def node(self, key, pri: int, left: int, right: int) -> int:
        self.key.append(key)
        self.pri.append(pri)
        self.left.append(left)
        self.right.append(right)
        return len(self.key) - 1

    def split(self, at: int, key) -> tuple[int, int]:
        """(keys < key, keys >= key), copying the path."""
        if at < 0:
            return -1, -1
        if self.key[at] < key:
            a, b = self.split(self.right[at], key)
            return self.node(self.key[at], self.pri[at], self.left[at], a), b
        a, b = self.split(self.left[at], key)
        return a, self.node(self.key[at], self.pri[at], b, self.right[at])

    def insert(self, at: int, key) -> int:
        """Root of the version that also holds ``key``."""
        pri = hash(key) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF
        return self.put(at, key, pri)

    def put(self, at: int, key, pri: int) -> int:
        if at < 0 or self.pri[at] < pri:
            a, b = self.split(at, key)
            return self.node(key, pri, a, b)
        if key < self.key[at]:
            return self.node(self.key[at], self.pri[at], self.put(self.left[at], key, pri), self.right[at])
        return self.node(self.key[at], self.pri[at], self.left[at], self.put(self.right[at], key, pri))

    def last_not_after(self, at: int, time: int):
        """Greatest key whose time is not after ``time``; None if there is none."""
        best = None
        while at >= 0:
            if self.key[at][0] <= time:
                best = self.key[at]
                at = self.right[at]
            else:
                at = self.left[at]
        return best


OUT = "row_id long, field_name string, static_id long"


def answer(table: pa.Table) -> pa.Table:
    """Events of whole (entity, field, shard) groups, each answered from its known-time root."""
    is_event = as_numpy(table["is_event"])
    known, valid, ident = (as_numpy(table[c]) for c in ("known", "valid", "ident"))
    head = np.r_[np.flatnonzero(key_change([as_numpy(table["mmsi"]), as_numpy(table["shard"])])), table.num_rows]
    names = table["field"].to_pylist()
    rows, fields, found = [], [], []
    for a, b in zip(head[:-1].tolist(), head[1:].tolist()):
        trees: dict = {}
        # rows come in order of known time, attribute rows before events of the same time
        for i in range(a, b):
            if is_event[i]:
                at, when = int(ident[i]), int(valid[i])
                for name, (tree, roots, knowns) in trees.items():
                    k = bisect_right(knowns, when) - 1
                    hit = tree.last_not_after(roots[k], when) if k >= 0 else None
                    if hit is not None:
                        rows.append(at)
                        fields.append(name)
                        found.append(-hit[1])
            else:
                tree, roots, knowns = trees.setdefault(names[i], (PersistentTree(), [], []))
                # of equal valid times the smallest id must be the greatest key
                roots.append(tree.insert(roots[-1] if roots else -1, (int(valid[i]), -int(ident[i]))))
                knowns.append(int(known[i]))
    return pa.table({"row_id": pa.array(rows, pa.int64()), "field_name": pa.array(fields, pa.string()), "static_id": pa.array(found, pa.int64())})


def as_known(events: DataFrame, attributes: DataFrame, fields: Sequence[str], shard_s: int = SHARD_S) -> DataFrame:
    """(row_id, field_name, static_id): the attribute row that each event could know.

    ``events``: row_id, mmsi, time (seconds).  ``attributes``: mmsi, field, valid
    (seconds), known (seconds, rounded up), static_id - one row per filled field of
    ``fields``.
    Among rows of the event's mmsi with valid <= time and known <= time the one
    with the latest valid time wins, then the smallest static_id; events without
    one, rows with null keys or times give nothing.  Repeated rows are harmless.
    """
    shard = lambda c: F.floor(c / shard_s).cast("long")
    ev = events.where("mmsi is not null and time is not null").select("row_id", "mmsi", "time").withColumn("shard", shard(F.col("time")))
    at = attributes.where("mmsi is not null and valid is not null and known is not null").select("mmsi", "field", "valid", "known", "static_id")
    begin = F.greatest(shard(F.col("valid")), shard(F.col("known")))  # first shard that may use the row
    at = at.withColumn("shard", begin)
    # what each shard inherits: the winner among rows usable before it began
    per_shard = at.groupBy("mmsi", "field", "shard").agg(F.max(F.struct("valid", (-F.col("static_id")).alias("neg"))).alias("best"))
    need = ev.select("mmsi", "shard").distinct()
    w = Window.partitionBy("mmsi", "field").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    wants = need.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields]))).select("mmsi", "field", "shard", F.lit(None).cast("struct<valid:bigint,neg:bigint>").alias("best"), F.lit(True).alias("want"))
    line = per_shard.withColumn("want", F.lit(False)).unionByName(wants)
    merged = line.groupBy("mmsi", "field", "shard").agg(F.max("best").alias("best"), F.max("want").alias("want"))
    carried = (
        merged.withColumn("carry", F.max("best").over(w)).where("want and carry is not null")
        .select("mmsi", "shard", "field", F.col("carry.valid").alias("valid"), F.lit(-(2**62)).alias("known"), (-F.col("carry.neg")).alias("ident"), F.lit(False).alias("is_event"))
    )
    own = at.select("mmsi", "shard", "field", "valid", "known", F.col("static_id").alias("ident"), F.lit(False).alias("is_event"))
    asks = ev.select("mmsi", "shard", F.lit(None).cast("string").alias("field"), F.col("time").alias("valid"), F.col("time").alias("known"), F.col("row_id").alias("ident"), F.lit(True).alias("is_event"))
    both = own.unionByName(carried).unionByName(asks)
    return grouped_blocks(both, ["mmsi", "shard"], ["known", "is_event", "valid", "ident"], answer, OUT)


def filled_text(value: Column, fillers: list[str]) -> Column:
    """Text that says something: not empty once trimmed of spaces and @, and no filler in any letter case."""
    bare = F.upper(F.trim(value, F.lit(" @")))
    return F.coalesce((bare != "") & ~bare.isin(fillers), F.lit(False))


def filler_lists(placeholders: DataFrame, most: int = 10_000) -> dict[str, list[str]]:
    """Fillers by field, in capitals; the table is a fixed list, its size is checked."""
    rows = placeholders.where("field_name is not null and filler is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("placeholders is not a list of fillers: too many rows")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.field_name, []).append(r.filler.upper())
    return out


def code_list(table: DataFrame, column: str, most: int = 1_000) -> list[int]:
    """Distinct codes of a fixed reference list; its size is checked, so none is left out silently."""
    rows = table.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} is not a list of codes: more than {most}")
    return sorted(r[0] for r in rows)


def static_fields(spark, sf_dir: str, fields=("vessel_name", "ship_type")) -> DataFrame:
    """ais_static as one row per filled field: mmsi, field, valid, known, static_id."""
    s = spark.read.parquet(f"{sf_dir}/ais_static.parquet")
    names = filler_lists(spark.read.parquet(f"{sf_dir}/placeholders.parquet"))
    types = code_list(spark.read.parquet(f"{sf_dir}/coarsetype_ref.parquet"), "coarse_type")
    full = {
        "vessel_name": filled_text(s.vessel_name, names.get("vessel_name", [])),
        "call_sign": filled_text(s.call_sign, names.get("call_sign", [])),
        "ship_type": F.coalesce(s.ship_type.isin(types), F.lit(False)),
    }
    known = F.ceil(F.unix_micros(s.received.cast("timestamp")) / F.lit(1_000_000)).cast("long")
    each = F.array_compact(F.array(*[F.when(full[f], F.lit(f)) for f in fields]))
    return s.select("mmsi", F.explode(each).alias("field"), seconds(s.time).alias("valid"), known.alias("known"), "static_id")


def p2_found(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/ais_dynamic.parquet")
    events = d.where(valid_mmsi(d.mmsi) & d.maneuver).select("row_id", "mmsi", seconds(d.time).alias("time"))
    fields = ("vessel_name", "ship_type")
    return as_known(events, static_fields(spark, sf_dir, fields), fields)


P2_SQL = """
WITH e AS (SELECT row_id, mmsi, CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END AS t
           FROM ais_dynamic WHERE maneuver AND mmsi >= 201000000 AND mmsi < 776000000),
s AS (SELECT static_id, mmsi, CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END AS t, received,
        trim(vessel_name, ' @') AS n, ship_type FROM ais_static),
f AS (SELECT static_id, mmsi, t, received, 'vessel_name' AS field_name FROM s
        WHERE n <> '' AND NOT EXISTS (SELECT 1 FROM placeholders p WHERE p.field_name = 'vessel_name' AND upper(p.filler) = upper(n))
      UNION ALL
      SELECT static_id, mmsi, t, received, 'ship_type' FROM s WHERE ship_type IN (SELECT coarse_type FROM coarsetype_ref))
SELECT row_id, field_name, static_id FROM (
  SELECT e.row_id, f.field_name, f.static_id, row_number() OVER (PARTITION BY e.row_id, f.field_name ORDER BY f.t DESC, f.static_id) AS rn
  FROM e JOIN f ON f.mmsi = e.mmsi AND f.t <= e.t AND epoch_us(f.received) <= e.t * 1000000)
WHERE rn = 1
"""
