"""One copy of every message delivered at least once, by exact quotient hash tables.

A message's identifier (mmsi, seconds, feed) is brought to a fixed width: one
64-bit word where mmsi and seconds have their usual ranges, else two, and the
feed's own bytes.  The words go through a permutation, which loses nothing.  The
top bits of the permuted word name a shard; inside a table the next bits (the
quotient) name a slot, and the slot stores the complete remainder - all other
bits, the second word, the feed - so two identifiers meet only if they are equal.
Each identifier is inserted once; a further delivery finds it in its slot and only
the better of the two rows stays.

Copies are dropped twice: first inside every scan task, so that one identifier
sends at most one row per task however often it was delivered, then per shard.
Rows already known to be copies travel as a bare row id, spread by it and not by
the hot identifier: a second pass over the input would cost more than they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.grouped import as_numpy
from wakeline.operators.normalise import feed, seconds

SHARD_BITS = 20  # about a million shards: 10^12 identifiers leave 10^6 in each
NARROW_MMSI, NARROW_TIME = 1 << 30, 1 << 33  # identifiers below both fit one word
M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
LATEST = np.int64(2**63 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (odd multiplications and xor-shifts)."""
    x = x * M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def permute(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of words: three Feistel rounds, each undone by running it again."""
    a, b = a.astype(np.int64).view(np.uint64).copy(), b.astype(np.int64).view(np.uint64).copy()
    with np.errstate(over="ignore"):
        a ^= mix(b + M2)
        b ^= mix(a + M3)
        a ^= mix(b + M1)
    return a, b


def identifiers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, whether there is a second) of pairs of numbers; equal only for equal pairs."""
    wide = (a < 0) | (a >= NARROW_MMSI) | (b < 0) | (b >= NARROW_TIME)
    with np.errstate(over="ignore"):
        high = mix((a << 33 | b).astype(np.int64).view(np.uint64))
    low = np.zeros(len(a), np.uint64)
    if wide.any():
        high[wide], low[wide] = permute(a[wide], b[wide])
    return high, low, wide


class QuotientTable:
    """Exact set of identifiers with the best row of each, as an open-addressed quotient hash table.

    The bits of the first word behind the shard's are the quotient and name the home
    slot.  A slot keeps how far it lies from home and the complete remainder, from
    which the identifier can be had back (``identifier``); an entry that meets a taken
    slot goes on to the next one.  At most half of the slots are taken.
    """

    def __init__(self, bits: int = 10):
        self.clear(bits)

    def clear(self, bits: int) -> None:
        n = 1 << bits
        self.bits, self.count = bits, 0
        self.away = np.full(n, -1, np.int32)  # distance from home, -1: free
        self.rest, self.low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.code = np.zeros(n, np.int64)  # feed, and whether there is a second word
        self.received, self.row = np.full(n, LATEST, np.int64), np.full(n, LATEST, np.int64)

    def __len__(self) -> int:
        return self.count

    def cut(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(quotient, remainder) of first words."""
        below = np.uint64(64 - SHARD_BITS - self.bits)
        quotient = (high >> below) & np.uint64((1 << self.bits) - 1)
        rest = (high >> np.uint64(64 - SHARD_BITS) << below) | (high & np.uint64((1 << int(below)) - 1))
        return quotient.astype(np.int64), rest

    def identifier(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The identifiers that slots hold, put together from slot number and remainder."""
        below = np.uint64(64 - SHARD_BITS - self.bits)
        quotient = ((slot - self.away[slot]) & ((1 << self.bits) - 1)).astype(np.uint64)
        rest = self.rest[slot]
        high = (rest >> below << np.uint64(64 - SHARD_BITS)) | (quotient << below) | (rest & np.uint64((1 << int(below)) - 1))
        return high, self.low[slot], self.code[slot]

    def taken(self) -> np.ndarray:
        return np.flatnonzero(self.away >= 0)

    def place(self, high: np.ndarray, low: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Slot of each identifier; those that are new take one."""
        home, rest = self.cut(high)
        n, last = len(high), (1 << self.bits) - 1
        slot = np.zeros(n, np.int64)
        far = np.zeros(n, np.int32)
        todo = np.arange(n)
        while len(todo):
            at = (home[todo] + far[todo]) & last
            free = self.away[at] < 0
            if free.any():
                # of those that want one free slot the first takes it, the others look again
                want, first = np.unique(at[free], return_index=True)
                who = todo[free][first]
                self.away[want], self.rest[want], self.low[want], self.code[want] = far[who], rest[who], low[who], code[who]
                self.count += len(want)
            met = (self.away[at] == far[todo]) & (self.rest[at] == rest[todo]) & (self.low[at] == low[todo]) & (self.code[at] == code[todo])
            slot[todo[met]] = at[met]
            todo = todo[~met]
            far[todo] += 1
        return slot

    def insert(self, high, low, code, received, row) -> np.ndarray:
        """Insert deliveries; returns the row ids that give way to an earlier received row, then to a smaller id."""
        if 2 * (self.count + len(high)) > 1 << self.bits:
            self.grow(2 * (self.count + len(high)))
        slot = self.place(high, low, code)
        touched = np.unique(slot)
        was = self.received[touched], self.row[touched]
        np.minimum.at(self.received, slot, received)
        # the row of a slot with a new earliest time is open again
        self.row[touched[self.received[touched] < was[0]]] = LATEST
        best = received == self.received[slot]
        np.minimum.at(self.row, slot[best], row[best])
        gone = row != self.row[slot]
        old = (was[1] != LATEST) & (was[1] != self.row[touched])
        return np.concatenate([row[gone], was[1][old]])

    def grow(self, least: int) -> None:
        slot = self.taken()
        high, low, code = self.identifier(slot)
        received, row = self.received[slot], self.row[slot]
        self.clear(max(self.bits, int(least - 1).bit_length()))
        at = self.place(high, low, code)
        self.received[at], self.row[at] = received, row

    def keep_shard(self, shard: int) -> None:
        """Forget every shard but one."""
        slot = self.taken()
        high, low, code = self.identifier(slot)
        mine = (high >> np.uint64(64 - SHARD_BITS)).astype(np.int64) == shard
        slot, high, low, code = slot[mine], high[mine], low[mine], code[mine]
        received, row = self.received[slot], self.row[slot]
        self.clear(max(10, (2 * len(slot)).bit_length()))
        at = self.place(high, low, code)
        self.received[at], self.row[at] = received, row


STAGED = "high long, low long, feed string, received long, row_id long"  # only row_id: a known copy
LOCAL_ROWS = 200_000


def codes_of(names: pa.ChunkedArray, known: dict) -> np.ndarray:
    """Small integers for feed names; null is a name of its own."""
    enc = names.combine_chunks()
    enc = (enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc).dictionary_encode(null_encoding="encode")
    table = np.array([known.setdefault(v, len(known)) for v in enc.dictionary.to_pylist()], dtype=np.int64)
    return table[enc.indices.to_numpy(zero_copy_only=False)] if len(enc) else np.zeros(0, np.int64)


def local_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop copies inside one scan task."""
    def flush(held):
        t = pa.Table.from_batches(held)
        known: dict = {}
        code = codes_of(t["feed"], known)
        high, low, wide = identifiers(as_numpy(t["a"]), as_numpy(t["b"]))
        table = QuotientTable()
        gone = table.insert(high, low, code * 2 + wide, as_numpy(t["received"]), as_numpy(t["row_id"]))
        slot = table.taken()
        high, low, code = table.identifier(slot)
        names = pa.array(list(known), pa.string())
        yield pa.record_batch({
            "high": pa.array(high.view(np.int64)), "low": pa.array(low.view(np.int64), mask=code % 2 == 0), "feed": names.take(pa.array(code // 2)),
            "received": pa.array(table.received[slot]), "row_id": pa.array(table.row[slot]),
        })
        if len(gone):
            none = pa.nulls(len(gone), pa.int64())
            yield pa.record_batch({"high": none, "low": none, "feed": pa.nulls(len(gone), pa.string()), "received": none, "row_id": pa.array(gone)})

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= LOCAL_ROWS:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def shard_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle the remaining copies; a task holds whole shards, sorted by shard."""
    known: dict = {}
    table, at = QuotientTable(), -1

    def out(rows):
        return pa.record_batch({"row_id": pa.array(rows.astype(np.int64))})

    for b in batches:
        if not b.num_rows:
            continue
        copy = b["high"].is_null().to_numpy(zero_copy_only=False)
        row = b["row_id"].to_numpy()
        if copy.any():
            yield out(row[copy])
            b = b.filter(pa.array(~copy))
            row = row[~copy]
            if not b.num_rows:
                continue
        high = b["high"].to_numpy().view(np.uint64)
        shard = (high >> np.uint64(64 - SHARD_BITS)).astype(np.int64)
        if len(table) and shard[0] != at:
            table = QuotientTable()  # shards before are complete
        wide = ~b["low"].is_null().to_numpy(zero_copy_only=False)
        low = b["low"].fill_null(0).to_numpy().view(np.uint64)
        code = codes_of(pa.chunked_array([b["feed"]]), known)
        gone = table.insert(high, low, code * 2 + wide, b["received"].to_numpy(), row)
        if len(gone):
            yield out(gone)
        # only the last shard of the batch may go on in the next one
        at = int(shard[-1])
        table.keep_shard(at)


def repeated_messages(df: DataFrame) -> DataFrame:
    """row_id of every row but the first received (then smallest row_id) of each (mmsi, seconds, feed).

    ``df`` needs row_id (unique), mmsi, time, source, received.  Null mmsi, time
    and source are values like any other (rows equal in them are copies); a null
    ``received`` counts as last.  Extra columns are ignored; empty in, empty out.
    """
    t = seconds(F.col("time"))
    # null words move to values no real identifier has
    a = F.coalesce(F.col("mmsi").cast("long"), F.lit(-(2**63)))
    b = F.coalesce(t, F.lit(-(2**63)))
    received = F.coalesce(F.unix_micros(F.col("received").cast("timestamp")), F.lit(2**63 - 2))
    base = df.select(a.alias("a"), b.alias("b"), feed(F.col("source")).alias("feed"), received.alias("received"), F.col("row_id").cast("long").alias("row_id"))
    first = base.mapInArrow(local_pass, STAGED)
    shard = F.shiftrightunsigned(F.coalesce("high", F.xxhash64("row_id")), 64 - SHARD_BITS)
    return first.repartition(shard).sortWithinPartitions(shard).mapInArrow(shard_pass, "row_id long")


def keep_first(df: DataFrame) -> DataFrame:
    """``df`` with one copy of each message, all columns kept; joins on the unique row_id, so no key is hot."""
    return df.join(repeated_messages(df), "row_id", "left_anti")


def p6_found(spark, sf_dir: str) -> DataFrame:
    return repeated_messages(spark.read.parquet(f"{sf_dir}/ais_dynamic.parquet"))


P6_SQL = """
SELECT row_id FROM (
  SELECT row_id, row_number() OVER (
    PARTITION BY mmsi, CASE WHEN time >= 100000000000 THEN CAST(floor(time / 1000) AS BIGINT) ELSE time END,
      replace(replace(replace(lower(source), ' ', ''), '-', ''), '_', '')
    ORDER BY received, row_id) AS rn FROM ais_dynamic)
WHERE rn > 1
"""
