"""Live reports with Structured Streaming.

Sentences come from any streaming source with a ``line`` column; batch and
stream share the decoding expressions.  Fragments wait in keyed state with a
time limit, copies are dropped within a watermark, and every micro-batch feeds
the tables and the message sink.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.operators.filters import live_positions
from wakeline.schema import DYNAMIC_KEY
from wakeline.sources import nmea

log = logging.getLogger(__name__)
FRAGMENT_WAIT_MS = 60_000
FRAGMENT_DELAY = "1 hour"  # fragments that come later than this are lost


def sentences(lines: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Parsed sentences of a stream of (line, arrival timestamp); a sentence's own time goes before its arrival."""
    x = lines.select(F.explode(F.split("line", r"\r?\n")).alias("line"), F.col(arrival).alias("arrival")).where("line <> ''")
    tagged = F.col("line").contains("\\")
    e4, s4 = nmea.nm4_header(F.col("line"))
    s = F.when(tagged, s4).otherwise(F.col("line"))
    at = F.coalesce(F.when(tagged, e4), F.unix_timestamp("arrival"))
    f = F.split("s", ",")
    return x.withColumn("s", s).withColumn("time", at).where(F.col("s").rlike(r"^[!$]..VD[MO],[1-9],[1-9],") & nmea.worth_decoding(F.col("s"))).select(
        "arrival", "time", F.try_element_at(f, F.lit(2)).try_cast("int").alias("total"), F.try_element_at(f, F.lit(3)).try_cast("int").alias("no"), F.coalesce(F.try_element_at(f, F.lit(4)), F.lit("")).alias("seq"),
        F.coalesce(F.try_element_at(f, F.lit(5)), F.lit("")).alias("channel"), F.try_element_at(f, F.lit(6)).alias("payload"),
    )


def join_fragments(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Whole payloads of one (seq, channel, total); parts wait for their message, not for ever."""
    total = int(key[2])
    if state.hasTimedOut:
        state.remove()
        return
    parts = dict(zip(*state.get)) if state.exists else {}
    out, latest = [], 0
    for pdf in batches:
        latest = max(latest, int(pdf["time"].max()))
        for t, rows in pdf.sort_values(["time", "no"], kind="stable").groupby("time", sort=False):
            # messages of one second lie between each other: a part goes to the first that lacks it
            fresh: list[dict] = []
            for no, payload in zip(rows["no"].tolist(), rows["payload"]):
                if no == 1:
                    fresh.append({1: payload})
                    continue
                to = next((w for w in [*fresh, parts] if w and no not in w), None)
                if to is None:
                    fresh.append(to := {})
                to[no] = payload
            waiting = [w for w in (parts, *fresh) if w]
            done = [w for w in waiting if len(w) == total]
            out += [(int(t), "".join(w[k] for k in sorted(w))) for w in done]
            open_ones = [w for w in waiting if len(w) < total]
            parts = open_ones[-1] if open_ones else {}
    if parts:
        state.update((list(parts), list(parts.values())))
        # event time: the wait ends with the stream's own clock, and a drained stream comes to rest
        state.setTimeoutTimestamp(max(latest * 1000, state.getCurrentWatermarkMs()) + FRAGMENT_WAIT_MS)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["time", "payload"])


def messages(parsed: DataFrame) -> DataFrame:
    """file, n, time, payload: single sentences at once, fragments when they are complete."""
    single = parsed.where("total = 1").select("time", "payload")
    parts = parsed.where("total > 1").withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", FRAGMENT_DELAY)
    whole = parts.groupBy("seq", "channel", "total").applyInPandasWithState(
        join_fragments, "time long, payload string", "nos array<int>, payloads array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return single.unionByName(whole).withColumn("file", F.lit("live")).withColumn("n", F.lit(0).cast("long"))


def distinct_positions(rows: DataFrame, delay: str = "10 minutes", key=DYNAMIC_KEY["strict"]) -> DataFrame:
    """Positions once within the watermark."""
    return rows.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key)).drop("ts")


def session_tracks(rows: DataFrame, gap: str = "14 days", delay: str = "10 minutes") -> DataFrame:
    """Tracks as sessions of pings: mmsi, start, end, pings."""
    x = rows.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", delay)
    g = x.groupBy("mmsi", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("pings"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    return g.select("mmsi", "first_time", "last_time", "pings")


def hourly_counts(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    x = rows.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", delay)
    return x.groupBy(F.window("ts", "1 hour").alias("w"), "source").agg(F.count(F.lit(1)).alias("pings")).select(F.col("w.start").alias("hour"), "source", "pings")


def as_json(dynamic: DataFrame) -> DataFrame:
    """Messages for listeners; heading, rot and sog that are missing are -1."""
    x = dynamic
    for c in ("heading", "rot", "sog"):
        x = x.withColumn(c, F.coalesce(F.col(c), F.lit(-1.0)))
    return x.select(F.to_json(F.struct(F.lit("dynamic").alias("msgtype"), *x.columns)).alias("value"))


def start(
    lines: DataFrame,
    store,
    checkpoint: str,
    source: str = "live",
    publish: Callable[[DataFrame, int], None] | None = None,
    raw: Callable[[DataFrame, int], None] | None = None,
    interval: str | None = "10 seconds",
):
    """Run the receiver: decode each micro-batch, write both tables, publish messages; ``interval=None`` drains and stops.

    A batch that fails is logged, its messages go to the store's ``failed`` table, from
    where they can be tried again (``retry``), and the stream goes on; if even that
    fails the stream stops, and the batch comes again when it is started anew.
    """
    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            dynamic = live_positions(nmea.dynamic_rows(batch, source, keep_nulls=True))
            static = nmea.static_rows(batch, source)
            if publish:
                publish(as_json(dynamic), n)
            if raw:
                raw(batch.select("payload"), n)
            store.insert(nmea.without_nulls(dynamic), "dynamic")
            store.insert(static, "static")
        except Exception:  # noqa: BLE001 - the stream must outlive a bad batch
            log.exception("batch %s was not stored", n)
            batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{store.path}/failed")
        finally:
            batch.unpersist()

    writer = messages(sentences(lines)).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)).start()


def retry(spark, store, source: str = "live") -> None:
    """Store what failed batches left behind; inserts pass over what is stored already."""
    batch = spark.read.parquet(f"{store.path}/failed")
    store.insert(nmea.without_nulls(live_positions(nmea.dynamic_rows(batch, source, keep_nulls=True))), "dynamic")
    store.insert(nmea.static_rows(batch, source), "static")


def to_udp(host: str, port: int) -> Callable[[DataFrame, int], None]:
    """A publisher that sends every value as a datagram, from the workers."""
    def publish(messages: DataFrame, n: int) -> None:
        def send(rows) -> None:
            import socket

            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                for r in rows:
                    s.sendto((r[0] + "\r\n").encode(), (host, port))

        messages.foreachPartition(send)

    return publish


class UdpSource(DataSource):
    """Streaming source of lines that come as datagrams: ``spark.readStream.format("udp_lines").option("port", 9921)``.

    Columns: line, arrival.  The driver listens; a micro-batch takes what has come
    since the one before, at most ``rows`` lines (option, 100 000 if not given), so that
    a batch ends by time or by number, whichever comes first.  Datagrams cannot be asked for again: put a log or a queue in
    between where none may be lost.
    """

    @classmethod
    def name(cls) -> str:
        return "udp_lines"

    def schema(self) -> str:
        return "line string, arrival timestamp"

    def simpleStreamReader(self, schema):
        return UdpReader(self.options)


class UdpReader(SimpleDataSourceStreamReader):
    LENGTH = 8096  # bytes of the longest datagram

    def __init__(self, options: dict):
        self.address, self.rows = (options.get("host", "0.0.0.0"), int(options["port"])), int(options.get("rows", 100_000))
        self.socket = None
        self.taken: dict[int, list[tuple]] = {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import socket

        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind(self.address)
            self.socket.setblocking(False)
        rows: list[tuple] = []
        while len(rows) < self.rows:
            try:
                body = self.socket.recv(self.LENGTH)
            except BlockingIOError:
                break
            now = datetime.now(timezone.utc)
            rows += [(line, now) for line in body.decode("utf-8", "replace").split("\r\n") if line]
        at = start["n"]
        self.taken[at] = rows
        return iter(rows), {"n": at + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.taken.get(start["n"], []))

    def commit(self, end: dict) -> None:
        self.taken = {k: v for k, v in self.taken.items() if k >= end["n"]}
