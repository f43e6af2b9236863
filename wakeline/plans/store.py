"""The stored tables: month-partitioned Parquet, written without repeats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.scalar import coarse_types, month_key
from wakeline.operators.aggregates import date_range, static_aggregate
from wakeline.schema import DYNAMIC, DYNAMIC_KEY, STATIC, STATIC_KEY
from wakeline.sources import files, nmea, provider_csv


MOST_MONTHS = 240  # months told apart when stored keys are looked up


class Store:
    """Tables ``dynamic``, ``static``, ``static_aggregate`` and ``files`` below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._at(table))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _read(self, table: str, schema: str) -> DataFrame:
        full = f"{schema}, month string"
        return self.spark.read.schema(full).parquet(self._at(table)) if self._exists(table) else self.spark.createDataFrame([], full)

    def dynamic(self) -> DataFrame:
        return self._read("dynamic", DYNAMIC)

    def static(self) -> DataFrame:
        return self._read("static", STATIC)

    def static_aggregate(self) -> DataFrame:
        return self.spark.read.parquet(self._at("static_aggregate")) if self._exists("static_aggregate") else static_aggregate(self.static(), order=("time",))

    def coarse_types(self) -> DataFrame:
        return self.spark.createDataFrame(coarse_types(), "coarse_type int, coarse_type_txt string")

    def date_range(self) -> DataFrame:
        return date_range(self.dynamic())

    def insert(self, rows: DataFrame, table: str, key: Sequence[str] | None = None, exact: bool = True) -> None:
        """Append rows, each to its own month; a row whose key is stored or came earlier in the batch is left out.

        Rows are placed by (month, mmsi) and sorted by mmsi and time inside the files,
        so that later scans prune by both.  ``exact`` looks up the stored keys that the
        batch can meet; without it only repeats within the batch go.
        """
        key = list(key or (DYNAMIC_KEY if table == "dynamic" else STATIC_KEY)["strict"])
        x = rows.withColumn("month", month_key(F.col("time"))).withColumn("_seq", F.monotonically_increasing_id())
        x = x.groupBy(*key).agg(F.min_by(F.struct(*[c for c in x.columns if c != "_seq" and c not in key]), "_seq").alias("_r")).select(*key, "_r.*")
        if exact and self._exists(table):
            old = (self.dynamic() if table == "dynamic" else self.static()).where(self._touched(x)).select(*key)
            x = x.join(old, key, "left_anti")
        cols = [c.split()[0] for c in (DYNAMIC if table == "dynamic" else STATIC).split(", ")]
        x = x.select(*cols, "month")
        x.repartition("month", F.pmod(F.hash("mmsi"), F.lit(64))).sortWithinPartitions("month", "mmsi", "time").write.mode("append").partitionBy("month").parquet(self._at(table))

    @staticmethod
    def _touched(x: DataFrame, most: int = MOST_MONTHS) -> Column:
        """Where rows equal to those of a batch can be: its months, and in each the span of its times and vessels.

        Files of a stream hold short spans of time each, so a small batch reads few of
        them.  Months are few; of a batch with more than ``most`` only the whole span is used.
        """
        spans = x.groupBy("month").agg(*[f(c).alias(f"{n}_{c}") for c in ("time", "mmsi") for n, f in (("min", F.min), ("max", F.max))]).limit(most + 1).collect()
        if not spans:
            return F.lit(False)
        if len(spans) > most:
            return F.lit(True)
        within = lambda r, c: F.col(c).between(r[f"min_{c}"], r[f"max_{c}"])
        return reduce(or_, [(F.col("month") == r.month) & within(r, "time") & within(r, "mmsi") for r in spans])

    def deduplicate(self, key: Sequence[str] = ("mmsi", "time", "source")) -> DataFrame:
        """Stored positions with one row per key."""
        return self.dynamic().dropDuplicates(list(key))

    def aggregate_static(self, months: Sequence[str] | None = None) -> None:
        """Rebuild the static aggregate of the given months, or of all; other months stay as they are."""
        s = self.static() if months is None else self.static().where(F.col("month").isin(list(months)))
        out = static_aggregate(s, order=("time", "source"))
        mode = {"partitionOverwriteMode": "dynamic"}
        out.write.mode("overwrite").options(**mode).partitionBy("month").parquet(self._at("static_aggregate"))

    def analyze(self, table: str) -> None:
        """Statistics for the optimiser, under the table's own name."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS wakeline_{table} USING parquet LOCATION '{self._at(table)}'")
        self.spark.sql(f"ANALYZE TABLE wakeline_{table} COMPUTE STATISTICS")

    def compact(self, table: str, target: str) -> None:
        """Rewrite a table to ``target`` with one file per month and hash of mmsi."""
        t = self.dynamic() if table == "dynamic" else self.static()
        t.repartition("month", F.pmod(F.hash("mmsi"), F.lit(16))).sortWithinPartitions("mmsi", "time").write.mode("overwrite").partitionBy("month").parquet(target)


def ingest(store: Store, paths: list[str], source: str, formats: str = "all", skip_checksum: bool = True, keep_nulls: bool = False) -> dict[str, int]:
    """Read files into the store: sentences (nm4, nmea, rx, txt), provider CSV, plain, gzip or zip.

    ``source`` names the rows; one that holds "noaa" chooses that CSV layout.  With
    ``skip_checksum=False`` files whose head was read before are left out and new ones
    are remembered.  Returns the number of files by kind.
    """
    spark = store.spark
    chosen = files.select_formats(paths, formats)
    if not skip_checksum and chosen:
        sums = files.checksums(spark, chosen)
        known = spark.read.parquet(store._at("files")) if store._exists("files") else spark.createDataFrame([], "path string, hash string")
        fresh = sums.join(known.select("hash"), "hash", "left_anti").collect()  # one row a file
        names = {r.path.removeprefix("file:").replace("//", "/").replace("//", "/") for r in fresh}
        chosen = [p for p in chosen if str(Path(p).absolute()) in names]
        if fresh:
            spark.createDataFrame([(r.path, r.hash) for r in fresh], "path string, hash string").write.mode("append").parquet(store._at("files"))
    groups = {"csv": [p for p in chosen if files.kind_of(p) == "csv"], "text": [p for p in chosen if files.kind_of(p) != "csv"]}
    for kind, group in groups.items():
        for zipped in (False, True):
            part = [p for p in group if p.lower().endswith(".zip") == zipped]
            if not part:
                continue
            lines = files.zipped_lines(spark, part) if zipped else nmea.read_lines(spark, part)
            if kind == "text":
                messages = nmea.reassembled(nmea.parsed(lines))
                dynamic, static = nmea.dynamic_rows(messages, source, keep_nulls), nmea.static_rows(messages, source, keep_nulls)
            else:
                rows = lines.where(F.col("line").rlike(r'^"?\s*[0-9]')).select("file", "n", provider_csv.cells(F.col("line")).alias("c"))
                read = provider_csv.noaa if "noaa" in source.lower() else provider_csv.spire
                dynamic, static = read(rows, source, keep_nulls)
            store.insert(dynamic, "dynamic")
            store.insert(static, "static")
    return {k: len(v) for k, v in groups.items()}
