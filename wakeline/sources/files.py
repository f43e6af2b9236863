"""Input files: what is there, what was read before, what is inside archives."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("nm4", "nmea", "rx", "txt", "csv")
HEAD_BYTES, CSV_SKIP = 1000, 1600


def glob_files(directory: str, ext: str = ".txt", keyorder: Callable[[str], object] | None = None) -> list[str]:
    """Files below a directory whose name ends with ``ext``, sorted."""
    return sorted((str(p) for p in Path(directory).rglob("*") if p.is_file() and p.name.endswith(ext)), key=keyorder)


def kind_of(path: str) -> str | None:
    """Extension without archive suffix, in small letters; null if it is not read."""
    name = path.lower()
    for suffix in (".gz", ".zip"):
        name = name.removesuffix(suffix)
    ext = name.rpartition(".")[2]
    return ext if ext in EXTENSIONS else None


def select_formats(paths: list[str], formats: str = "all") -> list[str]:
    """``csv`` keeps CSV files, ``other`` the rest, ``all`` both."""
    if formats not in ("all", "csv", "other"):
        raise ValueError("formats is one of all, csv, other")
    known = [(p, kind_of(p)) for p in paths]
    return [p for p, k in known if k and (formats == "all" or (k == "csv") == (formats == "csv"))]


def checksums(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, hash): md5 of the first 1000 bytes, in CSV files after 1600 bytes."""
    f = spark.read.format("binaryFile").load(paths)
    skip = F.when(F.lower("path").endswith(".csv"), CSV_SKIP).otherwise(0)
    return f.select("path", F.md5(F.substring(F.col("content"), skip + 1, F.lit(HEAD_BYTES))).alias("hash"))


def checksum(head: bytes, csv: bool = False) -> str:
    skip = CSV_SKIP if csv else 0
    return hashlib.md5(head[skip : skip + HEAD_BYTES]).hexdigest()


def file_dates(rows: DataFrame) -> DataFrame:
    """First day seen in each file of decoded rows (file, time); epoch 0 does not count."""
    return rows.where("time > 0").groupBy("file").agg(F.to_date(F.timestamp_seconds(F.min("time"))).alias("date"))


def zipped_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(line, file, n) of the text members of zip archives; a member is streamed, not unpacked to disk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if kind_of(name) is None:
                            continue
                        with z.open(name) as f:
                            lines: list[str] = []
                            n = 0
                            for raw in f:
                                lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                                if len(lines) == 20_000:
                                    yield _batch(lines, f"{path}!{name}", n)
                                    n += len(lines)
                                    lines = []
                            if lines:
                                yield _batch(lines, f"{path}!{name}", n)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "line string, file string, n long")


def _batch(lines: list[str], file: str, n: int) -> pa.RecordBatch:
    return pa.record_batch({"line": pa.array(lines), "file": pa.array([file] * len(lines)), "n": pa.array(range(n, n + len(lines)), pa.int64())})
