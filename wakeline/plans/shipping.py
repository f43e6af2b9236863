"""Makes the package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import wakeline

_shipped: set[str] = set()
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and workers share, named by spark.checkpoint.dir; where all is one machine, a folder of its own."""
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and workers share")
    return _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp())


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def put_file(spark: SparkSession, target: str, body: bytes) -> str:
    """Write a file of any file system that the session knows; returns its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(body))
    out.close()
    return target


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's workers, once per application; by way of the shared folder where one is set."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(wakeline.__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(put_file(spark, f"{shared_folder(spark)}/wakeline_{sc.applicationId}.zip", body.getvalue()))
    _shipped.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
