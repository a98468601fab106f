"""Session helpers: ship the package to Python workers wherever they run."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile

from pyspark.sql import SparkSession

from netquill.plans.checkpoint import shared_root

_shipped: set[str] = set()

MOST = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20}  # fixed values
BYTES_A_PART = 3 << 20  # of a table's compressed columns, for each part of a shuffle


def _packed() -> bytes:
    here, out = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("netquill", os.path.relpath(full, here)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, through the shared folder, so that their Python workers can
    import it whether or not it is installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    uri = f"{shared_root(spark)}/netquill-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(_packed()))
    stream.close()
    sc.addPyFile(uri)
    _shipped.add(sc.applicationId)


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)


def spread(spark: SparkSession, path: str) -> None:
    """Keep what a task holds from growing with the tables: splits and shuffled parts are of a fixed size, and parts as many as the
    file or folder that is read needs for it. Sessions with smaller sizes or more parts keep them."""
    for key, most in MOST.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    parts = -(-size // BYTES_A_PART)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < parts:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
