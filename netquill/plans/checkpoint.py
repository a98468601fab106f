"""Lineage cuts that survive lost executors: tables written to the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="netquill-")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local master gets a temporary folder; on a cluster it is
    an error, since each machine would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return (root or f"file://{_local_root()}").rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    path = f"{shared_root(df.sparkSession)}/netquill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Delete what :func:`cut` wrote for tables that nothing reads any more, such as the earlier rounds of a fixpoint. Other
    tables and None are left alone."""
    for t in tables:
        if path := getattr(t, "__dict__", {}).pop("_cut_path", None):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in parts (column __part) that follow each other in the given order."""
    return cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def row_numbers(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """``df`` with numbers from 1 in the given total order, without gathering the rows in one task: rows are dealt by range,
    numbered within each part, and shifted by the sizes of the parts before it."""
    parts = _dealt(df, *order)
    inner = parts.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each part
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def running_totals(df: DataFrame, keys: list[str], order: str, amount: str, name: str = "so_far") -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its keys up to each row in the order of ``order`` (distinct within the
    keys), and the keys' total in ``name``_total. A key with many rows spans several parts, whose sums are carried on."""
    parts = _dealt(df, *keys, order)
    w = W.partitionBy("__part", *keys)
    inner = parts.withColumn("__in", F.sum(amount).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    sums = parts.groupBy("__part", *keys).agg(F.sum(amount).alias("__s"))  # a row for each key and part it spans
    of = W.partitionBy(*keys)
    sums = sums.select("__part", *keys, F.coalesce(F.sum("__s").over(of.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(of).alias(f"{name}_total"))
    joined = inner.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)}).join(sums, [F.col("__k%d" % i).eqNullSafe(F.col(k)) for i, k in enumerate(keys)] + [inner["__part"] == sums["__part"]])
    return joined.select(*(F.col(f"__k{keys.index(c)}").alias(c) if c in keys else F.col(c) for c in df.columns), (F.col("__in") + F.col("__before")).alias(name), f"{name}_total")
