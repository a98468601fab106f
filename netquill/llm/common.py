"""Helpers shared by the corpus operators: shared-folder scratch space and small expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.plans.checkpoint import cut, shared_root
from netquill.session import ship

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/netquill-{name}-{uuid.uuid4().hex}"


#: Cut lineage: write a table below the shared folder and return a scan of what was written.
materialize = cut


def merged(table: DataFrame) -> DataFrame:
    """A table to be joined by a sort-merge join, which splits hot keys. Spark sizes what Python rows are made of, or a file whose
    columns compress well, too low, and may broadcast it without this."""
    return table.hint("merge")


def shared(table: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A written table to be joined: broadcast if it is small, counted first; else merged."""
    return F.broadcast(table) if table.count() <= most_rows else merged(table)


def prepare(spark: SparkSession, rows: int = 256) -> None:
    """Ship the package to the workers, and set the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``rows`` unless
    it is less already: Python holds the texts of a batch and what is made of them, and rows may be long."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts without other letters take the built-in's fast path."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier counts as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
