"""Exact deduplication as a stateful stream.

Three steps, all in built-in DataFrame and SQL operations:

1. Every row becomes a record of digest (SHA-256 of the normalised text), stable identifier and content locator
   (file and row index), written to the shared folder.
2. A stream reads the records into keyed state that never expires, kept on disk by RocksDB: of each digest the
   largest (identifier, locator) seen and the number of rows. Rows of one key are combined before they are
   shuffled, so a hot key costs each task one row.
3. Hits, which are the rows of digests that occur more than once, are checked on full bytes: the smallest and the
   largest text of each such digest are compared, again combined before the shuffle. Where they differ (a
   collision), the digest's rows are grouped by their text instead.

Only digests that occur more than once are joined back to the rows, broadcast while they are few; all other rows are
their own group, and their texts aren't moved.

Cases: a null text counts as empty; the empty text is a text like others; of rows with equal identifiers the one
with the larger locator stays, so that exactly one row of a group does; a null identifier is smaller than any
other; an empty table returns an empty table; columns besides the two named ones are neither read nor clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import ascii_lower, materialize, scratch, shared

FILES_PER_BATCH = 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def unused(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _one_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of files with projections and filters only, so that each row of a file is one row at most.
    Joins, generators, unions and whatever else may multiply rows aren't; nor are paths that overlap."""
    todo, scans = [docs._jdf.queryExecution().analyzed()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation":
            scans.append(node.relation().location().rootPaths().mkString("\n").split("\n"))
        elif kind not in ("Project", "Filter", "SubqueryAlias"):
            return False
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    paths = sorted(x.rstrip("/") + "/" for s in scans for x in s)
    return len(scans) == 1 and not any(b.startswith(a) for a, b in zip(paths, paths[1:], strict=False))


def located(docs: DataFrame, at: str = "__at") -> DataFrame:
    """``docs`` with a locator of each row's content in a column ``at``, different for all rows; what isn't a plain scan of files
    is first written to some."""
    try:
        base = docs if _one_scan(docs) else materialize(docs, "content")
        meta = base.metadataColumn("_metadata")
        return base.select("*", F.struct(meta.getField("file_path").alias("file"), meta.getField("row_index").alias("row")).alias(at))
    except AnalysisException:  # a file format without row numbers
        base = materialize(docs, "content")
        meta = base.metadataColumn("_metadata")
        return base.select("*", F.struct(meta.getField("file_path").alias("file"), meta.getField("row_index").alias("row")).alias(at))


def keyed_state(records: DataFrame, path: str, least: int = 1) -> DataFrame:
    """Run the stream over the record table at ``path``; (digest, keep, n) as its state holds them in the end, of the digests seen
    ``least`` times and more."""
    spark = records.sparkSession
    own = spark.newSession()  # the settings below hold for the stream only
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.metricsEnabled": "false",
    }.items():
        own.conf.set(key, value)
    stream = own.readStream.schema(records.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    grouped = stream.groupBy("digest").agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    at = scratch(spark, "dedup-state")
    grouped.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", at).start().awaitTermination()
    state = own.read.format("statestore").load(at)
    keep, n = state.schema["value"].dataType.names
    out = scratch(spark, "dedup-groups")
    state.select(F.col("key.digest").alias("digest"), F.col(f"value.{keep}").alias("keep"), F.col(f"value.{n}").alias("n")).where(F.col("n") >= least).write.parquet(out)
    return spark.read.parquet(out)


def classes(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row for each row of ``rows`` (id, text, at), whose locators ``at`` come from :func:`located`: id, at, digest, keep
    (id, at), n."""
    spark = rows.sparkSession
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = rows.select("id", "at", norm.alias("norm")).select("id", "at", digest(F.col("norm")).alias("digest"), "norm")
    path = scratch(spark, "dedup-records")
    base.select("id", "at", "digest").write.parquet(path)
    records = spark.read.schema(base.select("id", "at", "digest").schema).parquet(path)
    itself = (F.struct("id", "at").alias("keep"), F.lit(1).cast("long").alias("n"))
    if records.isEmpty():
        return records.select("*", *itself)
    several = keyed_state(records, path, 2)
    hits = base.join(shared(several.select("digest")), "digest", "left_semi")
    clash = materialize(hits.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("digest"), "dedup-clash")
    of = several.select("digest", F.col("keep").alias("k"), F.col("n").alias("m"))
    plain = records.join(shared(of), "digest", "left").select("id", "at", "digest", F.coalesce("k", itself[0]).alias("keep"), F.coalesce("m", itself[1]).alias("n"))
    if clash.isEmpty():
        return plain
    apart = hits.join(shared(clash), "digest", "left_semi")
    by_text = apart.groupBy("digest", "norm").agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    split = apart.join(by_text, ["digest", "norm"])
    return plain.join(shared(clash), "digest", "left_anti").unionByName(split.select("id", "at", "digest", "keep", "n"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of each row; the row with the largest identifier stays."""
    c = classes(located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "at"), digest)
    return c.select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("keep.at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``."""
    at = unused(docs, "__at")
    rows = located(docs, at)
    gone = classes(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(at).alias("at"))).where(F.col("at") != F.col("keep.at")).select(F.col("at").alias(at))
    return rows.join(shared(materialize(gone, "dedup-gone")), at, "left_anti").drop(at)
