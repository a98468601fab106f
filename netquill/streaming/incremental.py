"""Observations scored as a stream: row by row, or in windows of their time that are final when they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from netquill.operators.observations import discretized


def score_arrivals(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, thresholds: dict[str, list[float]] | None = None) -> StreamingQuery:
    """Discretise the observations of new Parquet files in ``folder`` and append them to ``out``."""
    stream: DataFrame = spark.readStream.schema(schema).parquet(folder)
    return discretized(stream, thresholds).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def window_means(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, width: str = "1 day", slide: str | None = None, gap: str | None = None, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("data_type",), value: str = "value", files: int | None = None) -> StreamingQuery:
    """(keys, start, end, n, mean) of the values in windows of the observations' time, appended to ``out`` when no observation less
    than ``late`` behind the latest can fall into them; what comes later than that is left out.

    Windows are tumbling, sliding (``slide``) or sessions that end after ``gap`` without an observation of the keys. The state is
    kept in the checkpoint, so a restarted stream goes on where it was. ``files``: how many are one batch."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder).withWatermark(time, late)
    window = F.session_window(time, gap) if gap else F.window(time, width, slide)
    means = stream.groupBy(*keys, window.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    rows = means.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
