"""Streaming twins of the daily trend (W1) and running KPI totals (A1).

Responses or events arriving as files are read with ``readStream``; the same aggregations as the
batch operators run incrementally with state kept by Spark (checkpointed in the query's
``checkpointLocation``, so a restarted or re-scheduled query resumes exactly once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, directory: str, schema: T.StructType | str, glob: str | None = None,
                max_files_per_trigger: int = 100) -> DataFrame:
    """File stream source (Parquet) over a directory, with an explicit schema; ``glob`` selects
    the files of one table when several live in the same folder."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(directory)


def daily_trend_stream(stream: DataFrame, ts: str, measures: dict[str, str], watermark: str = "1 hour",
                       count_name: str = "n") -> DataFrame:
    """W1 on a stream: tumbling one-day windows with a watermark; emits a day once the watermark
    passes it (append mode).  ``timestamp_ntz`` input is cast to ``timestamp`` for the watermark."""
    s = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    g = s.groupBy(F.window("__ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias(count_name), *[F.avg(c).alias(o) for o, c in measures.items()])
    return g.select(F.to_date(F.col("w.start")).alias("day"), count_name, *measures.keys())


def running_kpis(stream: DataFrame, measures: dict[str, str]) -> DataFrame:
    """A1 on a stream: running count and means over everything seen so far (complete mode)."""
    return stream.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(o) for o, c in measures.items()])


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: str = "memory",
          path: str | None = None):
    """Start a streaming query writing to ``sink`` (``memory`` for inspection, or a file format)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(name)
    if sink == "memory":
        return w.format("memory").start()
    return w.format(sink).option("path", path).start()
