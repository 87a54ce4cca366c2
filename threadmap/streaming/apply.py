"""Fitted routes on streams: projection of micro-batches, and windowed residuals with late rows.

Projection is row by row, so a stream gives what a batch gives. Routes are a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routes import project_batches


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def projected(stream: DataFrame, segments: DataFrame) -> DataFrame:
    """The stream's rows on the routes."""
    return project_batches(stream, segments)


def windowed_values(stream: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n, total of tumbling windows; rows later than that are left out once the window is done.

    A time without zone is taken to be in the session's zone.
    """
    stream, w = stream.withColumn(time, F.col(time).cast("timestamp")), F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
