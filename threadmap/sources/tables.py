"""Reading point clouds from tables, and saving intermediate tables in the shared folder.

A cloud is a DataFrame with row_id (long) and x (array<double>), and columns to carry.
Rows have no order in Spark, so identity is row_id everywhere and ties go to the least.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that spark.checkpoint.dir names, which driver and executors share.

    Where the setting is missing a temporary folder is used, on a local master only.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="threadmap-")
        base = _own[sc.applicationId]
    return f"{base.rstrip('/')}/threadmap/{sc.applicationId}"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path for one saved table or set of files."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> None:
    """Deletes all that this application saved. For when its results are written: frames that still read it fail after this."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cloud(df: DataFrame, row_id: str, features: list[str] | str, carry: tuple[str, ...] = ()) -> DataFrame:
    """row_id, x and the carried columns. features: an array column, or numeric columns in order."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    return df.select(F.col(row_id).cast("long").alias("row_id"), x.alias("x"), *carry)


def subsample(points: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """So many rows, without replacement: those of least hash, so the choice doesn't hang on partitions."""
    return points.orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(rows)


def jittered(points: DataFrame, amount: float, seed: int = 0) -> DataFrame:
    """The cloud with normal noise on every coordinate, drawn by row_id and place."""
    place = lambda i, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "row_id", i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    normal = lambda i: F.sqrt(-2 * F.log(place(i, 0) + 1e-12)) * F.cos(place(i, 1) * 6.283185307179586)
    return points.withColumn("x", F.transform("x", lambda v, i: v + amount * normal(i)))
