"""Shaping of plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, whose columns later filters take as they are.

    The optimizer moves filters below projections and writes out each column
    that they name; with columns of many steps the generated code outgrows
    what the JVM compiles.  A filter on a row number made here stays above.
    """
    return df.withColumn("_settled", F.monotonically_increasing_id()).where("_settled >= 0").drop("_settled")


def spread(df: DataFrame) -> DataFrame:
    """A read table, dealt evenly if its scan has fewer partitions than there are cores: only small ones have."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * limit else df


_own: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir: for what several branches of a plan read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that the driver and all executors share; in local mode a new folder will do where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    base = base or _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="prosemill-"))
    return f"{base.rstrip('/')}/prosemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
