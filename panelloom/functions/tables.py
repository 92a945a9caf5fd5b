"""Tables written to the cluster's shared folder, so that later steps read them instead of making them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "table", by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there. by: columns whose values get folders."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/panelloom-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df hashed by keys to so many partitions, which a window or aggregate over these keys takes as they are; df itself for None."""
    return df if parts is None else df.repartition(parts, *keys)
