"""A log of batches, each of which counts once, and a keyed table of which only touched partitions are written."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.tables import written

_MANIFEST = "batch string, folder string"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """batch and folder of all committed batches; of a batch committed twice the first folder by name counts."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    except AnalysisException:  # nothing is committed yet
        return spark.createDataFrame([], _MANIFEST)
    return rows.groupBy("batch").agg(F.min("folder").alias("folder"))


def append_once(rows: DataFrame, path: str, batch: str | None = None) -> str:
    """Append rows to the log at path as one batch, unless a batch of that name is committed; gives its name.

    Rows are written to a folder of their own first, and count from the moment that the manifest names it, so a
    writer that is lost half-way, or a batch that a stream replays, leaves nothing behind that counts twice.
    """
    spark, batch = rows.sparkSession, batch or uuid.uuid4().hex
    if _manifest(spark, path).where(F.col("batch") == batch).isEmpty():
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        spark.createDataFrame([(batch, folder)], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return batch


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches, with batch; the list of folders (one a batch) is read by the driver."""
    folders = {r["folder"]: r["batch"] for r in _manifest(spark, path).collect()}
    if not folders:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in sorted(folders)))
    names = F.broadcast(spark.createDataFrame([(f, b) for f, b in folders.items()], "_folder string, batch string"))
    return rows.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"/(data-[0-9a-f]{32})/", 1)).join(names, "_folder").drop("_folder")


def log_sink(path: str):
    """foreachBatch writer: a micro-batch is a batch of the log, once."""
    return lambda rows, number: append_once(rows, path, f"stream-{number}") and None


def upsert_into(rows: DataFrame, path: str, keys: list[str], newest: list[str], parts: int = 64) -> int:
    """Put rows into the keyed table at path, the last written row of a key winning; gives how many partitions were written.

    The table is parted by a hash of its keys (column part). Only the partitions that rows touch are read, merged and
    replaced; a repeated call changes nothing. An empty table of rows writes nothing.
    """
    spark = rows.sparkSession
    own = rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    touched = sorted(r["part"] for r in own.select("part").distinct().collect())  # at most `parts` numbers
    if not touched:
        return 0
    try:
        old = spark.read.schema(own.schema).parquet(path).where(F.col("part").isin(touched))
        both = old.withColumn("_new", F.lit(0)).unionByName(own.withColumn("_new", F.lit(1)))
    except AnalysisException:  # the table is new
        both = own.withColumn("_new", F.lit(1))
    order = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in newest), F.desc("_new"))
    merged = written(both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new"), "merged")
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return len(touched)
