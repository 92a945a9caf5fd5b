"""How the operators run over DataFrames: row-wise passes, written tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a folder of our own only in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/panelloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches to Python workers hold at most about 8 MiB in this session (Spark's default: 64), as
    a batch is held on both sides and rows can be long texts. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= 1 << 23:
        spark.conf.set(key, str(1 << 23))


def annotate(docs: DataFrame, new: T.StructType, work: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, list]]], carry: list[str], text: str | None = "text") -> DataFrame:
    """One pass over rows without a shuffle: work yields pieces of each batch with the new columns' arrays.

    carry names the input columns to keep; text goes to the task too, but comes back only if carried.
    """
    bounded_batches(docs.sparkSession)
    sent = list(dict.fromkeys([*carry, *([text] if text else [])]))
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([fields[c] for c in carry] + list(new.fields))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, columns in work(batch):
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in carry] + columns, names)

    return docs.select(*sent).mapInArrow(run, schema)


def emit(df: DataFrame, schema: T.StructType, work: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    """One pass over rows without a shuffle: work yields columns of new rows for each batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names])


def _tally(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of an edge between two nodes.

    Alternates the large-star and small-star steps until the edges stay the same, which takes a number
    of rounds in the logarithm of the longest chain. Each step finds a node's least neighbour by a
    partial aggregate and joins it back, so a node with very many links is never one task's list, and
    each round is written to the shared folder. Loops and rows with a null are ignored.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    before = None
    while (tally := _tally(now)) != before:
        before = tally
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small_least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = written(small, "edges")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
