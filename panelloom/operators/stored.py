"""A stored model: the statistics and the classifier of a fit, read back and applied to the latest windows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators.labels import sequences
from panelloom.operators.walkforward import class_weights, common_latest

_STATS = "place int, feature string, mean double, std double"


def _standardised(rows: DataFrame, features: list[str], stats: DataFrame, limit: float) -> DataFrame:
    """Each feature minus its stored mean over its stored deviation, cut to +-limit."""
    found = {r["feature"]: r for r in stats.collect()}  # a row for each feature
    z = {c: (F.col(c) - found[c]["mean"]) / found[c]["std"] for c in features}
    return rows.withColumns({c: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))) for c, x in z.items()})


def _windows(rows: DataFrame, features: list[str], label: str, length: int) -> DataFrame:
    x = F.transform(F.flatten("x"), lambda v: v.cast("double"))
    return sequences(rows, features, label, length).withColumn("_x", array_to_vector(x))


def fit_and_store(rows: DataFrame, features: list[str], path: str, length: int = 30, limit: float = 8.0) -> LogisticRegressionModel:
    """Fit on rows (symbol, date, fwd_ret, features) and write statistics (population deviation; under 1e-8 it counts
    as 1), feature order, window length, limit and model under path."""
    spark = rows.sparkSession
    known = rows.where("fwd_ret is not null")
    row = known.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    stats = spark.createDataFrame([(i, c, row[f"m{i}"] or 0.0, row[f"s{i}"] if (row[f"s{i}"] or 0.0) >= 1e-8 else 1.0) for i, c in enumerate(features)], _STATS)
    table = class_weights(_windows(_standardised(known, features, stats, limit), features, "fwd_ret", length))
    model = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="weight", regParam=0.01, maxIter=20).fit(table)
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    spark.createDataFrame([(length, float(limit))], "length int, limit double").coalesce(1).write.mode("overwrite").json(f"{path}/shape")
    model.write().overwrite().save(f"{path}/model")
    return model


def score_latest(spark: SparkSession, rows: DataFrame, path: str, as_of: str, model: LogisticRegressionModel | None = None) -> DataFrame:
    """symbol, date and prob_up of the latest date by as_of that all symbols have, by what is stored under path.

    Nothing of rows but its own windows is used: means, deviations, order of features, window length and limit are
    the stored ones. A symbol whose last window has a null feature gets no row. Labels aren't needed.
    """
    stats = spark.read.schema(_STATS).parquet(f"{path}/statistics").orderBy("place")
    features = [r["feature"] for r in stats.collect()]
    shape = spark.read.schema("length int, limit double").json(f"{path}/shape").first()
    seen = rows.where(F.col("date") <= F.lit(as_of).cast("date"))
    table = _windows(_standardised(seen, features, stats, shape["limit"]).withColumn("_known", F.lit(0.0)), features, "_known", shape["length"])
    last = table.join(common_latest(seen, as_of).select("symbol", "date"), ["symbol", "date"], "left_semi")
    fitted = model or LogisticRegressionModel.load(f"{path}/model")
    return fitted.transform(last).select("symbol", "date", vector_to_array("probability")[1].alias("prob_up"))
