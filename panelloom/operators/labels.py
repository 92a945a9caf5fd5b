"""Forward labels, sequence windows, purged walk-forward folds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import by, symbol_rows


def forward_return(h: int = 1, w=None) -> Column:
    """Open to open, entered on the next row: null for the last h + 1 rows."""
    w = w or symbol_rows()
    return F.try_divide(F.lead("open", 1 + h).over(w), F.lead("open", 1).over(w)) - 1


def sequences(rows: DataFrame, features: list[str], label: str, length: int = 30) -> DataFrame:
    """symbol, date, x (length x features) and y of each row whose whole window is known, label included."""
    frame = symbol_rows().rowsBetween(-(length - 1), 0)
    valid = F.lit(1)
    for c in [*features, label]:
        valid = valid * F.when(F.col(c).isNotNull() & ~F.isnan(c), 1).otherwise(0)
    out = rows.withColumn("_valid", valid).withColumns({"_all": F.min("_valid").over(frame), "_n": F.count(F.lit(1)).over(frame), "x": F.collect_list(F.array(*(F.col(c).cast("float") for c in features))).over(frame)})
    return out.where(f"_all = 1 and _n = {length}").select("symbol", "date", "x", F.col(label).alias("fwd_ret"), (F.col(label) > 0).cast("int").alias("y"))


def flatten(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.flatten("x"))


def cross_sectional(rows: DataFrame, value: str = "fwd_ret") -> DataFrame:
    """y: above the day's median."""
    return rows.withColumn("y", (F.col(value) > F.median(value).over(Window.partitionBy("date"))).cast("int"))


def folds(dates: DataFrame, train_years: float = 3, test_months: int = 6, embargo_days: int = 10, least_train: int = 200, least_test: int = 20) -> DataFrame:
    """fold, train_lo, train_hi, test_lo, test_hi (half-open) of a purged walk forward over `date` rows.

    The cursor starts a training span after the first date and steps by months, clipped at month ends
    step by step; spans with too few rows go. dates may repeat, so counts are of rows.
    """
    span = round(train_years * 365.25)
    ends = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    if ends["lo"] is None:
        return dates.sparkSession.createDataFrame([], "fold int, train_lo date, train_hi date, test_lo date, test_hi date")
    import datetime as dt

    cursor, rows = ends["lo"] + dt.timedelta(days=span), []
    while cursor < ends["hi"]:
        month = cursor.month - 1 + test_months
        first = dt.date(cursor.year + month // 12, month % 12 + 1, 1)
        last_day = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        after = first.replace(day=min(cursor.day, last_day.day))
        rows.append((cursor - dt.timedelta(days=span), cursor - dt.timedelta(days=embargo_days), cursor, after))
        cursor = after
    table = dates.sparkSession.createDataFrame(rows, "train_lo date, train_hi date, test_lo date, test_hi date")  # two rows a year
    per_day = dates.groupBy("date").agg(F.count("*").alias("n"))
    inside = lambda lo, hi: F.sum(F.when((F.col("date") >= F.col(lo)) & (F.col("date") < F.col(hi)), F.col("n")).otherwise(0))
    counted = per_day.join(F.broadcast(table), (F.col("date") >= F.col("train_lo")) & (F.col("date") < F.col("test_hi"))).groupBy("train_lo", "train_hi", "test_lo", "test_hi").agg(inside("train_lo", "train_hi").alias("n_train"), inside("test_lo", "test_hi").alias("n_test"))
    kept = counted.where((F.col("n_train") > least_train) & (F.col("n_test") > least_test))
    return kept.withColumn("fold", F.row_number().over(Window.orderBy("test_lo")).cast("int") - 1)


def standardise(rows: DataFrame, features: list[str], fit: Column, keys: list[str], limit: float = 8.0) -> DataFrame:
    """Features minus mean over standard deviation (population) of the rows that fit marks, per key; a
    deviation under 1e-8 counts as 1; cut to +-limit."""
    stats = rows.where(fit).groupBy(*keys).agg(*(F.avg(c).alias(f"_m_{c}") for c in features), *(F.stddev_pop(c).alias(f"_s_{c}") for c in features))
    out = rows.join(stats, keys)
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}")) for c in features}
    return out.withColumns({c: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))) for c, x in scaled.items()}).select(*rows.columns)


def validation_tail(rows: DataFrame, keys: list[str], share: float = 0.15) -> DataFrame:
    """Marks the last max(1, int(share n)) rows of each key by (date, symbol), from the counts of days.

    Only the boundary day needs its rows numbered, so no key's rows are sorted as a whole.
    """
    days = rows.groupBy(*keys, "date").agg(F.count("*").alias("_on"))
    w = Window.partitionBy(*keys).orderBy("date")
    days = days.withColumns({"_upto": F.sum("_on").over(w), "_all": F.sum("_on").over(Window.partitionBy(*keys))})
    place = F.col("_upto") - F.col("_on") + F.row_number().over(Window.partitionBy(*keys, "date").orderBy("symbol"))
    return rows.join(days, [*keys, "date"]).withColumn("is_tail", place > F.col("_all") - F.greatest(F.lit(1), F.floor(share * F.col("_all")))).select(*rows.columns, "is_tail")


def every_hth_session(rows: DataFrame, h: int) -> DataFrame:
    """Rows of sessions 0, h, 2h, ... of the sorted distinct dates."""
    sessions = rows.select("date").distinct().withColumn("_r", F.row_number().over(Window.orderBy("date")))
    return rows.join(sessions.where((F.col("_r") - 1) % h == 0).select("date"), "date", "left_semi")


def sample_rows(rows: DataFrame, n: int, keys: list[str], seed: int = 0, first: Column | None = None) -> DataFrame:
    """n rows in the order of a seeded hash of their keys (rows that `first` marks before the others)."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return rows.orderBy(*([F.coalesce(first, F.lit(False)).desc()] if first is not None else []), order).limit(n)


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg(F.when(F.col("fwd_ret") > 0, 1.0).when(F.col("fwd_ret").isNotNull(), 0.0)).alias("up_rate"))
