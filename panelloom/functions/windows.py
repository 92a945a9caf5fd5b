"""Rolling helpers over (symbol, date): a frame's value only where it holds enough rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from panelloom.functions.tables import written


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def symbol_rows() -> WindowSpec:
    """A symbol's rows in order; made when it is needed, as a window needs a session."""
    return by("symbol")


def roll(aggregate, column: str | Column, n: int, w: WindowSpec, least: int | None = None, lag: int = 0) -> Column:
    """aggregate over the last n rows (shifted by lag), null where fewer than `least` values are not null."""
    column = F.col(column) if isinstance(column, str) else column
    frame = w.rowsBetween(-(n - 1) - lag, -lag)
    return F.when(F.count(column).over(frame) >= (n if least is None else least), aggregate(column).over(frame))


def pct_rank(column: str, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Rank of the row's value in its window, ties averaged, divided by the number of values."""
    values = F.collect_list(column).over(w.rowsBetween(-(n - 1), 0))
    below = F.size(F.filter(values, lambda x: x < F.col(column)))
    same = F.size(F.filter(values, lambda x: x == F.col(column)))
    return F.when((F.size(values) >= (n if least is None else least)) & F.col(column).isNotNull(), (below + (same + 1) / 2) / F.size(values))


def clip(column: Column, low: float, high: float) -> Column:
    """Null stays null: greatest and least would skip it."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(float(low))), F.lit(float(high))))


def _before(x: np.ndarray, age: np.ndarray, k: int, empty: float) -> np.ndarray:
    """The value k rows before each row, `empty` where that is before the series' first row."""
    out = np.full(len(x), empty)
    np.copyto(out[k:], x[: max(0, len(x) - k)], where=age[k:] >= k)
    return out


def _over_last(x: np.ndarray, age: np.ndarray, n: int, op: np.ufunc, empty: float) -> np.ndarray:
    """op over each row's last n rows, from ranges of 1, 2, 4, ... rows, so n rows cost about 2 log n steps."""
    out, offset, width = np.full(len(x), empty), 0, 1
    while True:
        if n & width:
            out = op(out, _before(x, age, offset, empty))
            offset += width
        if offset == n:
            return out
        x = op(x, _before(x, age, width, empty))
        width *= 2


def _deviations(x: np.ndarray, age: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """Sample deviation of each row's last n values in two passes; equal values have 0, exactly."""
    mean = _over_last(np.nan_to_num(x, nan=0.0), age, n, np.add, 0.0) / np.maximum(known, 1)
    about, total, squares = np.where(np.isnan(x), mean, x), np.zeros(len(x)), np.zeros(len(x))
    for j in range(min(n, len(x))):
        total += np.nan_to_num(_before(x, age, j, np.nan) - about, nan=0.0)
    about = about + total / np.maximum(known, 1)
    for j in range(min(n, len(x))):
        squares += np.nan_to_num(_before(x, age, j, np.nan) - about, nan=0.0) ** 2
    return np.sqrt(squares / np.where(known > 1, known - 1, np.nan))


def _ranks(x: np.ndarray, age: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """Rank of each value among the last n, ties averaged, over their number.

    Distances are compared one after the other, each for all rows at once; nan is a null.
    """
    below, upto = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    near = np.minimum(age, n).astype(np.int32)
    for start in range(0, min(n, len(x)), 255):  # so many ones fit in a byte
        less, most = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
        for j in range(start, min(start + 255, n, len(x))):
            other, own, inside = x[: len(x) - j], x[j:], near[j:] >= j
            less[j:] += (inside & (other < own)).view(np.uint8)
            most[j:] += (inside & (other <= own)).view(np.uint8)
        below += less
        upto += most
    return np.where(np.isnan(x), np.nan, (below + (upto - below + 1) / 2) / np.maximum(known, 1))


def _rolled(kind: str, x: np.ndarray, age: np.ndarray, n: int, least: int) -> np.ndarray:
    """One rolling value of every row; age is a row's place in its series, nan a null."""
    if kind == "lag":
        return _before(x, age, n, np.nan)
    counts = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    at = np.arange(len(x))
    known = counts[at + 1] - counts[at - np.minimum(age, n - 1)]
    if kind == "rank":
        out = _ranks(x, age, n, known)
    elif kind == "deviation":
        out = _deviations(x, age, n, known)
    elif kind == "mean":
        out = _over_last(np.nan_to_num(x, nan=0.0), age, n, np.add, 0.0) / np.maximum(known, 1)
    else:
        op, empty = {"min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}[kind]
        out = _over_last(np.where(np.isnan(x), empty, x), age, n, op, empty)
    return np.where(known >= max(least, 1), out, np.nan)


def _last(x: np.ndarray, first: np.ndarray, at: int, before: float) -> np.ndarray:
    """The last value up to each row from `at` on; first is the place of a row's series, before the value at the row before."""
    place = np.arange(len(x))
    known = np.maximum.accumulate(np.where((place >= at) & ~np.isnan(x), place, -1))
    out = np.where(known >= first, x[known], np.nan)
    return np.where((first < at) & (known < at), before, out)


def _mean(x: np.ndarray, first: np.ndarray, at: int, before: float, alpha: float) -> np.ndarray:
    """Exponentially weighted means of the rows from `at` on: y0 = x0, y = (1 - alpha) y + alpha x. A null repeats the mean.

    A row is an affine map of the mean before it; maps of 1, 2, 4, ... rows are composed. Values are taken relative to the
    mean or value with which the series starts here, so equal values have themselves as their mean, exactly.
    """
    x = np.where(np.arange(len(x)) < at, np.nan, x)
    if at:
        x[at - 1] = before
    known = ~np.isnan(x)
    seen = np.concatenate([[0], np.cumsum(known)])
    count = seen[1:] - seen[first]
    starts = np.maximum.accumulate(np.where(known & (count == 1), np.arange(len(x)), -1))
    about = np.where(count > 0, x[starts], np.nan)
    m = np.where(known, 1 - alpha, 1.0)
    s = np.where(known, alpha * (x - about), 0.0)
    m[count < 1], s[count < 1] = 0.0, 0.0
    m[known & (count == 1)], s[known & (count == 1)] = 0.0, 0.0
    width = 1
    while width < len(x) and m.any():  # a series' first map is 0 times what is before it
        s[width:], m[width:] = s[width:] + m[width:] * s[:-width], m[width:] * m[:-width]
        width *= 2
    return about + s


def rolling(df: DataFrame, columns: dict[str, tuple[str, str, int, int] | Callable], keys: list[str], order: str = "date", placed: bool = False) -> DataFrame:
    """Adds rolling values: new name -> (kind, column, n, least), kind being mean, min, max, deviation or rank of the
    last n rows, null with fewer than `least` values (null or nan is none), or lag, the value n rows before. The column may be one that stands before it
    in `columns`; a function takes all arrays made so far, by name. Names with an underscore in front are not returned.
    Two more kinds run along the whole series, of which they keep one number: last, the last value so far, and ewm, the
    exponentially weighted mean with alpha in the place of n. Of a running value a lag of one row may be taken, no more.

    Rows are sorted by key and order within their partitions and pass by in batches; of a series only the last
    rows are kept for the next batch, however long it is. Spark's own sliding frames read the whole frame again
    at every row. placed: a window over the same keys made df, so each series is in one partition already.
    """
    shown = [c for c in columns if not c.startswith("_")]
    schema = T.StructType(list(df.schema.fields) + [T.StructField(c, T.DoubleType()) for c in shown])
    frames = {c: f for c, f in columns.items() if not callable(f)}
    sources = [c for c in dict.fromkeys(f[1] for f in frames.values()) if c not in columns]
    running = [c for c, f in frames.items() if f[0] in ("last", "ewm")]
    reach = {c: 0 if c in running else f[2] - (f[0] != "lag") for c, f in frames.items()}
    for c, f in frames.items():  # a value of made values needs their rows too
        reach[c] += reach.get(f[1], max(reach.values()) if callable(columns.get(f[1])) else 0)
    most = max(1, *reach.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ran = None, {}
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select([*keys, *sources])
            kept = held.num_rows if held is not None else 0
            rows = (pa.concat_tables([held, rows]) if kept else rows).combine_chunks()
            new = np.zeros(rows.num_rows, bool)
            new[:1] = True
            for k in keys:
                code = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            at = np.arange(len(new))
            first = np.maximum.accumulate(np.where(new, at, 0))
            age = at - first
            made = {c: rows.column(c).to_numpy().astype(float) for c in sources}
            for c, f in columns.items():
                if callable(f):
                    made[c] = f(made)
                elif c in running:
                    before = ran.get(c, np.nan)
                    made[c] = _last(made[f[1]], first, kept, before) if f[0] == "last" else _mean(made[f[1]], first, kept, before, f[2])
                    if kept:
                        made[c][kept - 1] = before
                    if len(made[c]):
                        ran[c] = made[c][-1]
                else:
                    made[c] = _rolled(f[0], made[f[1]], age, f[2], f[3])
            added = [pa.array(made[c][kept:], pa.float64(), mask=np.isnan(made[c][kept:])) for c in shown]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)
            held = rows.slice(max(0, rows.num_rows - most)).combine_chunks()

    return (df if placed else df.repartition(*keys)).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def pct_ranks(df: DataFrame, columns: dict[str, tuple[str, int, int]], keys: list[str], order: str = "date") -> DataFrame:
    """Adds rolling ranks like pct_rank: new name -> (column, n, least)."""
    return rolling(df, {c: ("rank", *f) for c, f in columns.items()}, keys, order)


def _two(step):
    """step as a function of two names, which is what Spark takes for an aggregate's lambda."""
    return lambda y, m: step(y, m)


def ewm(df: DataFrame, columns: dict[str, tuple[str, float]], keys: list[str], order: str = "date", block_days: int = 512) -> DataFrame:
    """Adds exponentially weighted means: new name -> (column, alpha). y0 = x0, y = (1 - alpha) y + alpha x; leading
    nulls stay null, later ones repeat the mean.

    A row is an affine map of the mean before it, and maps compose. A series is cut into blocks of the calendar;
    within a block the composed maps are running sums (weighted so that no term exceeds the values' size), and
    the blocks' own maps, a row for each block, are scanned along the series. No task holds more of a series than
    a block, and no step leaves the JVM. `order` is a date; df is written once, as both passes read it.
    """
    alphas = sorted({alpha for _, alpha in columns.values()})
    sources = list(dict.fromkeys(source for source, _ in columns.values()))
    block = [*keys, "_block"]
    rows = df.withColumn("_block", F.floor(F.unix_date(order) / block_days))
    w = Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_c{i}": F.count(x).over(w) for i, x in enumerate(sources)} | {f"_f{i}": F.first(x, ignorenulls=True).over(w) for i, x in enumerate(sources)})
    pairs = {(i, alpha): f"_s{i}_{k}" for i, x in enumerate(sources) for k, alpha in enumerate(alphas) if (x, alpha) in columns.values()}
    # The sum of alpha * (x_j - f) / d**c_j, f being the block's first value: times d**c it is what the block adds to
    # f and to what is left of the mean before it. So equal values have themselves as their mean, exactly.
    rows = written(rows.withColumns({name: F.sum(alpha * (F.col(sources[i]) - F.col(f"_f{i}")) * F.pow(F.lit(1 - alpha), -F.col(f"_c{i}"))).over(w) for (i, alpha), name in pairs.items()}), "ewm")
    last = rows.groupBy(*block).agg(*(F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(sources))), *(F.max_by(c, order).alias(c) for c in [*(f"_f{i}" for i in range(len(sources))), *pairs.values()]))

    def mean(before: Column, c: Column, first: Column, s: Column, alpha: float) -> Column:
        """The mean behind c values of a block, given the one before the block (null: none yet)."""
        left = F.when(before.isNull(), 0.0).otherwise(before - first)
        return F.when(c == 0, before).otherwise(first + F.pow(F.lit(1 - alpha), c) * (left + F.coalesce(s, F.lit(0.0))))

    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = {}
    for (i, alpha), name in pairs.items():
        maps = F.collect_list(F.struct(F.col(f"_c{i}").alias("c"), F.col(f"_f{i}").alias("f"), F.col(name).alias("s"))).over(earlier)
        step = partial(lambda a, y, m: mean(y, m.c, m.f, m.s, a), alpha)
        carries[f"_y{name}"] = F.aggregate(maps, F.lit(None).cast("double"), _two(step))
    carried = last.withColumns(carries).select(*block, *carries)
    out = rows.join(carried, block)
    return out.select(*df.columns, *(mean(F.col(f"_y{pairs[sources.index(x), alpha]}"), F.col(f"_c{sources.index(x)}"), F.col(f"_f{sources.index(x)}"), F.col(pairs[sources.index(x), alpha]), alpha).alias(new) for new, (x, alpha) in columns.items()))


def as_of_forward(days: DataFrame, sessions: DataFrame, day: str, session: str) -> DataFrame:
    """Adds the first session on or after each row's day; rows after the last session go.

    Every calendar day between the first needed day and the last session gets its session once, which
    turns the as-of join into an equi-join with one row a day.
    """
    span = days.agg(F.min(day).alias("lo")).crossJoin(sessions.agg(F.max(session).alias("hi")))  # one row each
    calendar = span.where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("_day"))
    marked = calendar.join(sessions.select(F.col(session).alias("_session")).distinct(), F.col("_day") == F.col("_session"), "left")
    ahead = Window.orderBy("_day").rowsBetween(0, Window.unboundedFollowing)  # a row for each calendar day
    table = marked.select("_day", F.min("_session").over(ahead).alias(session))
    return days.join(table, days[day] == table["_day"]).drop("_day")


def as_of_backward(rows: DataFrame, events: DataFrame, keys: list[str], at: str, since: str) -> DataFrame:
    """Adds each row's latest event with since <= at; nulls where there is none.

    Rows and events are put together and sorted once for each key; a row takes the last event before it in that
    order (events of the same moment first, of equal events the last one), so a key's rows and events are never
    joined with each other. A row without a key or moment gets nulls.
    """
    values = [c for c in events.columns if c not in keys]
    right = events.where(F.col(since).isNotNull()).select(*keys, F.col(since).alias("_at"), F.struct(*values).alias("_event"), *(F.lit(None).cast(rows.schema[c].dataType).alias(f"_row_{c}") for c in rows.columns), F.lit(0).alias("_side"))
    left = rows.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(right.schema["_event"].dataType).alias("_event"), *(F.col(c).alias(f"_row_{c}") for c in rows.columns), F.lit(1).alias("_side"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_event").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_at").isNotNull() & ~F.expr(" or ".join(f"{k} is null" for k in keys)), F.last("_event", ignorenulls=True).over(w))
    out = left.unionByName(right).withColumn("_last", known).where("_side = 1")
    return out.select(*(F.col(f"_row_{c}").alias(c) for c in rows.columns), *(F.col(f"_last.{c}").alias(c) for c in values))
