"""Keyed upserts, ingest plans, statement and page readers, result exports and a scoring cache."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADLINE = "symbol string, date string, title string, source string, url string, published_utc string"
STATEMENT = "map<string,map<string,map<string,double>>>"


def read_corpus(spark: SparkSession, path: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """JSON lines of headlines with an inclusive date range; blank lines and broken ones go."""
    rows = spark.read.schema(HEADLINE).option("mode", "DROPMALFORMED").json(path).where("title is not null")
    for condition in (F.col("symbol") == symbol if symbol else None, F.col("date") >= start if start else None, F.col("date") <= end if end else None):
        rows = rows if condition is None else rows.where(condition)
    return rows


def upsert(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row for each key, the one that was written last."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in newest))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ingest_plan(symbols: DataFrame, first: str, last: str, done: DataFrame) -> DataFrame:
    """All (symbol, month) pairs that aren't done."""
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    return symbols.select("symbol", months.alias("month")).join(done.select("symbol", "month").distinct(), ["symbol", "month"], "left_anti")


def read_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Prediction files, or folders of them, with their run's name from the file's or folder's."""
    rows = spark.read.schema(schema).option("header", True).csv(glob)
    return rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"oos_([^/]+)\.csv(?:/[^/]*)?$", 1))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """symbol, section, fiscal, label and value from one JSON file, or a folder with one, for each symbol."""
    raw = spark.read.option("wholetext", True).text(path).select(F.try_url_decode(F.replace(F.regexp_extract(F.input_file_name(), r"([^/=]+)\.json(?:/[^/]*)?$", 1), F.lit("+"), F.lit("%2B"))).alias("symbol"), F.from_json("value", STATEMENT).alias("m"))
    sections = raw.select("symbol", F.explode("m").alias("section", "periods"))
    periods = sections.select("symbol", "section", F.explode("periods").alias("fiscal", "rows"))
    return periods.select("symbol", "section", "fiscal", F.explode("rows").alias("label", "value"))


def page_parts(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))).cast("long").alias("n_items"),
        F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
    )


class _Tables(HTMLParser):
    """The first table after each wanted section's id, as rows of cells; a table in a cell belongs to its text.

    Rows and cells end where the next one, or their table, begins or ends, so unclosed tags do no harm. A cell
    of `colspan` columns stands in the first of them.
    """

    def __init__(self, sections: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.sections, self.waiting, self.depth = sections, None, 0
        self.tables: dict[str, list[list[str]]] = {}
        self.rows: list[list[str]] | None = None
        self.open = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(attrs)
        if at.get("id") in self.sections and self.depth == 0 and at["id"] not in self.tables:
            self.waiting = at["id"]
        if tag == "table" and (self.rows is not None or self.waiting is not None):
            if self.rows is None:
                self.rows, self.open = self.tables.setdefault(self.waiting, []), False
                self.waiting = None
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
            self.open = False
        elif self.depth == 1 and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            wide = at.get("colspan") or "1"
            self.rows[-1] += ["", *[""] * (min(int(wide), 1000) - 1)] if wide.isdigit() and int(wide) else [""]
            self.cell = len(self.rows[-1]) - (min(int(wide), 1000) if wide.isdigit() and int(wide) else 1)
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.rows, self.open = None, False
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[-1][self.cell] += data


def section_tables(pages: DataFrame, sections: list[str], html: str = "html") -> DataFrame:
    """page_id, section, row (from 0), label, fiscal, raw and value of the first table after each section's id.

    The first row that has cells names the columns, the first cell of a later row its label (without a trailing
    +). Cells are aligned with the header by place: a missing cell of a header's column is null, cells beyond the
    header are dropped. value is the number without , and %; empty, - and -- are null. A null page or a page
    without the section gives no rows.
    """
    wanted = frozenset(sections)
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), *T.StructType.fromDDL("section string, row int, label string, fiscal string, raw string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                parser = _Tables(set(wanted))
                parser.feed(page or "")
                parser.close()
                for section, rows in parser.tables.items():
                    rows = [[" ".join(c.split()) for c in r] for r in rows if r]
                    for n, r in enumerate(rows[1:]):
                        for k, fiscal in enumerate(rows[0][1:], 1):
                            of.append(i)
                            out.append((section, n, r[0].removesuffix("+").rstrip(), fiscal, r[k] if k < len(r) else None))
            columns = [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], schema.names)

    found = pages.select("page_id", html).mapInArrow(work, schema)
    plain = F.trim(F.regexp_replace("raw", "[,%]", ""))
    return found.withColumn("value", F.when(~plain.isin("", "-", "--"), plain.try_cast("double")))


def section_table(pages: DataFrame, section: str) -> DataFrame:
    return section_tables(pages, [section]).select("page_id", "label", "fiscal", "value")


def best_basis(rows: DataFrame, least: int = 8) -> DataFrame:
    """One basis for each symbol: consolidated if it has `least` years, else the one with more of them."""
    n = rows.groupBy("symbol", "basis").agg(F.countDistinct("fiscal").alias("n"))
    w = Window.partitionBy("symbol").orderBy(F.desc((F.col("basis") == "consolidated") & (F.col("n") >= least)), F.desc("n"), "basis")
    chosen = n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("symbol", "basis")
    return rows.join(chosen, ["symbol", "basis"], "left_semi")


def export(tables: dict[str, DataFrame], folder: str, kind: str = "json") -> None:
    """Each table as a folder of JSON lines or CSV files; nested columns need JSON."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.json(f"{folder}/{name}") if kind == "json" else writer.option("header", True).csv(f"{folder}/{name}")


def keyed(rows: DataFrame, content: list[str]) -> DataFrame:
    return rows.withColumn("content_key", F.sha2(F.to_json(F.struct(*content)), 256))


def with_cache(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with the cached results and `hit`; a key stands once in the cache."""
    one = cache.dropDuplicates(["content_key"]).withColumn("hit", F.lit(True))
    return rows.join(one, "content_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """What must be scored: each new key once."""
    return rows.join(cache.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"])


def cache_statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def adjusted(bars: DataFrame) -> DataFrame:
    """Bars scaled by adjusted / close; rows without a price go, a null volume is 0."""
    ratio = F.try_divide("adjusted", "close")
    rows = bars.dropna(subset=["open", "high", "low", "close", "adjusted"])
    return rows.select("symbol", "date", *((F.col(c) * ratio).alias(c) for c in ("open", "high", "low")), F.col("adjusted").alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))
