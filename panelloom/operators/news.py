"""Headline cleaning, company tagging and alignment to sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import as_of_forward

#: The entities that headlines are cleaned of, in the order of replacement.
ENTITIES = (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))

#: Phrases of headlines that say nothing about the future.
NOISE = (
    "prediction for tomorrow|share price target|live nse|stock price & chart|technical analysis|price live|"
    "buy or sell|multibagger|should you buy|stocks to watch|f&o levels|share price today live"
)

#: Phrases of headlines about results.
EARNINGS = (
    r"\bQ[1-4]\b|\bQ[1-4]FY|\bquarter(?:ly)?\b|\b(?:results?|earnings)\b|\bnet profit\b|\bPAT\b|"
    r"\bprofit (?:rises|falls|jumps|drops|surges|slumps|declines|grows|up|down)\b"
)


def actionable_date(published: str | Column, cutoff_hour: int = 10) -> Column:
    """The UTC day, or the next one from the cut-off hour on."""
    ts = F.col(published) if isinstance(published, str) else published
    return F.date_add(F.to_date(ts), (F.hour(ts) >= cutoff_hour).cast("int"))


def without_noise(rows: DataFrame, pattern: str = NOISE, column: str = "title") -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def split_publisher(title: Column, most: int = 45) -> tuple[Column, Column]:
    """(headline, publisher): cut at the last ' - ' if what follows is shorter than `most`; else no publisher."""
    head, tail = F.regexp_extract(title, r"(?s)^(.*) - (.*?)$", 1), F.regexp_extract(title, r"(?s)^(.*) - (.*?)$", 2)
    cut = title.contains(" - ") & (F.length(tail) < most)
    return F.when(cut, F.trim(head)).otherwise(F.trim(title)), F.when(cut, F.trim(tail)).otherwise("")


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def feed_items(pages: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """title, published and link of each <item>; items without a title or a readable date go; one of each
    key and lower-cased title stays, the first."""
    part = lambda tag: F.trim(F.regexp_extract(F.col("item"), rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    items = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.col(raw), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("at", "item"))
    rows = items.select(*keys, "at", unescaped(part("title")).alias("title"), F.try_to_timestamp(F.substring(part("pubDate"), 6, 20), F.lit("dd MMM yyyy HH:mm:ss")).alias("published"), part("link").alias("link"))
    rows = rows.where((F.col("title") != "") & F.col("published").isNotNull())
    w = Window.partitionBy(*keys, F.lower("title")).orderBy("at")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "at")


def tag_companies(rows: DataFrame, names: DataFrame, column: str = "title", gram: int = 6) -> DataFrame:
    """One row for each symbol of which the title holds a term, both lower-cased, wherever in the title.

    names: symbol and term, any number of them; they stay in Spark. A term meets the titles that hold its first
    `gram` characters (all of a shorter term) by equality, and is then looked for in those. Equal rows give one
    row a symbol; null titles, and empty or null terms, match nothing.
    """
    text = F.lower(F.col(column))
    terms = names.select(F.col("symbol").alias("tagged"), F.lower("term").alias("_term")).where(F.length("_term") > 0).distinct()
    terms = terms.withColumns({"_gram": F.substring("_term", 1, gram), "_width": F.least(F.length("_term"), F.lit(gram))})
    widths = {r["_width"]: r["count"] for r in terms.groupBy("_width").count().collect()}  # at most `gram` numbers
    keyed = rows.where(F.col(column).isNotNull()).withColumn("_key", F.xxhash64(*rows.columns))
    if not widths:
        return keyed.drop("_key").limit(0).withColumn("tagged", F.lit(None).cast("string"))
    grams = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{w}}}))"), F.lit(1)) for w in sorted(widths))))
    met = keyed.select("_key", F.explode(grams).alias("_gram")).join(terms.select("_gram", "_term", "tagged"), "_gram")
    # A title's candidates are one array for about 4,096 terms; all terms of a symbol are in the same one.
    lists = F.pmod(F.xxhash64("tagged"), F.lit(1 + sum(widths.values()) // 4096))
    met = met.groupBy("_key", lists.alias("_list")).agg(F.collect_set(F.struct("tagged", "_term")).alias("_terms"))
    # A title moves once, to where its terms are; of equal rows one is left before each symbol gets its own.
    found = keyed.repartition("_key").distinct().join(met, "_key").withColumn("_text", text)
    held = F.array_distinct(F.transform(F.filter("_terms", lambda x: F.contains(F.col("_text"), x["_term"])), lambda x: x["tagged"]))
    return found.select(*rows.columns, F.explode(held).alias("tagged"))


def to_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The first session on or after each row's date; rows after the last one go."""
    dated = rows.withColumnRenamed("date", "_news_day")
    return as_of_forward(dated, sessions.select(F.col("date")), "_news_day", "date").drop("_news_day")


def coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.count("title").alias("n_headlines"), F.countDistinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def alignment_account(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """How many rows stand off a session, are dropped after the last one, or are moved."""
    marked = rows.join(sessions.select("date").distinct().withColumn("_on", F.lit(1)), "date", "left")
    last = sessions.agg(F.max("date").alias("_last"))  # one row
    out = marked.crossJoin(F.broadcast(last)).agg(F.count("*").alias("n"), F.count_if(F.col("_on").isNull()).alias("off_session"), F.count_if(F.col("date") > F.col("_last")).alias("dropped"))
    return out.withColumn("moved", F.col("off_session") - F.col("dropped"))


def coverage_share(decisions: DataFrame, views: DataFrame) -> DataFrame:
    """Share of decision rows that have a view."""
    keys = views.select("symbol", "date").distinct().withColumn("_v", F.lit(1))
    return decisions.join(keys, ["symbol", "date"], "left").agg(F.count("*").alias("n"), F.count("_v").alias("with_view"), F.avg(F.col("_v").isNotNull().cast("double")).alias("share"))
