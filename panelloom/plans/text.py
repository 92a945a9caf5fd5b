"""Queries over headlines, pages and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import fundamentals, labels, metrics, news, sentiment
from panelloom.plans.registry import Registry, rounded
from panelloom.sources import adapters as src
from panelloom.sources import corpus

R = Registry()

_DATED = "dated AS (SELECT doc_id, symbol, title, source, published_utc, CAST(published_utc AS DATE) + CASE WHEN hour(published_utc) >= 10 THEN 1 ELSE 0 END AS date FROM headlines)"
_SESSION = "ses AS (SELECT DISTINCT date FROM bars)"
_ALIGNED = _DATED + ", " + _SESSION + ", aligned AS (SELECT d.doc_id, d.symbol, d.title, s.date FROM dated d ASOF JOIN ses s ON d.date <= s.date)"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.headlines(spark, sf_dir).withColumn("date", news.actionable_date("published_utc"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ticks(spark, sf_dir).select(F.col("d").alias("date")).distinct()


@R.add("headlines", "WITH " + _DATED + " SELECT doc_id, CAST(date AS DATE) AS date FROM dated")
def n1_actionable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("doc_id", "date")


@R.add("headlines", "SELECT doc_id, symbol, regexp_matches(title, 'on the|ing and', 'i') AS noisy FROM headlines WHERE NOT regexp_matches(title, 'multibagger|live nse|the and', 'i')")
def n2_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.without_noise(src.headlines(spark, sf_dir), "multibagger|live nse|the and").select("doc_id", "symbol", F.col("title").rlike("(?i)on the|ing and").alias("noisy"))


@R.add(None, """WITH t AS (SELECT doc_id, text || ' - ' || source || ' &amp;lt;' AS title FROM documents)
SELECT doc_id, replace(replace(replace(replace(replace(trim(regexp_extract(title, '(?s)^(.*) - (.*?)$', 1)), '&amp;', '&'), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>') AS headline,
       replace(replace(replace(replace(replace(trim(regexp_extract(title, '(?s)^(.*) - (.*?)$', 2)), '&amp;', '&'), '&#39;', ''''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>') AS publisher FROM t""")  # fmt: skip
def n3_n4_publisher_and_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("text", F.lit(" - "), "source", F.lit(" &amp;lt;"))
    head, tail = news.split_publisher(F.col("title"))
    return src.table(spark, sf_dir, "documents").select("doc_id", title.alias("title")).select("doc_id", news.unescaped(head).alias("headline"), news.unescaped(tail).alias("publisher"))


@R.add("headlines", "WITH names AS (SELECT 'c' || n_nationkey AS tagged, lower(substr(n_name, 1, 2)) AS term FROM nation) SELECT DISTINCT doc_id, tagged FROM headlines JOIN names ON contains(lower(title), term)")
def n6_company_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = src.table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("symbol"), F.lower(F.substring("n_name", 1, 2)).alias("term"))
    return news.tag_companies(src.headlines(spark, sf_dir).select("doc_id", "title"), names).select("doc_id", "tagged")


@R.add("headlines bars", "WITH " + _ALIGNED + " SELECT doc_id, symbol, date FROM aligned")
def n7_aligned_to_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.to_sessions(_dated(spark, sf_dir), _sessions(spark, sf_dir)).select("doc_id", "symbol", "date")


@R.add("headlines", "WITH " + _DATED + " SELECT symbol, count(title) AS n_headlines, count(DISTINCT date) AS n_days, CAST(min(date) AS DATE) AS first_date, CAST(max(date) AS DATE) AS last_date FROM dated GROUP BY symbol")
def n8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.coverage(_dated(spark, sf_dir))


@R.add("headlines bars", "WITH " + _DATED + ", " + _SESSION + """ SELECT count(*) AS n, count(*) FILTER (WHERE date NOT IN (SELECT date FROM ses)) AS off_session, count(*) FILTER (WHERE date > (SELECT max(date) FROM ses)) AS dropped,
  count(*) FILTER (WHERE date NOT IN (SELECT date FROM ses)) - count(*) FILTER (WHERE date > (SELECT max(date) FROM ses)) AS moved FROM dated""")  # fmt: skip
def n9_alignment_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.alignment_account(_dated(spark, sf_dir), _sessions(spark, sf_dir))


_VIEWS = _DATED + ", " + _SESSION + """,
sa AS (SELECT c.symbol, s.date, c.score, c.p_unknown, c.title FROM (SELECT *, CAST(published_utc AS DATE) + CASE WHEN hour(published_utc) >= 10 THEN 1 ELSE 0 END AS date FROM scored) c ASOF JOIN ses s ON c.date <= s.date),
views AS (SELECT symbol, date, avg(score) AS sentiment, count(score) AS n_headlines, coalesce(stddev_samp(score), 0) AS dispersion, avg(p_unknown) AS unknown_share FROM sa GROUP BY symbol, date)"""


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.scored(spark, sf_dir).withColumn("date", news.actionable_date("published_utc"))
    return sentiment.daily(news.to_sessions(rows, _sessions(spark, sf_dir)))


@R.add("scored bars", "WITH " + _VIEWS + " SELECT symbol, date, round(sentiment, 6) + 0.0 AS sentiment, n_headlines, round(dispersion, 6) + 0.0 AS dispersion, round(unknown_share, 6) AS unknown_share FROM views")
def e1_daily_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_views(spark, sf_dir))


@R.add("scored bars", "WITH " + _VIEWS + """,
own AS (SELECT *, CASE WHEN count(sentiment) OVER v >= 10 THEN avg(sentiment) OVER v END AS o FROM views WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
mk AS (SELECT date, sum(s) OVER b / nullif(sum(n) OVER b, 0) AS m FROM (SELECT date, sum(sentiment) AS s, count(*) AS n FROM views GROUP BY date) WINDOW b AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tt AS (SELECT own.*, sentiment - coalesce(o, m, 0) AS tr FROM own JOIN mk USING (date))
SELECT symbol, date, round(sentiment - avg(sentiment) OVER d, 6) + 0.0 AS cross_section, round(tr, 6) + 0.0 AS own_history, round(tr - avg(tr) OVER d, 6) + 0.0 AS both_ways FROM tt WINDOW d AS (PARTITION BY date)""")  # fmt: skip
def e2_e4_debiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _views(spark, sf_dir).select("symbol", "date", "sentiment")
    named = lambda f, name: f(views).select("symbol", "date", F.col("sentiment").alias(name))
    out = named(sentiment.debias_cross_section, "cross_section").join(named(sentiment.debias_trailing, "own_history"), ["symbol", "date"])
    return rounded(out.join(named(sentiment.debias_both, "both_ways"), ["symbol", "date"]))


_EVENTS = _VIEWS + """,
fw AS (SELECT symbol, date, lead(open, 2) OVER w / lead(open, 1) OVER w - 1 AS fwd_ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
ev AS (SELECT views.*, fwd_ret FROM views JOIN fw USING (symbol, date) WHERE fwd_ret IS NOT NULL)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd = src.bars(spark, sf_dir).select("symbol", "date", labels.forward_return(1).alias("fwd_ret"))
    return _views(spark, sf_dir).join(fwd, ["symbol", "date"]).where("fwd_ret is not null").withColumn("study", F.lit("all"))


@R.add("scored bars", "WITH " + _EVENTS + """, a AS (SELECT count(*) AS n, regr_slope(fwd_ret, sentiment) AS slope, regr_sxx(fwd_ret, sentiment) AS xx, regr_syy(fwd_ret, sentiment) AS yy, regr_sxy(fwd_ret, sentiment) AS xy, avg(fwd_ret) AS m FROM ev)
SELECT 'all' AS study, n, round(slope, 6) + 0.0 AS slope, round(m, 6) + 0.0 AS mean_ret, round(sqrt((yy - xy * xy / xx) / (n - 2) / xx), 6) AS stderr, round(xy * xy / xx / yy, 6) AS r2, round(slope / sqrt((yy - xy * xy / xx) / (n - 2) / xx), 5) + 0.0 AS t FROM a""")  # fmt: skip
def e8_event_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentiment.event_regression(_events(spark, sf_dir), ["study"])
    return rounded(out.withColumn("t", F.round("t", 5)))


@R.add("scored bars", "WITH " + _EVENTS + """, r AS (SELECT *, row_number() OVER (ORDER BY round(sentiment, 12), symbol, date) - 1 AS i, count(*) OVER () AS n FROM ev),
b AS (SELECT *, CASE WHEN 3 * i < n - 1 THEN 'neg' WHEN 3 * i < 2 * (n - 1) THEN 'neu' ELSE 'pos' END AS bucket FROM r)
SELECT 'all' AS study, bucket, count(*) AS n, round(avg(fwd_ret) * 1e4, 4) + 0.0 AS mean_bps, round(avg(CASE WHEN fwd_ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM b GROUP BY bucket""")  # fmt: skip
def e9_tercile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sentiment.bucket_table(sentiment.terciles(_events(spark, sf_dir).withColumn("sentiment", F.round("sentiment", 12)), ["study"]), ["study"]).withColumn("mean_bps", F.round("mean_bps", 4)))


@R.add("scored bars", "WITH " + _EVENTS + """, w AS (SELECT avg(fwd_ret) FILTER (WHERE n_headlines > 1) AS ma, avg(fwd_ret) FILTER (WHERE n_headlines = 1) AS mb, var_samp(fwd_ret) FILTER (WHERE n_headlines > 1) AS va, var_samp(fwd_ret) FILTER (WHERE n_headlines = 1) AS vb,
  count(*) FILTER (WHERE n_headlines > 1) AS na, count(*) FILTER (WHERE n_headlines = 1) AS nb FROM ev)
SELECT 'all' AS study, na AS n_a, nb AS n_b, round(ma - mb, 6) + 0.0 AS difference, round((ma - mb) / sqrt(va / na + vb / nb), 5) + 0.0 AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df FROM w""")  # fmt: skip
def e10_e13_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentiment.welch(_events(spark, sf_dir), ["study"], "fwd_ret", F.col("n_headlines") > 1, F.col("n_headlines") == 1)
    return rounded(out.withColumns({"t": F.round("t", 5), "df": F.round("df", 4)}))


@R.add("scored bars", "WITH " + _EVENTS + """, x AS (SELECT *, round(sentiment, 12) AS s FROM ev), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rs, rank() OVER (ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY fwd_ret) - 1) / 2 AS rr FROM x)
SELECT 'all' AS study, count(*) AS n, round(corr(rs, rr), 6) + 0.0 AS ic, round(avg(CASE WHEN sign(s) = sign(fwd_ret) THEN 1.0 ELSE 0.0 END) FILTER (WHERE s <> 0), 6) AS hit_rate FROM r""")  # fmt: skip
def e11_predictability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL, for any number of events: a row even without one, and no least number for the correlation."""
    out = sentiment.predictability(_events(spark, sf_dir).withColumn("sentiment", F.round("sentiment", 12)), ["study"], least=0)
    every = spark.createDataFrame([("all",)], "study string")
    return rounded(every.join(F.broadcast(out), "study", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))  # one row


@R.add("scored bars", "WITH " + _EVENTS + """, g AS (SELECT unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN n_headlines > 1 THEN 'several' END, CASE WHEN sentiment > 0 THEN 'good' END], lambda x: x IS NOT NULL)) AS subset, fwd_ret FROM ev)
SELECT subset, count(*) AS n, round(avg(fwd_ret), 6) + 0.0 AS mean_ret FROM g GROUP BY subset""")  # fmt: skip
def e12_subset_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentiment.subsets(_events(spark, sf_dir), {"all": F.lit(True), "several": F.col("n_headlines") > 1, "good": F.col("sentiment") > 0})
    return rounded(rows.groupBy("subset").agg(F.count("*").alias("n"), F.avg("fwd_ret").alias("mean_ret")))


@R.add("scored", """SELECT symbol, round(avg(p_good), 6) AS mean_p_good, round(avg(p_bad), 6) AS mean_p_bad, round(avg(p_unknown), 6) AS mean_p_unknown,
  round(avg(CASE WHEN p_good >= p_bad AND p_good >= p_unknown THEN 1.0 ELSE 0.0 END), 6) AS share_p_good, round(avg(CASE WHEN p_bad > p_good AND p_bad >= p_unknown THEN 1.0 ELSE 0.0 END), 6) AS share_p_bad,
  round(avg(CASE WHEN p_unknown > p_good AND p_unknown > p_bad THEN 1.0 ELSE 0.0 END), 6) AS share_p_unknown,
  round(avg(CASE WHEN p_good >= p_bad AND p_good >= p_unknown THEN 1.0 ELSE 0.0 END) / nullif(avg(CASE WHEN p_bad > p_good AND p_bad >= p_unknown THEN 1.0 ELSE 0.0 END), 0), 6) AS good_bad FROM scored GROUP BY symbol""")  # fmt: skip
def e14_label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sentiment.label_statistics(src.scored(spark, sf_dir), ["symbol"], ["p_good", "p_bad", "p_unknown"]))


@R.add(None, "WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS s FROM c), p AS (SELECT sum(na * 1.0 * nb) AS x FROM (SELECT a, sum(n) AS na FROM c GROUP BY a) JOIN (SELECT b, sum(n) AS nb FROM c GROUP BY b) ON a = b) SELECT CAST(n AS BIGINT) AS n, round(s / n, 6) AS agreement, round((s / n - x / n / n) / (1 - x / n / n), 6) AS kappa FROM t, p")
def e16_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kappa(src.table(spark, sf_dir, "labels"), "quality", "toxic"))


@R.add("scored bars", "WITH " + _VIEWS + """, h AS (SELECT CASE WHEN sentiment < -1 OR sentiment > 1 THEN NULL WHEN sentiment <= -0.3 THEN 'very_negative' WHEN sentiment <= -0.05 THEN 'negative' WHEN sentiment <= 0.05 THEN 'neutral' WHEN sentiment <= 0.3 THEN 'positive' ELSE 'very_positive' END AS bucket FROM views)
SELECT bucket, count(h.bucket) AS n FROM (VALUES ('very_negative'), ('negative'), ('neutral'), ('positive'), ('very_positive')) v(bucket) LEFT JOIN h USING (bucket) GROUP BY bucket""")  # fmt: skip
def e18_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.histogram(_views(spark, sf_dir))


_PROVIDERS = """l AS (SELECT doc_id, 'eao' AS provider, unnest(['good','bad','unknown']) AS label, unnest([p_good, p_bad, p_unknown]) AS p FROM scored
UNION ALL SELECT doc_id, 'iun', unnest(['good','bad','unknown']), unnest([g / (g + b + u), b / (g + b + u), u / (g + b + u)]) FROM (SELECT doc_id, 1 + length(title) - length(replace(title, 'i', '')) AS g, 1 + length(title) - length(replace(title, 'u', '')) AS b, 1 + length(title) - length(replace(title, 'n', '')) AS u FROM headlines)
UNION ALL SELECT doc_id, 'srt', unnest(['good','bad','unknown']), unnest([g / (g + b + u), b / (g + b + u), u / (g + b + u)]) FROM (SELECT doc_id, 1 + length(title) - length(replace(title, 's', '')) AS g, 1 + length(title) - length(replace(title, 'r', '')) AS b, 1 + length(title) - length(replace(title, 't', '')) AS u FROM headlines))"""


def _provider_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for chars in ("eao", "iun", "srt"):
        rows = src.scored(spark, sf_dir, chars).select("doc_id", F.lit(chars).alias("provider"), F.posexplode(F.array("p_good", "p_bad", "p_unknown")).alias("k", "p"))
        rows = rows.select("doc_id", "provider", F.element_at(F.array(F.lit("good"), F.lit("bad"), F.lit("unknown")), F.col("k") + 1).alias("label"), "p")
        out = rows if out is None else out.unionByName(rows)
    return out


@R.add("scored", "WITH " + _PROVIDERS + """, g AS (SELECT a.doc_id, avg(d) AS agreement FROM (SELECT a.doc_id, a.provider, b.provider, 1 - 0.5 * sum(abs(a.p - b.p)) AS d FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.label = b.label AND a.provider < b.provider GROUP BY 1, 2, 3) a GROUP BY 1),
m AS (SELECT doc_id, label, avg(p) AS p, count(*) AS n_providers FROM l GROUP BY 1, 2)
SELECT doc_id, label, round(p, 6) AS p, n_providers, round(agreement, 6) AS agreement, round(0.3 + 0.7 * agreement, 6) AS confidence FROM m JOIN g USING (doc_id)""")  # fmt: skip
def e19_e22_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sentiment.ensemble(_provider_rows(spark, sf_dir), ["doc_id"]))


_FUND = """st0 AS (SELECT *, last_day(CAST(strptime('1 ' || substr(fiscal, 1, 8), '%d %b %Y') AS DATE)) AS period_end, CASE WHEN fiscal LIKE '% 9m' THEN 9 ELSE 12 END AS months FROM statements),
st1 AS (SELECT *, period_end + 61 AS available_from FROM st0),
st2 AS (SELECT *, lag(months) OVER w AS pm, lag(revenue) OVER w AS pr, lag(net_profit) OVER w AS pn, (equity + coalesce(lag(equity) OVER w, equity)) / 2 AS ae FROM st1 WINDOW w AS (PARTITION BY symbol ORDER BY available_from)),
st3 AS (SELECT symbol, fiscal, CAST(available_from AS DATE) AS available_from, months, pm,
  CASE WHEN months = 12 AND pm = 12 AND pr > 1e-9 THEN least(greatest((revenue - pr) / abs(pr), -1.0), 2.0) END AS revenue_growth, CASE WHEN months = 12 AND pm = 12 AND pn > 1e-9 THEN least(greatest((net_profit - pn) / abs(pn), -1.0), 2.0) END AS profit_growth,
  CASE WHEN ae > 0 THEN least(greatest(net_profit * 12 / months / ae, -0.5), 0.6) END AS roe FROM st2),
fund AS (SELECT *, CASE WHEN months = 12 AND pm = 12 THEN roe - lag(roe) OVER (PARTITION BY symbol ORDER BY available_from) END AS roe_change FROM st3)"""


@R.add("statements", "WITH " + _FUND + " SELECT symbol, fiscal, available_from, months, round(revenue_growth, 6) + 0.0 AS revenue_growth, round(profit_growth, 6) + 0.0 AS profit_growth, round(roe, 6) + 0.0 AS roe, round(roe_change, 6) + 0.0 AS roe_change FROM fund")
def u1_u5_statement_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fundamentals.features(src.statements(spark, sf_dir)).select("symbol", "fiscal", "available_from", "months", *fundamentals.METRICS))


@R.add("statements", "WITH " + _FUND + """, days AS (SELECT DISTINCT n_name AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders, nation),
pit AS (SELECT d.symbol, d.date, f.fiscal, revenue_growth, profit_growth, roe, roe_change FROM days d ASOF LEFT JOIN fund f ON d.symbol = f.symbol AND d.date >= f.available_from)
SELECT symbol, date, fiscal, round(CASE WHEN revenue_growth IS NOT NULL AND stddev_samp(revenue_growth) OVER w > 1e-9 THEN least(greatest((revenue_growth - avg(revenue_growth) OVER w) / stddev_samp(revenue_growth) OVER w, -3.0), 3.0) END, 5) + 0.0 AS z_revenue_growth,
  round(CASE WHEN roe IS NOT NULL AND stddev_samp(roe) OVER w > 1e-9 THEN least(greatest((roe - avg(roe) OVER w) / stddev_samp(roe) OVER w, -3.0), 3.0) END, 5) + 0.0 AS z_roe FROM pit WINDOW w AS (PARTITION BY date)""")  # fmt: skip
def u6_u7_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = src.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    days = dates.crossJoin(F.broadcast(src.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"))))  # 25 nations
    return rounded(fundamentals.point_in_time(days, src.statements(spark, sf_dir)).select("symbol", "date", "fiscal", "z_revenue_growth", "z_roe"), 5)


# --- sources ------------------------------------------------------------------------------------


@R.add("headlines", "SELECT symbol, title, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, title ORDER BY doc_id % 3 DESC, doc_id DESC) AS i FROM headlines) WHERE i = 1")
def s6_s8_corpus_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.headlines(spark, sf_dir).select("symbol", "title", "source", "doc_id").withColumns({"shard": F.col("doc_id") % 3})
    return corpus.upsert(rows, ["symbol", "title"], ["shard", "doc_id"]).select("symbol", "title", "source", "doc_id")


@R.add("headlines", "WITH d AS (SELECT DISTINCT symbol, date_trunc('month', published_utc) AS m FROM headlines), s AS (SELECT DISTINCT symbol FROM headlines), m AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS DATE) AS month) SELECT symbol, month FROM s, m WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.symbol = s.symbol AND d.m = m.month)")
def s9_ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = src.headlines(spark, sf_dir).select("symbol", F.trunc("published_utc", "month").alias("month"))
    return corpus.ingest_plan(done.select("symbol").distinct(), "1996-01-01", "1999-12-01", done)


@R.add(None, "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS n_items, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def s12_page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page_parts(src.table(spark, sf_dir, "pages"))


@R.add("statements", """SELECT symbol AS page_id, 'flows' AS section, 'Sales' AS label, fiscal, CAST(CAST(revenue AS DECIMAL(18,2)) AS DOUBLE) AS value FROM statements
UNION ALL SELECT symbol, 'flows', 'Net Profit', fiscal, CASE WHEN net_profit >= 0 THEN CAST(CAST(net_profit AS DECIMAL(18,2)) AS DOUBLE) END FROM statements
UNION ALL SELECT symbol, 'stock', 'Equity', fiscal, CASE WHEN fiscal NOT LIKE '% 9m' THEN CAST(CAST(equity AS DECIMAL(18,2)) AS DOUBLE) END FROM statements""")  # fmt: skip
def s12_section_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables parsed from pages that hold the statements."""
    return rounded(corpus.section_tables(src.statement_pages(spark, sf_dir), ["flows", "stock"]).select("page_id", "section", "label", "fiscal", "value"))


@R.add("scored", "SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS hits, count(*) FILTER (WHERE doc_id % 3 <> 0) AS misses, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM scored")
def s15_s16_scoring_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.scored(spark, sf_dir)
    cache = corpus.keyed(rows.where("doc_id % 3 = 0"), ["doc_id", "title"]).select("content_key", "score")
    return rounded(corpus.cache_statistics(corpus.with_cache(corpus.keyed(rows.drop("score"), ["doc_id", "title"]), cache)))
