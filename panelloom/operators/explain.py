"""Audits of logged decisions: reconstruction, attribution, text consistency and deletion tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.tables import written
from panelloom.operators.inference import uniform
from panelloom.operators.metrics import running_counts


def reconstructed(opinions: DataFrame, without: str | None = None) -> DataFrame:
    """score of each symbol and day from the logged opinions, perhaps without one agent."""
    on = ~F.col("abstained") & (F.lit(True) if without is None else F.col("agent") != without)
    weighed = F.sum(F.when(on, F.col("confidence")))
    return opinions.groupBy("symbol", "date").agg(F.when(weighed > 1e-9, F.try_divide(F.sum(F.when(on, F.col("confidence") * F.col("stance"))), weighed)).otherwise(0.0).alias("rebuilt"))


def reconstruction_error(decisions: DataFrame, opinions: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    gap = F.abs(F.col("score") - F.col("rebuilt"))
    return decisions.join(reconstructed(opinions), ["symbol", "date"]).agg(F.count("*").alias("n"), F.max(gap).alias("max_error"), F.avg((gap <= tolerance).cast("double")).alias("share_within"))


def attribution(opinions: DataFrame) -> DataFrame:
    """Each active agent's part of the score."""
    total = F.sum(F.when(~F.col("abstained"), F.col("confidence"))).over(Window.partitionBy("symbol", "date"))  # as many rows as agents
    return opinions.withColumn("_t", total).select("symbol", "date", "agent", F.when(F.col("abstained"), 0.0).otherwise(F.coalesce(F.try_divide(F.col("confidence") * F.col("stance"), F.col("_t")), F.lit(0.0))).alias("share"))


def deletion_test(opinions: DataFrame, seed: int = 0, threshold: float = 0.05) -> DataFrame:
    """How often the decision (score over the threshold) flips without the agent that matters most, and
    without another one, drawn by a seeded hash; with the two discordant counts of McNemar's test.

    All deletions come from one pass: an agent's removal changes the two sums that make the score.
    """
    on = ~F.col("abstained")
    a, b = F.when(on, F.col("confidence") * F.col("stance")).otherwise(0.0), F.when(on, F.col("confidence")).otherwise(0.0)
    part = F.struct(F.abs(a).alias("weight"), F.col("agent").alias("agent"), a.alias("a"), b.alias("b"))
    rows = opinions.groupBy("symbol", "date").agg(F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sort_array(F.collect_list(F.when(on, part)), asc=False).alias("parts")).where(F.size("parts") >= 2)  # as many as agents
    score = lambda x, y: F.when(y > 1e-9, F.try_divide(x, y)).otherwise(0.0)
    other = F.element_at("parts", F.floor(uniform(F.lit(seed), "symbol", "date") * (F.size("parts") - 1)).cast("int") + 2)
    without = lambda p: score(F.col("sa") - p["a"], F.col("sb") - p["b"]) > threshold
    now = score(F.col("sa"), F.col("sb")) > threshold
    rows = rows.select((now != without(F.col("parts")[0])).alias("top"), (now != without(other)).alias("other"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("top").cast("double")).alias("flip_top"), F.avg(F.col("other").cast("double")).alias("flip_other"), F.count_if(F.col("top") & ~F.col("other")).alias("only_top"), F.count_if(~F.col("top") & F.col("other")).alias("only_other"))


def text_consistency(decisions: DataFrame) -> DataFrame:
    """Whether action, score and size in the rationale's text are those of the columns."""
    shape = r"^(\w+) at score ([+-]?[\d.]+), size ([\d.]+)"
    said = lambda i: F.regexp_extract("rationale", shape, i)
    ok_action = said(1) == F.col("action")
    ok_score = F.abs(said(2).try_cast("double") - F.col("score")) <= 5.01e-4
    ok_size = F.abs(said(3).try_cast("double") - F.col("size")) <= 5.01e-5
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return decisions.agg(F.count("*").alias("n"), share(ok_action).alias("action"), share(ok_score).alias("score"), share(ok_size).alias("size"))


def sections(rationale: Column) -> Column:
    """agent -> clause of a text of clauses 'agent: text' parted by '; ' or ' | '."""
    clauses = F.filter(F.split(rationale, r"; | \| "), lambda c: c.rlike(r"^\w+: "))
    return F.map_from_arrays(F.transform(clauses, lambda c: F.regexp_extract(c, r"^(\w+): ", 1)), F.transform(clauses, lambda c: F.regexp_extract(c, r"^\w+: (.*)$", 1)))


def decision_accuracy(decisions: DataFrame) -> DataFrame:
    """n, base rate of rises, precision of BUY, sign accuracy where the score isn't 0, and Spearman's ic."""
    known = counted(decisions.where("fwd_ret is not null and score is not null"), "score", "fwd_ret", "action")
    share = lambda of, where: F.try_divide(F.sum(F.when(of & where, F.col("_k")).otherwise(0)).cast("double"), F.sum(F.when(where, F.col("_k"))))
    up, every = F.col("fwd_ret") > 0, F.lit(True)
    shares = known.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n"), share(up, every).alias("base_rate"), share(up, F.col("action") == "BUY").alias("buy_precision"), share(F.signum("score") == F.signum("fwd_ret"), F.col("score") != 0).alias("sign_accuracy"))
    return shares.crossJoin(rank_correlation(known, "score", "fwd_ret").select(F.col("rho").alias("ic")))  # one row each


def rubric(decisions: DataFrame, criteria: DataFrame) -> DataFrame:
    """Each decision's number of criteria that hold for its class; criteria: (action, criterion, met 0/1), a
    table of a few rows. A class without criteria has none."""
    totals = criteria.groupBy("action").agg(F.sum("met").alias("rubric"))
    return decisions.join(F.broadcast(totals), "action", "left").withColumn("rubric", F.coalesce("rubric", F.lit(0)).cast("double"))


def counted(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows of some columns and _k, how often each occurs, written: both ranks read them several times.
    Whatever most rows share is counted in the tasks that read it."""
    return written(rows.groupBy(*columns).agg(F.count("*").alias("_k")), "pairs")


def rank_correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n and rho, Spearman's correlation of pairs that occur _k times. The mean of average ranks is (n + 1) / 2 whatever
    the values, so sums of products are about it at once."""
    ranked = pairs.withColumn("_one", F.lit(True))
    for value, out in ((a, "_ra"), (b, "_rb")):
        ranks = running_counts(ranked.select("_one", value, "_k"), value, ["_one"], n=F.sum("_k"))
        ranked = ranked.join(ranks.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2 - (F.col("_all") + 1) / 2).alias(out)), value)
    product = lambda x, y: F.sum(F.col("_k") * F.col(x) * F.col(y))
    return ranked.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("n"), F.try_divide(product("_ra", "_rb"), F.sqrt(product("_ra", "_ra")) * F.sqrt(product("_rb", "_rb"))).alias("rho"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rank_correlation(counted(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b), a, b)
