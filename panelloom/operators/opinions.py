"""Opinions of several agents, their confidence-weighted combination, and the gates of a debate.

An opinion is a row (symbol, date, agent, stance in -1..1, confidence in 0..1, abstained); a null input
abstains. Agents, and named sets of agents, are columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.windows import clip


def _opinion(rows: DataFrame, agent: str, stance: Column, confidence: Column, abstain: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    out = abstain | stance.isNull() | confidence.isNull()
    zero = lambda c: F.when(out, 0.0).otherwise(c)
    return rows.select("symbol", "date", F.lit(agent).alias("agent"), zero(stance).alias("stance"), zero(confidence).alias("confidence"), F.coalesce(out, F.lit(True)).alias("abstained"), *keep)


def technical(rows: DataFrame, scale: float = 4.0, keep: tuple[str, ...] = ()) -> DataFrame:
    p = F.col("prob_up")
    return _opinion(rows, "technical", clip(2 * (p - 0.5), -1, 1), clip(F.abs(p - 0.5) * scale, 0, 1), p.isNull(), keep)


def sentiment(rows: DataFrame, scale: float = 0.35, full: int = 5) -> DataFrame:
    confidence = F.least(F.col("n_headlines") / full, F.lit(1.0)) * (1 - F.least("dispersion", F.lit(1.0))) * (1 - F.col("unknown_share"))
    return _opinion(rows, "sentiment", clip(F.col("sentiment") / scale, -1, 1), clip(confidence, 0, 1), F.col("sentiment").isNull())


def regime(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep: columns of rows that stay beside the opinion."""
    # Plain arithmetic, a step at a time: Spark evaluates a lambda's outer values again for every element of every use.
    votes = {"_v0": F.col("trend"), "_v1": clip(5 * F.col("rel_strength_60d"), -1, 1), "_v2": clip(2 * (F.col("pos_52w") - 0.5), -1, 1), "_v3": clip(8 * F.col("index_mom_20d"), -1, 1)}
    total = lambda f: reduce(add, (F.when(F.col(v).isNotNull(), f(F.col(v))).otherwise(0.0) for v in votes))
    calm = lambda c, k: F.when(F.col(c).isNotNull(), 1 - k * F.col(c)).otherwise(1.0)
    missing = F.col("trend").isNull() | F.col("rel_strength_60d").isNull() | F.col("pos_52w").isNull()
    rows = rows.select("symbol", "date", (calm("vol_percentile", 0.5) * calm("vix_percentile", 0.4)).alias("_calm"), missing.alias("_missing"), *(x.alias(v) for v, x in votes.items()), *keep)
    rows = rows.withColumn("_n", reduce(add, (F.col(v).isNotNull().cast("int") for v in votes)))
    rows = rows.withColumn("_mean", F.try_divide(total(lambda x: x), F.col("_n")))
    rows = rows.withColumn("_spread", F.sqrt(F.try_divide(total(lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))), F.col("_n"))))
    confidence = F.greatest(1 - F.col("_spread"), F.lit(0.0)) * F.col("_calm")
    return _opinion(rows, "regime", F.when(~F.col("_missing"), F.col("_mean")), F.when(~F.col("_missing"), clip(confidence, 0, 1)), F.col("_missing"), keep)


def fundamental(rows: DataFrame, metrics: tuple[str, ...] = ("z_revenue_growth", "z_profit_growth", "z_roe", "z_roe_change")) -> DataFrame:
    known = F.filter(F.array(*metrics), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    return _opinion(rows, "fundamental", clip(mean / 2, -1, 1), 0.5 * F.size(known) / len(metrics), F.size(known) < 2)


def combine(opinions: DataFrame, weights: dict[str, float] | None = None, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """score, confidence, the number of active agents, and what the gates need of them.

    score: sum of weight * confidence * stance over sum of weight * confidence (0 if that is nothing);
    confidence: the mean of the active ones.
    """
    w = F.lit(1.0)
    for agent, value in (weights or {}).items():
        w = F.when(F.col("agent") == agent, value).otherwise(w)
    on = ~F.col("abstained")
    active = lambda c: F.when(on, c)
    out = opinions.groupBy(*keys).agg(
        F.sum(active(w * F.col("confidence") * F.col("stance"))).alias("_a"),
        F.sum(active(w * F.col("confidence"))).alias("_b"),
        F.avg(active(F.col("confidence"))).alias("confidence"),
        F.count_if(on).alias("n_active"),
        F.min(active(F.col("stance"))).alias("lowest"),
        F.max(active(F.col("stance"))).alias("highest"),
        F.min(active(F.col("stance") * F.col("confidence"))).alias("lowest_conviction"),
        F.max(active(F.col("stance") * F.col("confidence"))).alias("highest_conviction"),
    )
    score = F.when(F.col("_b") > 1e-9, F.try_divide("_a", "_b")).otherwise(0.0)
    return out.select(*keys, score.alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "n_active", "lowest", "highest", "lowest_conviction", "highest_conviction")


def beside(rows: DataFrame, agents: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """Adds to each row (symbol, date and what the agents read) every agent's opinion of it, as <agent>_stance,
    <agent>_confidence and <agent>_abstained (null: the agent says nothing). Nothing is shuffled."""
    for agent, make in agents.items():
        made = make(rows, keep=tuple(c for c in rows.columns if c not in ("symbol", "date")))
        rows = made.drop("agent").withColumnsRenamed({c: f"{agent}_{c}" for c in ("stance", "confidence", "abstained")})
    return rows


def stacked(rows: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """The opinions that stand beside each other in rows, one below the other."""
    each = [F.struct(F.lit(a).alias("agent"), *(F.col(f"{a}_{c}").alias(c) for c in ("stance", "confidence", "abstained"))) for a in agents]
    return rows.select("symbol", "date", F.inline(F.array(*each))).where("abstained is not null")


def combine_beside(rows: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """combine for opinions that stand beside each other: its columns are added to each row, without a shuffle."""
    on = {a: F.coalesce(~F.col(f"{a}_abstained"), F.lit(False)) for a in agents}
    stance, confidence = ({a: F.col(f"{a}_{c}") for a in agents} for c in ("stance", "confidence"))
    total = lambda f: reduce(add, (F.when(on[a], f(a)).otherwise(0.0) for a in agents))
    # greatest and least skip nulls, but take two columns at least.
    bound = lambda of, f: of(F.lit(None).cast("double"), *(F.when(on[a], f(a)) for a in agents))
    rows = rows.withColumns(
        {
            "_a": total(lambda a: confidence[a] * stance[a]),
            "_b": total(lambda a: confidence[a]),
            "n_active": reduce(add, (on[a].cast("long") for a in agents)),
            "lowest": bound(F.least, lambda a: stance[a]),
            "highest": bound(F.greatest, lambda a: stance[a]),
            "lowest_conviction": bound(F.least, lambda a: stance[a] * confidence[a]),
            "highest_conviction": bound(F.greatest, lambda a: stance[a] * confidence[a]),
        }
    )
    score = F.when(F.col("_b") > 1e-9, F.try_divide("_a", "_b")).otherwise(0.0)
    return rows.withColumns({"score": score, "confidence": F.coalesce(F.try_divide("_b", "n_active"), F.lit(0.0))}).drop("_a", "_b")


def by_configuration(opinions: DataFrame, configs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """combine for every named set of agents at once; configs: (config, agent), a table of a few rows."""
    return combine(opinions.join(F.broadcast(configs), "agent"), weights, ("config", "symbol", "date"))


def gate_raw(spread: float = 0.30) -> Column:
    """Two active agents that disagree in sign or by more than the spread."""
    return F.coalesce((F.col("n_active") >= 2) & (((F.col("lowest") < 0) & (F.col("highest") > 0)) | (F.col("highest") - F.col("lowest") > spread)), F.lit(False))


def gate_conviction(floor: float = 0.1) -> Column:
    return F.coalesce((F.col("highest_conviction") > floor) & (F.col("lowest_conviction") < -floor), F.lit(False))


def causal_z(opinions: DataFrame, least: int = 30) -> DataFrame:
    """stance as a z score against the agent's stances of strictly earlier dates; raw with fewer than `least`.

    The running moments come from sums of each agent and date.
    """
    x = F.when(~F.col("abstained"), F.col("stance"))
    days = opinions.groupBy("agent", "date").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"), F.count(x).alias("n"))
    before = Window.partitionBy("agent").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    past = days.select("agent", "date", F.sum("s").over(before).alias("_s"), F.sum("ss").over(before).alias("_ss"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"))
    rows = opinions.join(past, ["agent", "date"])
    mean = F.try_divide("_s", "_n")
    std = F.sqrt(F.greatest(F.try_divide(F.col("_ss") - F.col("_n") * mean * mean, F.col("_n") - 1), F.lit(0.0)))
    z = F.when(F.col("_n") < least, F.col("stance")).when(std <= 1e-9, 0.0).otherwise(F.try_divide(F.col("stance") - mean, std))
    return rows.withColumn("stance", z).drop("_s", "_ss", "_n")


#: How much each label of an argument's strength counts.
STRENGTH = {"Strong": 1.0, "Weak": 0.45, "None": 0.0}


def debate_residual(arguments: DataFrame) -> DataFrame:
    """residual and contested from label probabilities (symbol, date, side bull or bear, label, p)."""
    worth = F.lit(0.0)
    for label, value in STRENGTH.items():
        worth = F.when(F.col("label") == label, value).otherwise(worth)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("p") * worth).otherwise(0.0))
    out = arguments.groupBy("symbol", "date").agg(side("bull").alias("bull"), side("bear").alias("bear"))
    return out.withColumns({"residual": clip(F.col("bull") - F.col("bear"), -1, 1), "contested": (F.col("bull") > 0.3) & (F.col("bear") > 0.3)})


def blend(decisions: DataFrame, debates: DataFrame) -> DataFrame:
    """score and confidence after a debate, where there was one."""
    rows = decisions.join(debates.select("symbol", "date", "residual", "contested"), ["symbol", "date"], "left").withColumn("debated", F.col("residual").isNotNull())
    score = F.when(F.col("debated"), clip(0.65 * F.col("score") + 0.35 * F.col("residual"), -1, 1)).otherwise(F.col("score"))
    confidence = F.when(F.coalesce("contested", F.lit(False)), F.col("confidence") * 0.7).otherwise(F.col("confidence"))
    return rows.withColumns({"score": score, "confidence": confidence}).drop("residual", "contested")


def action(score: str = "score", size: str = "size") -> Column:
    return F.when((F.col(score) > 0.05) & (F.col(size) > 0), "BUY").when(F.col(score) > 0.05, "HOLD").otherwise("FLAT")


def _line(agent: Column, stance: Column, confidence: Column, abstained: Column) -> Column:
    return F.when(abstained, F.concat(agent, F.lit(": abstains"))).otherwise(F.format_string("%s: stance %+.2f, confidence %.2f", agent, stance, confidence))


def brief(opinions: DataFrame) -> DataFrame:
    """One line for each agent of a symbol and day, abstainers too, in the order of names."""
    line = _line(*(F.col(c) for c in ("agent", "stance", "confidence", "abstained")))
    return opinions.groupBy("symbol", "date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("agent", line.alias("line")))), lambda x: x["line"]), "\n").alias("brief"))


def brief_beside(agents: tuple[str, ...]) -> Column:
    """brief for opinions that stand beside each other."""
    parts = {a: [F.col(f"{a}_{c}") for c in ("stance", "confidence", "abstained")] for a in sorted(agents)}
    return F.concat_ws("\n", *(F.when(p[2].isNotNull(), _line(F.lit(a), *p)) for a, p in parts.items()))


def rationale(decisions: DataFrame, briefs: DataFrame | None = None) -> DataFrame:
    """briefs: None where the decisions have theirs."""
    head = F.format_string("%s at score %+.3f, size %.4f", "action", "score", "size")
    rows = decisions if briefs is None else decisions.join(briefs, ["symbol", "date"], "left")
    return rows.withColumn("rationale", F.concat_ws(" | ", head, F.replace("brief", F.lit("\n"), F.lit("; ")), F.when(F.col("debated"), "debated"))).drop("brief")
