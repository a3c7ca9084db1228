"""Backtest and classification metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthline.operators.carry import lagged, numbered, running

#: Seconds of a trading year, under the root: what turns a per-second ratio into a yearly one.
YEARLY = math.sqrt(252 * 6.5 * 3600)
_RANGES = 1000


def positions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``position``: 1 over the threshold, -1 under its mirror, else 0."""
    return scored.withColumn("position", F.when(F.col("prob") > threshold, 1).when(F.col("prob") < 1 - threshold, -1).otherwise(0))


def turnover(rows: DataFrame) -> DataFrame:
    """Adds ``turnover``: the change of position, the first from 0."""
    kept = running(rows, previous={"_before": F.col("position")})
    return kept.withColumn("turnover", F.abs(F.col("position") - F.coalesce("_before", F.lit(0)))).drop("_before")


def strategy(rows: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Adds ``strategy_ret`` and ``equity`` (the running product of 1 + return)."""
    out = turnover(rows).withColumn("strategy_ret", F.col("position") * F.coalesce("next_return_1", F.lit(0.0)) - F.col("turnover") * F.lit(cost_bps * 1e-4))
    return running(out, products={"equity": 1 + F.col("strategy_ret")})


def backtest_summary(rows: DataFrame) -> DataFrame:
    """A row per instrument from ``strategy`` rows."""
    ret = F.coalesce("next_return_1", F.lit(0.0))
    return rows.groupBy("instrument").agg(
        F.round(F.avg("strategy_ret") / F.greatest(F.stddev_pop("strategy_ret"), F.lit(1e-12)) * YEARLY, 3).alias("sharpe"),
        F.round(F.avg(((F.col("position") > 0) == (ret > 0)).cast("double")), 4).alias("hit_rate"),
        F.round(F.max_by("equity", "pos") - 1, 4).alias("total_return"),
        F.round(F.max("equity") - 1, 4).alias("max_drawdown"),
        F.sum(F.abs("position")).cast("bigint").alias("n_trades"),
        F.round(F.avg((F.col("position") == 1).cast("double")), 4).alias("long_pct"),
        F.round(F.avg((F.col("position") == -1).cast("double")), 4).alias("short_pct"),
    )


def direction_pnl(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``reward``: 1 for a right direction, -1 for a wrong one, and its running sum in basis points."""
    side = F.when(F.col("prob") > threshold, 1).otherwise(-1)
    rows = scored.withColumn("reward", F.when((side == 1) == (F.col("y") == 1), 1).otherwise(-1))
    return running(rows, sums={"curve": F.col("reward").cast("long")}).withColumn("curve", F.col("curve") * F.lit(1e-4))


def evaluation(scored: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """Per model (``by``) or in one row: Sharpe of right and wrong directions, and share of right ones."""
    side = F.when(F.col("prob") > threshold, 1).otherwise(-1)
    reward = F.when((side == 1) == (F.col("y") == 1), 1.0).otherwise(-1.0)
    return scored.groupBy(*by).agg((F.avg(reward) / F.greatest(F.stddev_pop(reward), F.lit(1e-12)) * YEARLY).alias("sharpe"), F.avg((reward > 0).cast("double")).alias("right"), F.count(F.lit(1)).alias("n"))


def live_accuracy(rows: DataFrame, lag: int = 5) -> DataFrame:
    """Delayed scoring: each row scores the prediction made ``lag`` rows before against the mid's move since."""
    out = lagged(numbered(rows), {"old_prob": "prob", "old_mid": "midprice"}, lag).drop("_n").where("old_prob IS NOT NULL")
    right = ((F.col("old_prob") > 0.5) == (F.col("midprice") > F.col("old_mid"))).cast("bigint")
    out = running(out.withColumn("right", right), sums={"seen": F.lit(1).cast("bigint"), "hits": F.col("right")})
    return out.withColumns({"accuracy": F.col("hits") / F.col("seen"), "pnl": 2 * F.col("hits") - F.col("seen")})


def ranked(scored: DataFrame) -> DataFrame:
    """``prob, pos_n, neg_n, pos_below, neg_below``: counts at and under each different score.

    Scores are summed by value, then added up in ranges of the score, so no window spans
    the whole table.
    """
    by = scored.groupBy("prob").agg(F.sum((F.col("y") == 1).cast("bigint")).alias("pos_n"), F.sum((F.col("y") != 1).cast("bigint")).alias("neg_n")).withColumn("range", F.floor(F.col("prob") * _RANGES))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = by.groupBy("range").agg(F.sum("pos_n").alias("p"), F.sum("neg_n").alias("n")).select("range", zero(F.sum("p").over(w)).alias("p0"), zero(F.sum("n").over(w)).alias("n0"))
    inner = Window.partitionBy("range").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    return by.join(base, "range").select("prob", "pos_n", "neg_n", (F.col("p0") + zero(F.sum("pos_n").over(inner))).alias("pos_below"), (F.col("n0") + zero(F.sum("neg_n").over(inner))).alias("neg_below"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by ranks; ties count half; null without both classes. One row."""
    r = ranked(scored)
    wins = F.sum(F.col("pos_n") * (F.col("neg_below") + F.col("neg_n") / 2))
    return r.agg(F.try_divide(wins, F.sum("pos_n").cast("double") * F.sum("neg_n")).alias("auc"))


def roc_points(scored: DataFrame) -> DataFrame:
    """``prob, fpr, tpr``: one point per different score, from the highest."""
    r = ranked(scored)
    total = r.agg(F.sum("pos_n").alias("p"), F.sum("neg_n").alias("n"))
    return r.crossJoin(total).select("prob", F.try_divide(F.col("n") - F.col("neg_below"), F.col("n")).alias("fpr"), F.try_divide(F.col("p") - F.col("pos_below"), F.col("p")).alias("tpr"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    return scored.groupBy(F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.avg("prob").alias("mean_pred"), F.avg(F.col("y").cast("double")).alias("mean_label"), F.count(F.lit(1)).alias("n"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("prob") - F.col("y")) * (F.col("prob") - F.col("y"))).alias("brier"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``y, yhat, n, share`` (of the label's rows)."""
    g = scored.groupBy("y", (F.col("prob") > threshold).cast("int").alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def classification(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit, yes = F.col("y") == 1, F.col("prob") > threshold
    n = lambda c: F.sum(c.cast("bigint"))
    return scored.agg(F.avg((hit == yes).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(n(hit & yes), n(yes)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(n(hit & yes), n(hit)), F.lit(0.0)).alias("recall"))


def class_weights(scored: DataFrame) -> DataFrame:
    """Balanced weights n / (2 n_c)."""
    g = scored.groupBy("y").agg(F.count(F.lit(1)).alias("n_c"))
    return g.crossJoin(scored.agg(F.count(F.lit(1)).alias("n"))).select("y", (F.col("n") / (2.0 * F.col("n_c"))).alias("weight"))


def standard_scale(rows: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, fitted on ``fit_on`` only."""
    made = [f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    scaled = rows.crossJoin((fit_on or rows).agg(*made))
    return scaled.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])
