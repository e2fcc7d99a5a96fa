"""Threshold tuning on the grid 0.01 .. 0.99: one histogram pass, then running sums over 99 bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import n_if, ratio


def grid_bin(p: Column) -> Column:
    """The largest i with i / 100.0 <= p, by the same doubles that thresholds are compared with."""
    guess = F.floor(p * 100).cast("int")
    return F.when((guess + 1) / F.lit(100.0) <= p, guess + 1).when(guess / F.lit(100.0) > p, guess - 1).otherwise(guess)


def grid(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, t, tp, fp, positives for every threshold t = i / 100."""
    hist = long.groupBy(*keys, F.least(grid_bin(F.col("p")), F.lit(99)).alias("i")).agg(n_if(F.col("y")).alias("_pos"), n_if(~F.col("y")).alias("_neg"))
    every = long.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99))))
    full = every.join(hist, [*keys, "i"], "left").na.fill(0, ["_pos", "_neg"])
    down = W.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    sums = full.withColumns({"tp": F.sum("_pos").over(down), "fp": F.sum("_neg").over(down), "positives": F.sum("_pos").over(W.partitionBy(*keys))})
    return sums.where("i >= 1").select(*keys, "i", (F.col("i") / F.lit(100.0)).alias("t"), "tp", "fp", "positives")


def best_f1(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the threshold of the best F1; ties go to the one nearest 0.5, then the lower."""
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), F.lit(0.0))
    order = F.struct(F.col("f1"), -F.abs(F.col("i") - 50), -F.col("i"))
    best = grid(long, keys).withColumn("f1", f1).groupBy(*keys).agg(F.max_by(F.struct("t", "f1"), order).alias("_b"))
    return best.select(*keys, F.col("_b.t").alias("threshold"), F.col("_b.f1").alias("best_f1"))


def pooled(long: DataFrame, labels: list[str]) -> DataFrame:
    """Labels with one threshold each; those in `labels` share the best one of all their rows together."""
    own = best_f1(long.where(~F.col("label").isin(labels)), ["label"])
    shared = best_f1(long.where(F.col("label").isin(labels)).select(F.lit("pool").alias("pool"), "p", "y"), ["pool"])
    members = long.where(F.col("label").isin(labels)).select("label").distinct()
    return own.unionByName(members.crossJoin(shared.drop("pool")))  # shared is one row


def high_recall(long: DataFrame, rule: DataFrame, target: float = 0.9) -> DataFrame:
    """label, t90, threshold = min(rule's, t90), recall there. No positives: the rule's threshold, recall null."""
    g = grid(long, ["label"])
    t90 = g.groupBy("label").agg(F.coalesce(F.max(F.when(ratio(F.col("tp"), F.col("positives")) >= target, F.col("t"))), F.lit(0.01)).alias("t90"), F.max("positives").alias("positives"))
    chosen = t90.join(rule.select("label", F.col("threshold").alias("rule_b")), "label")
    chosen = chosen.withColumn("threshold", F.when(F.col("positives") == 0, F.col("rule_b")).otherwise(F.least("rule_b", "t90")))
    at = g.select("label", F.col("t").alias("threshold"), ratio(F.col("tp"), F.col("positives")).alias("recall"))
    return chosen.join(at, ["label", "threshold"], "left").select("label", "rule_b", "t90", "threshold", "recall")


def applied(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """long with pred = p >= its label's threshold; labels are few by nature, their table is one row each."""
    return long.join(thresholds.select("label", "threshold"), "label").withColumn("pred", F.col("p") >= F.col("threshold"))


def near_best(grid_rows: DataFrame, score: str, second: str, simple: list[str], room: float = 0.005) -> DataFrame:
    """Of the rows within `room` of the best score: the best second score, then the simplest."""
    top = grid_rows.agg(F.max(score).alias("_top"))
    return grid_rows.crossJoin(top).where(F.col(score) >= F.col("_top") - room).drop("_top").orderBy(F.desc(second), *simple).limit(1)
