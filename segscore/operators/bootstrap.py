"""Cluster bootstrap over contracts: weights in long form, metrics as sums of pre-aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from .metrics import ap_of_counts, n_if, prf, ratio
from .ordered import numbered


def weights(contracts: DataFrame, key: str, stratum: str | None, resamples: int, stream: str) -> DataFrame:
    """(resample, key, w): in every stratum as many draws with replacement as it has contracts; w = 0 is left out.

    Without a stratum all contracts are one. The rows are resamples x contracts, spread by resample and contract.
    """
    rows = contracts.select(key, (F.col(stratum) if stratum else F.lit(0)).alias("_s")).distinct()
    placed = numbered(rows, key, "_s")
    slots = placed.select("_s", "_n", F.col("_i").alias("_slot"))
    drawn = slots.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_pick", draw(stream, "resample", "_s", "_slot") % F.col("_n"))
    counts = drawn.groupBy("resample", "_s", "_pick").agg(F.count("*").alias("w"))
    return counts.join(placed.select("_s", F.col("_i").alias("_pick"), key), ["_s", "_pick"]).select("resample", key, "w")


def resampled(counts: DataFrame, w: DataFrame, key: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Weighted sums of additive counts per resample and `keys`."""
    return w.join(counts, key).groupBy("resample", *keys).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in sums))


def resampled_f1(counts: DataFrame, w: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(resample, macro_f1, micro_f1): labels without support in a resample are left out of it."""
    rows = prf(resampled(counts, w, key, [label], ["tp", "fp", "fn"])).where("support > 0")
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return rows.groupBy("resample").agg(F.avg("f1").alias("macro_f1"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def resampled_family(counts: DataFrame, none: DataFrame, w: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(resample, metric, v): per label precision (0 without a prediction), recall and f1 (null without support), and
    none_fp_rate (null without a segment that has no label); none: key, none, none_fp."""
    rows = prf(resampled(counts, w, key, [label], ["tp", "fp", "fn"]))
    seen = lambda c: F.when(F.col("support") > 0, F.col(c))
    each = F.array(*(F.struct(F.concat(F.lit(f"{c}:"), F.col(label)).alias("metric"), v.alias("v")) for c, v in (("precision", F.col("precision")), ("recall", seen("recall")), ("f1", seen("f1")))))
    rate = resampled(none, w, key, [], ["none", "none_fp"]).select("resample", F.lit("none_fp_rate").alias("metric"), ratio(F.col("none_fp"), F.col("none")).alias("v"))
    return rows.select("resample", F.explode(each).alias("x")).select("resample", "x.metric", "x.v").unionByName(rate)


def resampled_ap(rows: DataFrame, w: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(resample, keys, ap): average precision with every row counted as often as its contract was drawn; rows of one
    contract, key and score are summed before they meet the resamples."""
    at = rows.groupBy(key, *keys, "p").agg(n_if(F.col("y")).alias("_pos"), F.count("*").alias("_all"))
    drawn = w.join(at, key).groupBy("resample", *keys, "p").agg(F.sum(F.col("w") * F.col("_pos")).alias("pos"), F.sum(F.col("w") * F.col("_all")).alias("n"))
    return ap_of_counts(drawn, ["resample", *keys])


def long_interval(values: DataFrame, level: float = 0.95) -> DataFrame:
    """metric, low, high, n from rows (resample, metric, v): percentiles over the resamples that define the metric."""
    a = (1 - level) / 2
    return values.groupBy("metric").agg(F.percentile("v", F.lit(a)).alias("low"), F.percentile("v", F.lit(1 - a)).alias("high"), F.count("v").alias("n"))


def verdict(claims: DataFrame) -> DataFrame:
    """One row, verdict: what all co-primary metrics claim, where that is the same and not "none"; else "per metric" and each
    one's claim, in the metrics' order. claims: metric, claim; a null claim counts as "none"."""
    told = claims.select("metric", F.coalesce("claim", F.lit("none")).alias("claim"))
    each = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("metric", "claim"))), lambda x: F.concat_ws(" ", x["metric"], x["claim"])), ", ")
    one = (F.countDistinct("claim") == 1) & (F.first("claim") != "none")
    return told.agg(F.when(one, F.first("claim")).otherwise(F.concat(F.lit("per metric: "), each)).alias("verdict"))


def interval(values: DataFrame, columns: list[str], level: float = 0.95) -> DataFrame:
    """metric, low, high, n: percentile interval over the resamples in which the metric is defined."""
    a = (1 - level) / 2
    long = values.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.percentile("v", F.lit(a)).alias("low"), F.percentile("v", F.lit(1 - a)).alias("high"), F.count("v").alias("n"))


def claim(low: Column, high: Column) -> Column:
    return F.when(low > 0, "A").when(high < 0, "B").otherwise("none")


def paired(a: DataFrame, b: DataFrame, columns: list[str], family: int) -> DataFrame:
    """metric, low, high, n, claim of a - b over equal resamples, at the level that a family of tests leaves."""
    right = b.select("resample", *(F.col(c).alias(f"_{c}") for c in columns))
    diff = a.join(right, "resample").select("resample", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in columns))
    return interval(diff, columns, 1 - 0.05 / family).withColumn("claim", claim(F.col("low"), F.col("high")))
