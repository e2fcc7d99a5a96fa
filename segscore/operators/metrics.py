"""Multi-label scoring on the long form: one row per (segment, label) with y, p and pred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running


def n_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def label_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """Additive statistics: tp, fp, fn. Sums of these answer every F-measure, so resamples reuse them."""
    y, pred = F.col("y"), F.col("pred")
    return long.groupBy(*keys).agg(n_if(y & pred).alias("tp"), n_if(~y & pred).alias("fp"), n_if(y & ~pred).alias("fn"))


def none_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: segments, those without a true label, and of these the ones with a prediction."""
    seg = long.groupBy(*keys, "segment_id").agg(F.bool_or("y").alias("any_y"), F.bool_or("pred").alias("any_p"))
    return seg.groupBy(*keys).agg(F.count("*").alias("segments"), n_if(~F.col("any_y")).alias("none"), n_if(~F.col("any_y") & F.col("any_p")).alias("none_fp"))


def prf(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 (0 where undefined), support, predicted from tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return counts.withColumns({"precision": F.coalesce(ratio(tp, tp + fp), zero), "recall": F.coalesce(ratio(tp, tp + fn), zero), "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero), "support": tp + fn, "predicted": tp + fp})


def macro_micro(counts: DataFrame, keys: list[str]) -> DataFrame:
    """macro_f1 over labels with support, micro_f1 / precision / recall of their sums."""
    rows = prf(counts).where("support > 0")
    s = {c: F.sum(c) for c in ("tp", "fp", "fn")}
    agg = [F.avg("f1").alias("macro_f1"), F.coalesce(ratio(2 * s["tp"], 2 * s["tp"] + s["fp"] + s["fn"]), F.lit(0.0)).alias("micro_f1"), F.coalesce(ratio(s["tp"], s["tp"] + s["fp"]), F.lit(0.0)).alias("micro_precision"), F.coalesce(ratio(s["tp"], s["tp"] + s["fn"]), F.lit(0.0)).alias("micro_recall")]
    return rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)


def average_precision(long: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Sum over distinct scores, downward, of recall gained times precision there. Rows of one score count at once."""
    w = F.col(weight) if weight else F.lit(1)
    return ap_of_counts(long.groupBy(*keys, "p").agg(F.sum(F.when(F.col("y"), w).otherwise(0)).alias("pos"), F.sum(w).alias("n")), keys)


def ap_of_counts(at: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap from one row per key and score: pos of its n rows are true."""
    down = W.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    curve = at.withColumns({"tp": F.sum("pos").over(down), "seen": F.sum("n").over(down)})
    return curve.groupBy(*keys).agg(ratio(F.sum(F.col("pos") * ratio(F.col("tp"), F.col("seen"))), F.sum("pos")).alias("ap"))


def calibration_bins(long: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """n, sum_p, sum_y per bin of p; the last bin is closed."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return long.groupBy(*keys, bin_).agg(F.count("*").alias("n"), F.sum("p").alias("sum_p"), n_if(F.col("y")).alias("sum_y"))


def ece(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error: the bins' |sum of y - sum of p| over all rows."""
    agg = ratio(F.sum(F.abs(F.col("sum_y") - F.col("sum_p"))), F.sum("n")).alias("ece")
    return bins.groupBy(*keys).agg(agg) if keys else bins.agg(agg)


def cross_entropy(rows: DataFrame, keys: list[str], floor: float = 1e-6) -> DataFrame:
    """keys, prior_bce, bce: of the prior q alone and of the scores p, kept off 0 and 1 by `floor`."""
    p = F.least(F.greatest(F.col("p"), F.lit(floor)), F.lit(1 - floor))
    loss = lambda x: F.avg(-F.when(F.col("y"), F.log(x)).otherwise(F.log(1 - x)))
    return rows.groupBy(*keys).agg(loss(F.col("q")).alias("prior_bce"), loss(p).alias("bce"))


def confusion_pairs(long: DataFrame) -> DataFrame:
    """(true_label, predicted_label, n): a false positive beside a true label of the same segment."""
    true = long.where("y").select("segment_id", F.col("label").alias("true_label"))
    wrong = long.where("pred and not y").select("segment_id", F.col("label").alias("predicted_label"))
    return true.join(wrong, "segment_id").groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))


def kappa(df: DataFrame, x: str, y: str) -> DataFrame:
    """agreement and Cohen's kappa of two 0/1 columns; null where chance agreement is certain."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.agg(F.avg((a == b).cast("double")).alias("agreement"), F.avg(a).alias("_a"), F.avg(b).alias("_b"), F.count("*").alias("n"))
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return m.select("n", "agreement", F.try_divide(F.col("agreement") - chance, 1 - chance).alias("kappa"))


def exact_mean(value: Column) -> Column:
    """The mean to ten places by decimals, so that it doesn't hang on the order of rows and ties are told; by doubles where a
    value or the sum is out of their range."""
    told = value.try_cast("decimal(28,10)")
    total = F.when(F.count(told) == F.count(value), F.try_sum(told))
    return F.coalesce(F.try_divide(total, F.count(value)).cast("double"), F.avg(value))


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean, by running counts of distinct values; nulls are one tie, after all others."""
    counts = running(df.groupBy(column).agg(F.count("*").alias("_n")).withColumn("_null", F.col(column).isNull()), ["_null", column], {"_upto": "_n"})
    ranks = counts.select(F.col(column).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return average_rank(average_rank(df.where(F.col(x).isNotNull()), x, "_rx").where(F.col(y).isNotNull()), y, "_ry").agg(F.corr("_rx", "_ry").alias("spearman"))
