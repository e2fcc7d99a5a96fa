"""Drift statistics of a batch against a reference, and p-values against a null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw
from .metrics import ratio
from .ordered import running

EPS = 1e-4


def two_sides(rows: DataFrame, side: str, bin_: str, keys: list[str] = ()) -> DataFrame:
    """keys, bin, b, r: counts of the batch (side = 1) and the reference (side = 0) in every bin that either has."""
    one = lambda v: F.sum(F.when(F.col(side) == v, 1).otherwise(0)).cast("double")
    return rows.groupBy(*keys, bin_).agg(one(1).alias("b"), one(0).alias("r"))


def psi(hist: DataFrame, bins: int) -> DataFrame:
    """Population stability index of one pair of histograms (b, r) with `bins` bins, absent ones being empty."""
    s = hist.agg(F.sum("b").alias("_tb"), F.sum("r").alias("_tr"), F.count("*").alias("_k"))
    p, q = (F.col("b") + EPS) / (F.col("_tb") + bins * EPS), (F.col("r") + EPS) / (F.col("_tr") + bins * EPS)
    empty = F.lit(EPS) / (F.col("_tb") + bins * EPS), F.lit(EPS) / (F.col("_tr") + bins * EPS)
    rest = (bins - F.first("_k")) * F.first((empty[0] - empty[1]) * F.log(empty[0] / empty[1]))
    total = F.sum((p - q) * F.log(p / q)) + rest
    return hist.crossJoin(s).agg(F.when((F.first("_tb") > 0) & (F.first("_tr") > 0), total).alias("psi"))


def js_distance(hist: DataFrame) -> DataFrame:
    """Jensen-Shannon distance, base 2; null where a side is empty."""
    s = hist.agg(F.sum("b").alias("_tb"), F.sum("r").alias("_tr"))
    p, q = ratio(F.col("b"), F.col("_tb")), ratio(F.col("r"), F.col("_tr"))
    m = (p + q) / 2
    kl = lambda a: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    return hist.crossJoin(s).agg(F.when((F.first("_tb") > 0) & (F.first("_tr") > 0), F.sqrt(F.greatest((F.sum(kl(p)) + F.sum(kl(q))) / 2, F.lit(0.0)))).alias("js"))


def cosine_of_sums(vectors: DataFrame, side: str, index: str, value: str) -> DataFrame:
    """1 - cosine of the summed vectors of both sides; rows are (side, index, value)."""
    s = vectors.groupBy(index).agg(F.sum(F.when(F.col(side) == 1, F.col(value)).otherwise(0.0)).alias("_b"), F.sum(F.when(F.col(side) == 0, F.col(value)).otherwise(0.0)).alias("_r"))
    return s.agg((1 - F.try_divide(F.sum(F.col("_b") * F.col("_r")), F.sqrt(F.sum(F.col("_b") * F.col("_b")) * F.sum(F.col("_r") * F.col("_r"))))).alias("cosine_distance"))


def leave_out(sums: DataFrame, w: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """batch, and per column the batch's weighted sum and the total less it."""
    total = sums.agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    batch = w.join(sums, key).groupBy("batch").agg(*(F.sum(F.col("w") * F.col(c)).alias(f"b_{c}") for c in columns))
    return batch.crossJoin(total).select("batch", *(F.col(f"b_{c}") for c in columns), *((F.col(f"_{c}") - F.col(f"b_{c}")).alias(f"r_{c}") for c in columns))


def upper_p(null: DataFrame, values: DataFrame, id_: str, v: str, counted: bool = False) -> DataFrame:
    """id, v, p = (1 + null values at or above v) / (N + 1); a null v gives 1 or, where it is `counted`, has no null value at or
    above it, as a comparison in SQL finds none.

    The null is counted per distinct value, and values are merged into its order: one sort of both, no pairwise join.
    """
    marks = null.where(F.col(v).isNotNull()).groupBy(v).agg(F.count("*").alias("_n")).select(F.col(v).alias("_v"), "_n")
    points = values.where(F.col(v).isNotNull()).select(F.col(v).alias("_v")).distinct().withColumn("_n", F.lit(0).cast("long"))
    both = marks.unionByName(points).groupBy("_v").agg(F.sum("_n").alias("_n"))
    upto = running(both, ["_v"], {"_ge": "_n"}, descending=True)
    n = null.agg(F.count("*").alias("_total"))
    joined = values.join(upto.drop("_n"), F.col(v) == F.col("_v"), "left").crossJoin(n)
    return joined.select(id_, v, ((1 + F.coalesce("_ge", F.lit(0) if counted else F.col("_total"))) / (F.col("_total") + 1)).alias("p"))


def leave_one_out_p(null: DataFrame, v: str, out: str) -> DataFrame:
    """The null's own members: the share of members at or above each; null values lie under all others."""
    counts = running(null.groupBy(v).agg(F.count("*").alias("_n")), [v], {"_upto": "_n"})
    share = counts.crossJoin(F.broadcast(null.agg(F.count("*").alias("_total")))).select(F.col(v).alias("_v"), (1 - (F.col("_upto") - F.col("_n")) / F.col("_total")).alias(out))
    return null.join(share, F.col(v).eqNullSafe(F.col("_v"))).drop("_v")


def tie_safe_threshold(scores: DataFrame, score: str, alpha: float) -> DataFrame:
    """The largest attained score whose share at or below it is at most alpha; null where none is."""
    counts = running(scores.groupBy(score).agg(F.count("*").alias("_n")), [score], {"_upto": "_n"})
    share = counts.crossJoin(F.broadcast(scores.agg(F.count("*").alias("_total")))).withColumn("_share", F.col("_upto") / F.col("_total"))
    return share.where(F.col("_share") <= alpha).agg(F.max(score).alias("threshold"), F.max("_share").alias("null_share"))


def min_p(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with min_p, the least p-value of a family; null members count as 1."""
    return rows.withColumn("min_p", F.least(*(F.coalesce(F.col(c), F.lit(1.0)) for c in columns)))


def nested_batches(members: DataFrame, key: str, value: str, k: int, n: int, stream: str) -> DataFrame:
    """resample, batch, value: the means of n batches of k copies each, drawn without replacement inside every resample.

    members: resample, key, w, value. Work is dealt by resample and batch.
    """
    copies = members.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    order = W.partitionBy("resample", "batch").orderBy(draw(stream, "resample", "batch", key, "_copy"), key, "_copy")
    taken = copies.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return taken.groupBy("resample", "batch").agg(F.avg(value).alias(value))


def detected(intervals: DataFrame, name: str = "part") -> DataFrame:
    """One row, detected: the lower bound of "shift" lies above the upper bound of "test"."""
    bound = lambda part, c: F.max(F.when(F.col(name) == part, F.col(c)))
    return intervals.agg((bound("shift", "low") > bound("test", "high")).alias("detected"))
