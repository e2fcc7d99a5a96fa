"""Running sums and places in an order of many rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.written import written


def running(rows: DataFrame, order: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """rows with the sum of a column up to and with each row, by the order of distinct `order`; sums: new column -> column.

    Rows are dealt out by ranges of the order and written, summed up inside their range, and only the ranges' sums, one row
    each, go through one ordered pass.
    """
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *by).withColumn("_b", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_b").agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())))
    before = totals.select("_b", *((F.sum(f"_s{i}").over(W.orderBy("_b")) - F.col(f"_s{i}")).alias(f"_p{i}") for i in range(len(sums))))
    inside = W.partitionBy("_b").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(before), "_b")  # a row per range
    return joined.select(*rows.columns, *((F.col(f"_p{i}") + F.sum(c).over(inside)).alias(out) for i, (out, c) in enumerate(sums.items())))


def numbered(rows: DataFrame, key: str, stratum: str) -> DataFrame:
    """rows with _i, their place by key in their stratum from 0, and _n, its size; no stratum is brought into one task.

    Rows are dealt out by ranges of stratum and key and written, so that what they come from is computed once; they are
    numbered inside a range, and only the ranges' counts go through an ordered sum. Places don't depend on the ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, stratum, key).withColumn("_b", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    before = counts.select(stratum, "_b", (F.sum("_c").over(W.partitionBy(stratum).orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy(stratum)).alias("_n"))
    inside = F.row_number().over(W.partitionBy(stratum, "_b").orderBy(key)) - 1
    return ranged.withColumn("_r", inside).join(before, [stratum, "_b"]).withColumn("_i", (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_before")
