"""An extension: drift of a stream's micro-batches against a frozen reference, by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import js_distance, psi, two_sides


def batch_drift(batch: DataFrame, reference: DataFrame, bin_: str, bins: int) -> DataFrame:
    """One row: rows, psi and js of a batch's bins against the reference's."""
    both = batch.select(F.lit(1).alias("side"), bin_).unionByName(reference.select(F.lit(0).alias("side"), bin_))
    hist = two_sides(both, "side", bin_)
    return psi(hist, bins).crossJoin(js_distance(hist)).crossJoin(batch.agg(F.count("*").alias("n")))


def monitor(stream: DataFrame, reference: DataFrame, bin_: str, bins: int, out: str, checkpoint: str) -> StreamingQuery:
    """Writes batch_drift() of every micro-batch; a batch that is run again writes the folder of its number anew."""

    def one(batch: DataFrame, number: int) -> None:
        batch_drift(batch, reference, bin_, bins).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
