"""SparkSession with the settings every operator here assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, adaptive execution on. On a cluster leave `partitions` to the cluster's own setting and pass master=None."""
    builder = SparkSession.builder.appName("segscore")
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
