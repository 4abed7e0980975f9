"""Where queries may write."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULT = "file:///tmp/checkpoints/stratum"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Only where all executors are threads of the driver's machine may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or DEFAULT).rstrip("/")
