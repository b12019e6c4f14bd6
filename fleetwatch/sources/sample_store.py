"""A store of samples in folders of day and service range, of which a windowed analysis reads only what lies in its windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.operators.series import SAMPLE_DAY, SERVICE_RANGE, STORE_KEYS, service_range_of

SAMPLE_SCHEMA = "service string, pod string, node string, timestamp timestamp_ntz, cpuusage double, seq bigint"


def write_sample_store(samples: DataFrame, folder: str) -> None:
    """Add typed samples to a store. Samples without a time lie in a folder of their own."""
    placed = samples.withColumns({SAMPLE_DAY: F.to_date("timestamp"), SERVICE_RANGE: service_range_of("service")})
    # few files a folder, and several tasks for one with very many samples
    placed.hint("rebalance", *STORE_KEYS).write.mode("append").partitionBy(*STORE_KEYS).parquet(folder)


def read_sample_store(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of a store, with their day and service range: cuts to windows use these to leave folders out."""
    return spark.read.schema(f"{SAMPLE_SCHEMA}, {SAMPLE_DAY} date, {SERVICE_RANGE} int").parquet(folder)
