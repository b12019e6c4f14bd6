"""Log events by region, group and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.fixed_values import DEFAULT_REGION

STREAM_KEYS = ("region", "log_group", "log_stream")
STORED_BY = ("region", "log_group")
LOG_SCHEMA = "region string, log_group string, log_stream string, event_time timestamp_ntz, seq bigint, message string"


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Log events from JSON lines. Fields that are missing are null; a line that is no such object fails the job."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "FAILFAST").json(path)


def write_log_store(logs: DataFrame, folder: str) -> None:
    """Add log events to a store with one folder for each region and group."""
    # a group is written by few tasks, a big one by several; nothing is sorted
    logs.hint("rebalance", *STORED_BY).write.mode("append").partitionBy(*STORED_BY).parquet(folder)


def read_log_store(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a store. What is picked by region and group decides which folders are read."""
    return spark.read.schema(LOG_SCHEMA).parquet(folder).select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")])


def stored_stream_events(
    spark: SparkSession, folder: str, region: str | None = None, log_group: str | None = None, log_stream: str | None = None
) -> DataFrame:
    """Events of the picked streams of a store; where nothing is picked, of the default stream, found in the folder names first."""
    logs = read_log_store(spark, folder)
    if region is None and log_group is None and log_stream is None:
        groups = logs.select(*STORED_BY).distinct().orderBy(F.col("region") != DEFAULT_REGION, *STORED_BY).first()  # of folder names
        if groups is None:
            return logs
        region, log_group = groups
        first = logs.filter((F.col("region") == region) & (F.col("log_group") == log_group)).agg(F.min("log_stream")).first()
        log_stream = first[0]
    return log_stream_events(logs, region, log_group, log_stream)


def log_catalog(logs: DataFrame) -> DataFrame:
    """What the pickers offer: every region, group and stream once."""
    return logs.select(*STREAM_KEYS).distinct()


def default_stream(logs: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """The one stream that is picked first: the preferred region if present, then the first of each list."""
    return log_catalog(logs).orderBy((F.col("region") != region), *STREAM_KEYS).limit(1)


def log_stream_events(
    logs: DataFrame, region: str | None = None, log_group: str | None = None, log_stream: str | None = None
) -> DataFrame:
    """Events of the picked streams; where nothing is picked, of the default stream."""
    wanted = dict(zip(STREAM_KEYS, (region, log_group, log_stream)))
    for name, value in wanted.items():
        if value is not None:
            logs = logs.filter(F.col(name) == value)
    if all(v is not None for v in wanted.values()):
        return logs
    return logs.join(F.broadcast(default_stream(logs)), list(STREAM_KEYS), "left_semi")  # one row
