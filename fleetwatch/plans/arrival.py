"""One run for the file a notification announces."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fleetwatch.operators.answers import failed_status
from fleetwatch.plans.batch import Report, run_files
from fleetwatch.sinks.tables import write_json
from fleetwatch.sources.notifications import notification_keys


def announced_path(spark: SparkSession, notice: str, address: str = "s3a://{bucket}/{key}") -> str:
    """Path of the first file of one notification."""
    row = notification_keys(spark.createDataFrame([(notice,)], "body string")).first()
    if row.bucket is None or row.key is None:
        raise ValueError("The notification names no file")
    return address.format(bucket=row.bucket, key=row.key)


def run_notice(spark: SparkSession, notice: str, out: str, address: str = "s3a://{bucket}/{key}", **options) -> Report:
    """Charts show the window, the analysis covers the full file. A notice that names no file leaves a failed status, too."""
    options.setdefault("scope", "full")
    try:
        path = announced_path(spark, notice, address)
    except Exception as error:
        write_json(failed_status(spark, error), f"{out}/status")
        raise
    return run_files(spark, path, out, **options)
