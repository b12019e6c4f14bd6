"""Anomaly, chart and status tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.operators.series import BY


def write_charts(series: DataFrame, folder: str, by: Sequence[str] = BY) -> None:
    """Chart lines in one folder per service. Services that are written replace what they had; others stay."""
    (
        series.hint("rebalance", *by)  # few files per service, and several tasks for a big one
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(folder)
    )


def write_report(found: DataFrame, folder: str, order: Sequence[str] = ("service", "pod")) -> None:
    """Abnormal pods, sorted."""
    found.orderBy(*order).write.mode("overwrite").parquet(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def results_json(results: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("result"))
