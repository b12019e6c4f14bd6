"""Chart data: lines, ticks and titles, instead of pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.fixed_values import (
    CHART_FOLDER, CHART_NAME_PREFIX, CHART_TITLE, CHART_X_LABEL, CHART_Y_LABEL, TICK_MINUTES, WINDOW_HOURS,
)
from fleetwatch.functions.text import fill
from fleetwatch.operators.series import BY, VALUE
from fleetwatch.operators.skew import join_table
from fleetwatch.session import Table


def series_label() -> Column:
    return F.concat_ws("-", "pod", "node")


def chart_series(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per point of each line."""
    return rows.select(*by, series_label().alias("label"), "timestamp", F.col(VALUE).alias("value"))


def chart_ticks(windows: DataFrame, minutes: int = TICK_MINUTES, by: Sequence[str] = BY) -> DataFrame:
    """Times at which the axis of each service is marked, from window start to end."""
    step = F.make_dt_interval(mins=F.lit(minutes))
    every = F.sequence(F.col("window_start"), F.col("window_end"), step)
    return windows.select(*by, F.explode(every).alias("tick")).withColumn(
        "tick_label", F.substring(F.col("tick").cast("string"), 1, 16)  # date_format() would go through the session's time zone
    )


def chart_meta(windows: DataFrame, hours: float = WINDOW_HOURS, by: Sequence[str] = BY) -> DataFrame:
    """Title, axis names and storage names of each service's chart."""
    name = F.concat(F.lit(CHART_NAME_PREFIX), F.col("service"))
    return windows.select(
        *by,
        fill(CHART_TITLE, {"service": F.col("service"), "hours": F.lit(f"{hours:g}")}).alias("title"),
        F.lit(CHART_X_LABEL).alias("x_label"),
        F.lit(CHART_Y_LABEL).alias("y_label"),
        name.alias("object_name"),
        F.concat(F.lit(CHART_FOLDER), name).alias("object_key"),
    )


def anomalous_series(series: DataFrame, anomalies: Table, by: Sequence[str] = BY) -> DataFrame:
    """Lines of the services with an anomaly; ``anomalies`` holds each such service once."""
    return join_table(series, anomalies, by, how="left_semi")
