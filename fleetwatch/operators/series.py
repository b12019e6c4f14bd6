"""Series keyed by service, pod and node: grouping, statistics, common window, downsampling.

``by`` names the columns of a group of peers (by default the service). A pod is told
apart by ``by`` plus pod and node.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.fixed_values import KEEP_EVERY, WINDOW_FRACTION, WINDOW_HOURS
from fleetwatch.functions.times import MICROS_PER_HOUR, hours_between, micros_between, plus_micros
from fleetwatch.operators.ordering import positions
from fleetwatch.operators.skew import HotGroups, derived, find_hot, hot_rows, join_table
from fleetwatch.session import Table, materialise

BY = ("service",)
MEMBER = ("pod", "node")
ORDER = ("timestamp", "seq")
VALUE = "cpuusage"

# Columns of samples that come from a store in folders.
SAMPLE_DAY, SERVICE_RANGE = STORE_KEYS = ("sample_day", "service_range")
_RANGES = 16  # folders a day; stores on disk rely on it

# Spark joins small partitions of a shuffle by their bytes, of which samples have few and their sorts many.
FEW_ROWS = 400_000  # samples that one task may well order
TASK_ROWS = 200_000   # samples of a partition where there are more


def series_keys(by: Sequence[str] = BY) -> list[str]:
    return [*by, *MEMBER]


def keyed(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Samples that belong to a series: no part of the key is missing."""
    return samples.dropna(subset=series_keys(by))


def group_sizes(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return keyed(samples, by).groupBy(*series_keys(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(VALUE).alias("n_values"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def _statistics() -> list[Column]:
    return [
        F.avg(VALUE).alias("mean"),
        F.max(VALUE).alias("max"),
        F.min(VALUE).alias("min"),
        F.stddev_samp(VALUE).alias("std"),
    ]


def group_stats(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Mean, maximum, minimum and sample standard deviation per pod, in one pass."""
    return keyed(samples, by).groupBy(*series_keys(by)).agg(*_statistics())


def profile(samples: DataFrame, by: Sequence[str] = BY) -> Table:
    """Sizes and ends of all series as a written table: the one extra pass over the samples that planning needs."""
    return materialise(group_sizes(samples, by), largest="n_rows")


def service_range(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """First and last time of each service over all its pods, and the hours between."""
    return _with_span(
        keyed(samples, by).groupBy(*by).agg(
            F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")
        )
    )


def _with_span(ends: DataFrame) -> DataFrame:
    return ends.withColumn("span_hours", hours_between("first_time", "last_time"))


def service_window(samples: DataFrame, hours: float = WINDOW_HOURS, by: Sequence[str] = BY) -> DataFrame:
    """The common window of each service.

    A service that spans more than ``hours`` gets a window of exactly that length, which
    starts after a fixed share of the spare time; any other keeps its whole span.
    """
    return _window_of(service_range(samples, by), hours, by)


def _window_of(ends: DataFrame, hours: float, by: Sequence[str]) -> DataFrame:
    length = F.lit(round(hours * MICROS_PER_HOUR)).cast("bigint")
    span = micros_between("first_time", "last_time")
    shift = F.rint((span - length) * F.lit(WINDOW_FRACTION)).cast("bigint")
    is_long = span > length
    start = F.when(is_long, plus_micros("first_time", shift)).otherwise(F.col("first_time"))
    return ends.withColumn("window_start", start).select(
        *by,
        "window_start",
        F.when(is_long, plus_micros("window_start", length)).otherwise(F.col("last_time")).alias("window_end"),
    )


def window_bounds(profiled: Table, hours: float = WINDOW_HOURS, by: Sequence[str] = BY) -> Table:
    """The windows of all services, from the profile of their series."""
    ends = profiled.df.groupBy(*by).agg(F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    return derived(_window_of(ends, hours, by), profiled)


def window_cut(samples: DataFrame, bounds: Table, by: Sequence[str] = BY) -> DataFrame:
    """Samples inside the window of their service, both ends included.

    The ends of all windows together are known before: as fixed times they reach the scan,
    which can leave out files and row groups beyond them. Of samples from a store in folders
    each service's own days are read, wherever its window lies.
    """
    if set(STORE_KEYS) <= set(samples.columns):
        return _stored_cut(samples, bounds, by)
    inside = F.col("timestamp").between(F.col("window_start"), F.col("window_end"))
    first, last = bounds.df.agg(F.min("window_start"), F.max("window_end")).first()
    if first is not None:
        samples = samples.filter(F.col("timestamp").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    return join_table(keyed(samples, by), bounds, by).filter(inside).drop("window_start", "window_end")


def service_range_of(service: str) -> Column:
    return F.pmod(F.xxhash64(service), F.lit(_RANGES)).cast("int")


def _stored_cut(samples: DataFrame, bounds: Table, by: Sequence[str]) -> DataFrame:
    """Samples of a store inside the windows: the join with the days of each window prunes the folders while the job runs."""
    spark_day = F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"), F.expr("INTERVAL 1 DAY")))
    days = materialise(bounds.df.select("*", spark_day.alias(SAMPLE_DAY), service_range_of("service").alias(SERVICE_RANGE)))
    first, last = days.df.agg(F.min(SAMPLE_DAY), F.max(SAMPLE_DAY)).first()
    between = F.col(SAMPLE_DAY).between(F.lit(first), F.lit(last))
    windows = Table(days.df.filter(between), days.rows, days.bytes)
    inside = F.col("timestamp").between(F.col("window_start"), F.col("window_end"))
    found = join_table(keyed(samples, by).filter(between), windows, [*by, *STORE_KEYS])
    return found.filter(inside).drop("window_start", "window_end", *STORE_KEYS)


def downsampled(
    samples: DataFrame, every: int = KEEP_EVERY, by: Sequence[str] = BY, hot: HotGroups | None = None, timed: bool = False
) -> DataFrame:
    """The first of every ``every`` samples of each pod, in time order; ``timed`` says that all have a time and a sequence number."""
    keys = series_keys(by)
    rows = keyed(samples, by)
    placed = positions(rows, keys, ORDER, hot or find_hot(rows, keys), no_nulls=timed)
    return placed.filter(F.pmod(F.col("pos") - 1, F.lit(every)) == 0).drop("pos")


@dataclass(frozen=True)
class Scoped:
    """Samples to analyse, the series they belong to, and which of these may be hot."""

    rows: DataFrame
    series: Table
    hot: HotGroups
    timed: bool = False  # whether all rows have a time


def scoped(
    samples: DataFrame,
    scope: str = "window",
    hours: float = WINDOW_HOURS,
    every: int = KEEP_EVERY,
    by: Sequence[str] = BY,
    profiled: Table | None = None,
    in_order: bool = False,
) -> Scoped:
    """Samples to analyse: windowed and downsampled (``window``), or all (``full``). ``in_order`` says that they come by series, as those of a series table."""
    if scope not in ("window", "full"):
        raise ValueError(f"Unknown scope: {scope}")
    keys = series_keys(by)
    profiled = profiled or profile(samples, by)
    limit = hot_rows(samples.sparkSession)
    # a series is big in the scope only if it is big as a whole
    most = profiled.largest or 0
    parts = None if in_order else _parts(samples.sparkSession, profiled)

    def placed(rows: DataFrame) -> tuple[DataFrame, HotGroups]:
        hot = replace(find_hot(rows, keys, limit, at_most=most), parts=parts)
        # hot groups are set apart first, and the others spread then
        return rows.repartition(parts, *keys) if parts and hot.table is None else rows, hot

    if scope == "full":
        rows, hot = placed(keyed(samples, by))
        return Scoped(rows, profiled, hot)
    inside, hot = placed(window_cut(samples, window_bounds(profiled, hours, by), by))
    rows = downsampled(inside, every, by, hot, timed=True)
    # hot groups are counted several times further on: do not place their rows anew each time
    return Scoped(rows if hot.table is None else materialise(rows).df, profiled, hot, timed=True)


def _parts(spark: SparkSession, profiled: Table) -> int | None:
    """Partitions by series whose rows one task can order, or None where all are few."""
    if profiled.rows * (profiled.largest or 0) <= FEW_ROWS:
        return None
    total = profiled.df.agg(F.sum("n_rows")).first()[0]
    return max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS)) if total > FEW_ROWS else None


def window_stats(rows: Scoped, by: Sequence[str] = BY) -> DataFrame:
    """Statistics of the scoped rows; a pod without any keeps a row of nulls."""
    keys = series_keys(by)
    stats = rows.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *_statistics())
    return rows.series.df.select(*keys).join(stats, keys, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
