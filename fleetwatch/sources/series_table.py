"""Samples in a table bucketed and sorted by series: shuffled and sorted once when written, by no analysis after that."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from fleetwatch.operators.series import BY, ORDER, keyed, series_keys
from fleetwatch.session import materialise

BUCKET_ROWS = 5_000_000  # samples that one task reads in order
_ORDERED_SETTING = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def write_series_table(
    samples: DataFrame, name: str, by: Sequence[str] = BY, buckets: int | None = None, path: str | None = None
) -> None:
    """Write the samples of all series that have a time as the new catalog table ``name``.

    Samples with no time or without a part of the key belong to no place in a series and are left out.
    Each bucket is one file, so it is read in the order it was written in. The number of buckets
    follows the number of samples. A series of any length lies in one bucket: analyses set
    hot ones apart before they order them. ``path`` is a folder that all executors share.
    """
    keys = series_keys(by)
    rows = keyed(samples, by).dropna(subset=["timestamp"])
    if buckets is None:
        written = materialise(rows)
        rows = written.df
        buckets = max(samples.sparkSession.sparkContext.defaultParallelism, math.ceil(written.rows / BUCKET_ROWS))
    writer = rows.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *ORDER)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_series_table(spark: SparkSession, name: str) -> DataFrame:
    """Samples of a series table. Turns on, in this session, that a scan of sorted buckets tells their order."""
    spark.conf.set(_ORDERED_SETTING, "true")
    return spark.table(name)
