"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCRATCH_SETTING = "spark.checkpoint.dir"
_RUN_SETTING = "spark.fleetwatch.run"  # folder of the run that goes on in this session


def build_session(app_name: str = "fleetwatch", master: str | None = None, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    A folder of this machine is used only where the setting is missing and Spark
    itself runs on this machine alone.
    """
    folder = spark.conf.get(SCRATCH_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"Set {SCRATCH_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fleetwatch-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/fleetwatch/{spark.sparkContext.applicationId}"


@dataclass(frozen=True)
class Table:
    """A DataFrame of known size: written and measured, or derived from one that was."""

    df: DataFrame
    rows: int
    bytes: int
    largest: int | None = None  # biggest value of the column asked for


def materialise(df: DataFrame, largest: str | None = None) -> Table:
    """Write ``df`` to the scratch folder and read it back.

    This cuts the lineage in a way that survives lost executors, and the table read
    back has a known size, so later joins can be planned on facts.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    top = F.max(largest) if largest else F.lit(None)
    rows, top = back.agg(F.count(F.lit(1)), top).first()
    return Table(back, rows, _folder_bytes(spark, path), top)


def materialise_kinds(frames: Mapping[str, DataFrame]) -> dict[str, Table]:
    """Write several DataFrames in one job, so that they share scans and shuffles where they can."""
    if len(frames) == 1:
        return {kind: materialise(df) for kind, df in frames.items()}
    spark = next(iter(frames.values())).sparkSession
    path = _new_path(spark)
    tagged = [df.withColumn("__kind", F.lit(kind)) for kind, df in frames.items()]
    union = reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), tagged)
    union.hint("rebalance", "__kind").write.partitionBy("__kind").parquet(path)
    kinds = spark.read.schema(union.schema).parquet(path)
    rows = {r[0]: r[1] for r in kinds.groupBy("__kind").count().collect()}  # one row per kind
    made = {}
    for kind, df in frames.items():
        folder = f"{path}/__kind={kind}"
        if kind in rows:
            made[kind] = Table(spark.read.schema(df.schema).parquet(folder), rows[kind], _folder_bytes(spark, folder))
        else:
            made[kind] = Table(spark.createDataFrame([], df.schema), 0, 0)
    return made


def _new_path(spark: SparkSession) -> str:
    run = spark.conf.get(_RUN_SETTING, "")
    return "/".join([scratch_root(spark), *([run] if run else []), uuid.uuid4().hex])


@contextmanager
def own_scratch(spark: SparkSession):
    """What is written to the scratch folder inside the block is deleted at its end; nothing may need it then."""
    before, run = spark.conf.get(_RUN_SETTING, ""), f"run-{uuid.uuid4().hex}"
    spark.conf.set(_RUN_SETTING, run)
    try:
        yield
    finally:
        spark.conf.set(_RUN_SETTING, before)
        path, files = storage_path(spark, f"{scratch_root(spark)}/{run}")
        files.delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch folder, once no result needs it."""
    path, files = storage_path(spark, scratch_root(spark))
    files.delete(path, True)


def storage_path(spark: SparkSession, folder: str):
    """A path and the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folder_bytes(spark: SparkSession, folder: str) -> int:
    path, files = storage_path(spark, folder)
    return files.getContentSummary(path).getLength()
