"""Analyse each sample file as it arrives in a folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetwatch.fixed_values import METRIC_COLUMN
from fleetwatch.operators.answers import failed_status, status_per_group
from fleetwatch.plans.batch import Report, analyse
from fleetwatch.session import own_scratch, storage_path
from fleetwatch.sinks.tables import write_charts, write_json
from fleetwatch.sources.images import read_images
from fleetwatch.sources.samples import check_columns, read_csv, required_columns, typed_samples

SOURCE = "source_file"
BY = (SOURCE, "service")
_FILES = "path string, modificationTime timestamp, length bigint, content binary"

# What Spark says where a file's content is at fault, as against a lost executor or a store that is away.
_CONTENT_FAULTS = (
    "CAST_INVALID_INPUT", "USER_RAISED_EXCEPTION", "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD",
    "CSV header does not conform to the schema", "NUMERIC_VALUE_OUT_OF_RANGE", "CANNOT_PARSE_TIMESTAMP",
)


def is_content_fault(error: BaseException) -> bool:
    """Whether the file itself is to blame, so that another try would end alike."""
    said = f"{error}\n{getattr(error, '_stackTrace', '')}"
    return isinstance(error, (ValueError, FileNotFoundError)) or any(mark in said for mark in _CONTENT_FAULTS)


def watch(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    pattern: str = "*.csv",
    files_per_batch: int = 64,
    metric_col: str = METRIC_COLUMN,
    available_now: bool = True,
    image_folder: str | None = None,
    **options,
) -> StreamingQuery:
    """Start a query that analyses every new file of ``folder`` once, each file on its own.

    Where a model is asked (``make_model`` or ``ask``), it also sees the pictures that ``image_folder`` has for a file:
    ``<file name without ending>/cpu_usage_<service>.jpg``. They have to be there before the file.

    Results of a batch go to folders of that batch, which a repeated batch replaces.
    """
    options.setdefault("scope", "full")
    arrivals = (
        spark.readStream.format("binaryFile").schema(_FILES)
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
        .load(folder).select("path", F.col("_metadata.file_path").alias(SOURCE))  # the content is not read here
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        names = {row.path: row[SOURCE] for row in batch.collect()}  # at most files_per_batch names
        with own_scratch(batch.sparkSession):  # all results are written when it ends
            run_batch(batch.sparkSession, names, f"{out}/{{}}/batch={batch_id}", metric_col, options, image_folder=image_folder)

    writer = arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_batch(
    spark: SparkSession, names: Mapping[str, str], target: str, metric_col: str, options: dict, more: Sequence[DataFrame] = (),
    image_folder: str | None = None,
) -> None:
    """Analyse files (path, and path as Spark shows it), each on its own, and write results, charts and status. ``more`` are further status rows."""
    headers, errors = {}, {}
    for path in sorted(names):
        try:
            header = tuple(read_csv(spark, path).columns)
            check_columns(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header)), required_columns(metric_col))
            headers.setdefault(header, []).append(path)
        except Exception as error:
            if not is_content_fault(error):
                raise
            errors[path] = error
    good = [p for files in headers.values() for p in files]
    reports: list[tuple[Sequence[str], Report]] = []
    try:
        if good:
            reports.append((good, _analyse_files(spark, list(headers.values()), metric_col, options | _pictures(spark, image_folder, good, names))))
    except Exception as joint:  # one file spoils the joint run: find out which
        if not is_content_fault(joint):
            raise  # the checkpoint stays where it is, and the batch is run again
        for path in good:
            try:
                reports.append(([path], _analyse_files(spark, [[path]], metric_col, options | _pictures(spark, image_folder, [path], names))))
            except Exception as error:
                if not is_content_fault(error):
                    raise
                errors[path] = error
    parts = [*more, *(failed_status(spark, e).withColumn(SOURCE, F.lit(names[p])) for p, e in errors.items())]
    for files, report in reports:
        listed = spark.createDataFrame([(names[p],) for p in files], f"{SOURCE} string")
        parts.append(status_per_group(listed, report.anomalies.df, [SOURCE]))
    if reports:
        _write_all([r.anomalies.df for _, r in reports], target.format("anomalies"))
        charts = [r.anomalous_series for _, r in reports]
        write_charts(union_all(charts), target.format("charts"), BY)
    if parts:
        write_json(union_all(parts), target.format("status"))


def _pictures(spark: SparkSession, image_folder: str | None, paths: Sequence[str], names: Mapping[str, str]) -> dict[str, DataFrame]:
    """The pictures of some files of a batch, each with the file it belongs to."""
    if image_folder is None:
        return {}
    homes = []
    for path in paths:
        place, files = storage_path(spark, f"{image_folder}/{unquote(path).rsplit('/', 1)[1].rsplit('.', 1)[0]}")
        if files.exists(place):
            homes.append((files.getFileStatus(place).getPath().toString(), names[path]))
    if not homes:
        return {}
    pictures = reduce(DataFrame.unionByName, [read_images(spark, home).withColumn(SOURCE, F.lit(name)) for home, name in homes])
    return {"images": pictures}


def _analyse_files(spark: SparkSession, groups: Sequence[Sequence[str]], metric_col: str, options: dict) -> Report:
    """Files with the same header are read together; every step keeps them apart by their name."""
    tables = [typed_samples(read_csv(spark, files, source=SOURCE), metric_col, keep=(SOURCE,)) for files in groups]
    return analyse(union_all(tables), by=BY, **options)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _write_all(frames: Sequence[DataFrame], folder: str) -> None:
    union_all(frames).write.mode("overwrite").parquet(folder)
