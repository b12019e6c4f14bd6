"""Analyse the files that notices announce: each version of a file once, however often it is announced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetwatch.fixed_values import METRIC_COLUMN, NO_FILE
from fleetwatch.operators.answers import failed_status
from fleetwatch.session import own_scratch, storage_path
from fleetwatch.sinks.tables import write_json
from fleetwatch.sources.notifications import noticed_files
from fleetwatch.streaming.watch import SOURCE, run_batch, union_all

ADDRESS = "s3a://{bucket}/{key}"
TRIES = 3  # batches that look for an announced file before it counts as missing
_STATE = "path string, version string, state string, tries int"
DONE, WAITING = "done", "waiting"


@dataclass(frozen=True)
class _Found:
    path: str       # as Spark shows it
    version: str    # when it was last written, and how long it is


def _look(spark: SparkSession, path: str) -> _Found | None:
    place, files = storage_path(spark, path)
    if not files.exists(place):
        return None
    there = files.getFileStatus(place)
    shown = there.getPath().toUri().toString()
    if shown.startswith("file:/") and not shown.startswith("file://"):
        shown = "file://" + shown.removeprefix("file:")
    return _Found(shown, f"{there.getModificationTime()}-{there.getLen()}")


def _state(spark: SparkSession, folder: str, before: int) -> DataFrame:
    place, files = storage_path(spark, folder)
    if not files.exists(place):
        return spark.createDataFrame([], _STATE + ", batch bigint")
    return spark.read.schema(_STATE + ", batch bigint").parquet(folder).filter(F.col("batch") < before)


def watch_notices(
    spark: SparkSession,
    notices: str,
    out: str,
    checkpoint: str,
    address: str = ADDRESS,
    files_per_batch: int = 64,
    tries: int = TRIES,
    metric_col: str = METRIC_COLUMN,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Start a query that reads notices (JSON, one a line) from the files of a folder and analyses the files they name.

    A table of keys, written with each batch, says which version of which file is done. A notice that comes again is passed
    over; a file that was written again has another version and is analysed again. A file that a notice without version
    names has its time and length for one. A file that is not there yet is looked for again by the next batches, and
    after ``tries`` of them gets a failed status, as do files without content and notices that name no file. A batch that is
    repeated replaces what it wrote.
    """
    options.setdefault("scope", "full")
    arrivals = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
        .load(notices).withColumnRenamed("value", "body")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        with own_scratch(batch.sparkSession):
            _run_notices(batch, batch_id, out, address, tries, metric_col, options)

    writer = arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _run_notices(batch: DataFrame, batch_id: int, out: str, address: str, tries: int, metric_col: str, options: dict) -> None:
    spark = batch.sparkSession
    target = f"{out}/{{}}/batch={batch_id}"
    known = _state(spark, f"{out}/files", batch_id)
    said = noticed_files(batch, address).distinct()
    nameless = said.filter("path IS NULL").count()
    last = known.agg(F.max("batch")).first()[0]
    waiting = known.filter((F.col("batch") == F.lit(last)) & (F.col("state") == WAITING)).select("path", "version", "tries")
    due = said.filter("path IS NOT NULL").withColumn("tries", F.lit(0)).unionByName(waiting)
    due = due.groupBy("path", "version").agg(F.max("tries").alias("tries"))
    done = known.filter(F.col("state") == DONE).select("path", "version").distinct()
    # a version that is known by name needs no look at the store
    open_ones = due.join(done, ["path", "version"], "left_anti").collect()  # what notices of one batch name, and what waits

    names, state, missing, unnamed = {}, [], [], {}
    for row in open_ones:
        path, version, turn = row["path"], row["version"], row["tries"] + 1
        there = _look(spark, path)
        if there is None:
            lost = turn >= tries
            state.append((path, version, DONE if lost else WAITING, turn))
            if lost:
                missing.append(path)
        elif version is None:
            unnamed[path, there.version] = there
        else:
            names[path] = there.path
            state.append((path, version, DONE, turn))
    if unnamed:
        seen = done.join(spark.createDataFrame(list(unnamed), "path string, version string"), ["path", "version"], "left_semi")
        for path, version in set(unnamed) - {tuple(r) for r in seen.collect()}:
            names[path] = unnamed[path, version].path
            state.append((path, version, DONE, 1))
    parts = [failed_status(spark, FileNotFoundError(NO_FILE + path)).withColumn(SOURCE, F.lit(path)) for path in missing]
    if nameless:
        parts.append(failed_status(spark, ValueError("The notification names no file")).withColumn(SOURCE, F.lit(None).cast("string")))
    if names:
        run_batch(spark, names, target, metric_col, options, parts)
    elif parts:
        write_json(union_all(parts), target.format("status"))
    # the keys are the batch's last write: without them it is run again
    spark.createDataFrame(state, _STATE).coalesce(1).write.mode("overwrite").parquet(target.format("files"))
