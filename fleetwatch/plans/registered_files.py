"""Queries over files that are made from the test tables first: sample files, log stores, notices; and trees of requests."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable
from decimal import Decimal
from statistics import mean, stdev

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.functions.text import all_tags
from fleetwatch.operators import answers as ans
from fleetwatch.operators import series, texts
from fleetwatch.operators.detector import Detector
from fleetwatch.operators.inference import infer_kept
from fleetwatch.operators.request_tree import asked_once, judged_services
from fleetwatch.operators.requests import text_requests
from fleetwatch.plans.limits import KEEN
from fleetwatch.plans.log_review import review_tree
from fleetwatch.session import scratch_root, storage_path
from fleetwatch.sources import logs as log_source
from fleetwatch.sources import samples as smp
from fleetwatch.sources import tables as tab
from fleetwatch.sources.sample_store import read_sample_store, write_sample_store
from fleetwatch.sources.series_table import read_series_table, write_series_table
from fleetwatch.streaming.notices import watch_notices

WEEK = 168
TINY_PART = 5     # values per text part
TINY_LOG = 200    # bytes per log part
TINY_FAN_IN = 3
FILE_PARTS = 3
WHOLE = 10**9
NOTICED_ROWS = 1_000_000  # samples of an announced file


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return tab.read_table(spark, folder, "events")


def _new_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def counting_model() -> Callable[[list[str]], list[str]]:
    """A stand-in for a model: says how many lines a log part has, and adds up such answers."""

    def model(bodies: list[str]) -> list[str]:
        said = []
        for body in bodies:
            task, text = json.loads(body)["messages"][0]["content"][0]["text"].split("\n\n", 1)
            lines = text.splitlines()
            said.append(str(sum(map(int, lines)) if task.startswith("The notes") else len(lines)))
        return said

    return model


def peer_model() -> Callable[[list[str]], list[str]]:
    """A stand-in for a model: names pods whose mean is further from the mean of all means than their deviation."""

    def judge(body: str) -> str:
        text = json.loads(body)["messages"][0]["content"][0]["text"]
        pods = [(f"{p}-{n}", Decimal(m)) for p, n, m in re.findall(r"Pod: (.*)\nNode: (.*)\nMean: (-?[\d.]+),", text)]
        peers = re.search(r"All \d+ pods: mean of means (-?[\d.]+), .*std of means ([\d.]+)", text)
        if peers:
            middle, spread = map(Decimal, peers.groups())
        elif len(pods) > 1:
            middle, spread = mean(m for _, m in pods), stdev(m for _, m in pods)
        else:
            return "<result>无异常</result>"
        named = [p for p, m in pods if abs(m - middle) > spread]
        return "<result>" + "".join(f"<pod{i}>{p}</pod{i}>" for i, p in enumerate(named, 1)) + "</result>"

    return lambda bodies: [judge(b) for b in bodies]


def _compare_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.scoped(tab.event_samples(_events(spark, folder)), hours=WEEK)
    answers = judged_services(texts.ServiceTexts(rows, part_values=TINY_PART), asked_once(peer_model))
    return ans.anomalies(ans.named_pods(answers))


def _review_tree(spark: SparkSession, folder: str) -> DataFrame:
    logs = tab.event_logs(_events(spark, folder))
    reviews = review_tree(logs, counting_model, TINY_LOG, every_stream=True, fan_in=TINY_FAN_IN)
    return reviews.select(*log_source.STREAM_KEYS, F.col("answer").cast("bigint").alias("n_events"))


def _resumed_inference(spark: SparkSession, folder: str) -> DataFrame:
    """A model that fails on every request that shows pod-1, and a second run with another that answers all."""
    rows = series.scoped(tab.event_samples(_events(spark, folder)), hours=WEEK)
    requests = text_requests(texts.service_texts(rows, part_values=10 * TINY_PART))
    store = _new_folder(spark)

    def failing():
        def model(bodies: list[str]) -> list[str]:
            if any("Pod: pod-1\\n" in b for b in bodies):
                raise RuntimeError("away")
            return ["first"] * len(bodies)

        return model

    infer_kept(requests, failing, store, rounds=2)
    second = infer_kept(requests, lambda: lambda bodies: ["second"] * len(bodies), store)
    return second.select("service", "part", "answer", "error")


def _sample_files(spark: SparkSession, folder: str) -> str:
    """The events as three sample files; their rows are in order of event_id over the files' names."""
    out = _new_folder(spark)
    rows = tab.event_texts(_events(spark, folder))
    rows.repartitionByRange(FILE_PARTS, "seq").sortWithinPartitions("seq").drop("seq").write.option("header", True).option("emptyValue", "").csv(out)
    return out


def _csv_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = smp.read_samples(spark, _sample_files(spark, folder), row_numbers=True)
    return rows.withColumn("cpuusage", F.round("cpuusage", 6))


def _file_preview(spark: SparkSession, folder: str) -> DataFrame:
    return smp.file_preview(spark, _sample_files(spark, folder)).select(*smp.required_columns())


def _values_by_row(spark: SparkSession, folder: str) -> DataFrame:
    samples = smp.read_samples(spark, _sample_files(spark, folder), row_numbers=True)
    rows = series.scoped(samples.filter("timestamp IS NOT NULL"), "full")
    return texts.service_texts(rows, part_values=WHOLE, row_numbers=True).select("service", "part", "values_text")


def _spoilt_files(spark: SparkSession, folder: str) -> str:
    out = _new_folder(spark)
    rows = tab.event_texts(_events(spark, folder))
    spoilt = rows.withColumn("timestamp", F.when(F.col("seq") % 17 == 0, "yesterday").otherwise(F.col("timestamp")))
    spoilt = spoilt.withColumn("cpuusage", F.when(F.col("seq") % 19 == 0, "much").otherwise(F.col("cpuusage")))
    spoilt.repartitionByRange(FILE_PARTS, "seq").sortWithinPartitions("seq").drop("seq").write.option("header", True).option("emptyValue", "").csv(out)
    return out


def _refused_rows(spark: SparkSession, folder: str) -> DataFrame:
    _, refused = smp.read_checked(spark, _spoilt_files(spark, folder))
    return refused.df.select("service", "pod", "node", "time_text", "value_text", "seq", "reason")


def _accepted_rows(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = smp.read_checked(spark, _spoilt_files(spark, folder))
    return good.df.drop("source_file").withColumn("cpuusage", F.round("cpuusage", 6))


def _stored_logs(spark: SparkSession, folder: str) -> DataFrame:
    lines, store = _new_folder(spark), _new_folder(spark)
    tab.event_logs(_events(spark, folder)).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(lines)
    log_source.write_log_store(log_source.read_log_json(spark, lines), store)
    return log_source.stored_stream_events(spark, store)


def _stored_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Samples cut to a week out of a store by day and service range."""
    store = _new_folder(spark)
    write_sample_store(tab.event_samples(_events(spark, folder)), store)
    samples = read_sample_store(spark, store)
    found = series.window_cut(samples, series.window_bounds(series.profile(samples), WEEK))
    return found.withColumn("cpuusage", F.round("cpuusage", 6))


def _noticed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each event type and one without content, announced; then those of one type again as they are, and the empty one in a new version.

    A type is one file, as a small table's always is, or several, each of a stretch of time that one task can sort and write.
    """
    home = _new_folder(spark)
    rows = tab.event_samples(_events(spark, folder)).withColumn("type", F.col("service"))
    parts = max(1, math.ceil(rows.count() / NOTICED_ROWS))
    spread = rows.repartitionByRange(parts, "type", "timestamp", "seq")
    spread.write.option("header", True).partitionBy("type").csv(f"{home}/in")
    place, files = storage_path(spark, f"{home}/in")
    found: dict[str, list[str]] = {}
    for s in files.globStatus(storage_path(spark, f"{home}/in/type=*/part-*.csv")[0]):
        found.setdefault(s.getPath().getParent().getName().removeprefix("type="), []).append(s.getPath().toString())
    empty, _ = storage_path(spark, f"{home}/in/empty.csv")
    files.create(empty).close()
    found["empty"] = [empty.toString()]

    def announce(versions: list[tuple[str, str]]) -> None:
        notices = [
            json.dumps({"Records": [{"s3": {"bucket": {"name": path.rsplit("/", 1)[0]}, "object": {"key": path.rsplit("/", 1)[1], "eTag": v}}}]})
            for kind, v in versions for path in found[kind]
        ]
        spark.createDataFrame([(n,) for n in notices], "value string").coalesce(1).write.mode("append").text(f"{home}/notices")
        query = watch_notices(spark, f"{home}/notices", f"{home}/out", f"{home}/state", "{bucket}/{key}", hours=WEEK)
        query.awaitTermination()

    kinds = sorted(found)
    announce([(kind, "v1") for kind in kinds])
    announce([(kinds[0], "v1"), (kinds[1], "v2")])
    shown = F.when(F.col("source_file").endswith("empty.csv"), "empty").otherwise(F.regexp_extract("source_file", "type=([^/]*)/", 1))
    status = spark.read.json(f"{home}/out/status").select("source_file", shown.alias("kind"), F.col("statusCode").cast("int"))
    runs = status.groupBy("kind", "statusCode", "source_file").agg(F.count(F.lit(1)).alias("n_runs"))
    return runs.groupBy("kind", "statusCode").agg(F.max("n_runs").alias("n_runs"))  # all files of a type run alike


def _series_table_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What keen limits find on all rows, read in the order of a bucketed table."""
    name = f"fleetwatch_series_{uuid.uuid4().hex}"
    write_series_table(tab.event_samples(_events(spark, folder)), name, path=_new_folder(spark))
    rows = read_series_table(spark, name)
    found = Detector(series.scoped(rows, "full", in_order=True), limits=KEEN).findings()
    return found.withColumn("score", F.round("score", 6))


def file_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "compare_tree": _compare_tree,
        "review_tree": _review_tree,
        "resumed_inference": _resumed_inference,
        "csv_samples": _csv_samples,
        "file_preview": _file_preview,
        "values_text_by_row": _values_by_row,
        "refused_rows": _refused_rows,
        "accepted_rows": _accepted_rows,
        "stored_log_events": _stored_logs,
        "stored_window_cut": _stored_cut,
        "noticed_files": _noticed_files,
        "findings_series_table": _series_table_findings,
    }
