"""Samples, log events, notifications and answers derived from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatch.fixed_values import NO_ANOMALY

PODS = 15
NODES = 3


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _numbered(prefix: str, count: int) -> Column:
    return F.concat(F.lit(prefix), (F.col("user_id") % count).cast("string"))


def event_samples(events: DataFrame) -> DataFrame:
    """One service per event type, fifteen pods on three nodes each."""
    value = F.col("value")
    return events.select(
        F.col("event_type").alias("service"),
        _numbered("pod-", PODS).alias("pod"),
        _numbered("node-", NODES).alias("node"),
        F.col("ts").alias("timestamp"),
        F.when(~F.isnan(value), value).alias("cpuusage"),
        F.col("event_id").alias("seq"),
    )


def event_upload(events: DataFrame) -> DataFrame:
    """The same samples as an upload with names of its own and two metrics."""
    return events.select(
        F.col("event_type").alias("Service Name"),
        _numbered("pod-", PODS).alias("Pod_Name"),
        F.when(F.col("user_id") % 2 == 0, "cpu").otherwise("cpu_limit").alias("Metric"),
        _numbered("node-", NODES).alias("Host"),
        F.col("ts").alias("Time"),
        F.col("value").alias("CPU Usage"),
        F.col("event_id").alias("seq"),
    )


def event_texts(events: DataFrame) -> DataFrame:
    """The same samples as text, as a sample file holds them, with missing values written out."""
    token = F.element_at(F.array(*[F.lit(t) for t in ("NA", "", "null", "NaN", "<NA>")]), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select(
        F.col("event_type").alias("service"),
        F.when(F.col("event_id") % 11 == 0, token).otherwise(_numbered("pod-", PODS)).alias("pod"),
        _numbered("node-", NODES).alias("node"),
        F.when(F.col("event_id") % 13 == 0, token)
        .otherwise(F.col("ts").cast("string"))
        .alias("timestamp"),
        F.when(F.col("event_id") % 7 == 0, token).otherwise(F.col("value").cast("string")).alias("cpuusage"),
        F.col("event_id").alias("seq"),
    )


def event_logs(events: DataFrame) -> DataFrame:
    """Log events: three regions, one group per event type, one stream per pod."""
    return events.select(
        _numbered("r", NODES).alias("region"),
        F.col("event_type").alias("log_group"),
        _numbered("pod-", PODS).alias("log_stream"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("message"),
    )


def event_notifications(events: DataFrame) -> DataFrame:
    """One notification per event, as the text that announces one or two new files."""

    def record(bucket: Column, key: Column) -> Column:
        return F.struct(
            F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")).alias("s3")
        )

    first = record(F.concat(F.lit("bucket-"), F.col("event_type")), F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit(".csv")))
    second = record(F.concat(F.lit("bucket-"), F.col("event_type")), F.concat(F.lit("in/"), F.col("user_id").cast("string"), F.lit("-b.csv")))
    records = F.when(F.col("event_id") % 4 == 0, F.array(first, second)).otherwise(F.array(first))
    return events.select(F.col("event_id").alias("notification_id"), F.to_json(F.struct(records.alias("Records"))).alias("body"))


def event_answers(events: DataFrame) -> DataFrame:
    """One model answer per event, in every form an answer has been seen in."""
    pod, other = _numbered("pod-", PODS), _numbered("pod-1", 5)
    kinds = [
        F.lit(f"<result>\n {NO_ANOMALY} \n</result>"),
        F.concat(F.lit("<result><pod1> "), pod, F.lit(" </pod1>\n<pod2>\n"), other, F.lit("\n</pod2></result>")),
        F.lit("没有"),
        F.concat(F.lit("<pod1>"), pod, F.lit("</pod1>")),
        F.concat(F.lit(f"<result>{NO_ANOMALY}</result><pod1>"), pod, F.lit("</pod1>")),
        F.concat(F.lit("<pod1>"), pod, F.lit("</pod2>")),
        F.concat(F.lit("<pod1>"), pod),
        F.lit(None).cast("string"),
    ]
    return events.select(
        F.col("event_id").alias("answer_id"),
        F.col("event_type").alias("service"),
        F.when(F.col("user_id") % 2 == 0, "text").otherwise("chart").alias("path"),
        F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int")).alias("answer"),
    )


def event_responses(events: DataFrame) -> DataFrame:
    """The same answers as the model's response bodies."""
    content = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("answer", F.lit("")).alias("text")))
    return event_answers(events).select("answer_id", "service", "path", F.to_json(F.struct(content.alias("content"))).alias("body"))
