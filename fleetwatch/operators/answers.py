"""From answers and findings to anomalies and a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.fixed_values import ALL_NORMAL_MESSAGE, STATUS_FAILED, STATUS_MESSAGE, STATUS_OK
from fleetwatch.functions.requests import response_text
from fleetwatch.functions.text import all_tags, first_tag, is_flagged
from fleetwatch.operators.charts import series_label
from fleetwatch.operators.series import BY, series_keys


def answers_of(responses: DataFrame) -> DataFrame:
    rest = [c for c in responses.columns if c != "body"]
    return responses.select(*rest, response_text("body").alias("answer"))


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Result text, pod names and verdict of each answer.

    The verdict looks at the result text alone, the names are taken from the whole answer.
    """
    return answers.select(
        *[c for c in answers.columns if c != "answer"],
        first_tag("answer").alias("result"), is_flagged("answer").alias("flagged"), all_tags("answer").alias("pods"),
    )


def named_pods(answers: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each pod name in each answer that does not say "no anomaly"."""
    return answers.filter(is_flagged("answer")).select(*by, "path", F.explode(all_tags("answer")).alias("pod"))


def only_known(named: DataFrame, samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Names that are a pod of the service, or a pod and its node."""
    known = samples.select(*series_keys(by)).distinct()
    names = known.select(*by, "pod").unionByName(known.select(*by, series_label().alias("pod"))).distinct()
    return named.join(names, [*by, "pod"], "left_semi")


def anomalies(named: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each abnormal pod of each service once, whichever path found it."""
    return named.select(*by, "pod").distinct()


def all_normal(found: DataFrame) -> DataFrame:
    """One row: is there no anomaly at all? True for empty input."""
    return found.agg((F.count(F.lit(1)) == 0).alias("all_normal"))


def report_lines(found: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row per abnormal pod, or the one message that all is normal."""
    calm = all_normal(found).filter("all_normal").select(F.lit(ALL_NORMAL_MESSAGE).alias("message"))
    return found.select(*by, "pod").unionByName(calm, allowMissingColumns=True)


def _record(code: int, **body: Column) -> list[Column]:
    return [
        F.lit(code).alias("statusCode"),
        F.to_json(F.struct(*[c.alias(n) for n, c in body.items()])).alias("body"),
    ]


def status(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Status record of a run that went through."""
    return all_normal(found).select(
        *keep, *_record(STATUS_OK, message=F.lit(STATUS_MESSAGE), all_normal=F.col("all_normal"))
    )


def failed_status(spark, error: BaseException) -> DataFrame:
    """Status record of a run that failed."""
    return spark.range(1).select(*_record(STATUS_FAILED, error=F.lit(str(error))))


def status_per_group(groups: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Status record of each group (such as a source file) that went through."""
    counts = found.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return groups.select(*by).distinct().join(counts, list(by), "left").select(
        *by, *_record(STATUS_OK, message=F.lit(STATUS_MESSAGE), all_normal=F.coalesce("__n", F.lit(0)) == 0)
    )
