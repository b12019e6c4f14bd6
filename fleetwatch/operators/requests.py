"""Tables of model requests: one row per service or log stream, and part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.fixed_values import CHART_NAME_PREFIX
from fleetwatch.functions.requests import COMPARE_LINES, COMPARE_PODS, REVIEW_LOG, request_body
from fleetwatch.functions.text import fill
from fleetwatch.operators.series import BY
from fleetwatch.sources.images import base64_text
from fleetwatch.sources.logs import STREAM_KEYS


def prompts(texts: DataFrame, by: Sequence[str] = BY, template: str = COMPARE_PODS) -> DataFrame:
    filled = fill(template, {"stats": F.col("stats_text"), "data": F.col("values_text")})
    return texts.select(*by, "part", filled.alias("prompt"))


def text_requests(texts: DataFrame, by: Sequence[str] = BY, template: str = COMPARE_PODS, **body) -> DataFrame:
    return prompts(texts, by, template).select(
        *by, "part", F.lit("text").alias("path"), request_body(F.col("prompt"), **body).alias("body")
    )


def image_requests(images: DataFrame, by: Sequence[str] = BY, prompt: str = COMPARE_LINES, **body) -> DataFrame:
    """One request per chart picture; the service is read from the file name, what else a group has from columns of ``images``."""
    service = F.regexp_extract("path", rf"{CHART_NAME_PREFIX}([^/]*)\.[^./]+$", 1)
    return images.select(
        *[service.alias(c) if c == "service" else F.col(c) for c in by], F.lit(0).cast("bigint").alias("part"), F.lit("chart").alias("path"),
        request_body(F.lit(prompt), base64_text("content"), **body).alias("body"),
    )


def log_requests(texts: DataFrame, template: str = REVIEW_LOG, **body) -> DataFrame:
    filled = fill(template, {"data": F.col("text")})
    return texts.select(*STREAM_KEYS, "part", F.lit("log").alias("path"), request_body(filled, **body).alias("body"))
