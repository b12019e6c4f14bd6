"""Image files as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def base64_text(content: Column | str) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")
