"""Notices of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatch.functions.text import fill

VERSIONED_SCHEMA = (
    "Records array<struct<s3: struct<bucket: struct<name: string>, "
    "object: struct<key: string, versionId: string, eTag: string, sequencer: string>>>>"
)
NOTICE_SCHEMA = "Records array<struct<s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>"


def notification_keys(notices: DataFrame, body: str = "body", every_record: bool = False) -> DataFrame:
    """Bucket and key of the first record, or of every record."""
    records = F.from_json(F.col(body), NOTICE_SCHEMA)["Records"]
    rest = [c for c in notices.columns if c != body]
    record = F.explode(records) if every_record else F.get(records, F.lit(0))
    return notices.select(*rest, record.alias("__record")).select(
        *rest,
        F.col("__record.s3.bucket.name").alias("bucket"),
        F.col("__record.s3.object.key").alias("key"),
    )


def noticed_files(notices: DataFrame, address: str, body: str = "body") -> DataFrame:
    """path and version of every record of every notice; both null where a notice names no file.

    ``address`` has the places ``{bucket}`` and ``{key}``. The version is what the store calls it: version, tag or
    sequence number, or null where a notice has none of them.
    """
    records = F.from_json(F.col(body), VERSIONED_SCHEMA)["Records"]
    said = notices.select(F.explode_outer(records).alias("__record")).select(
        F.col("__record.s3.bucket.name").alias("bucket"), F.col("__record.s3.object").alias("object")
    )
    path = fill(address, {"bucket": F.col("bucket"), "key": F.col("object.key")})
    return said.select(path.alias("path"), F.coalesce("object.versionId", "object.eTag", "object.sequencer").alias("version"))
